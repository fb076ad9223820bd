"""Policy, actions, geometry, authoring and resolution on small literal tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphlake import formats as K
from glyphlake.functions import numbers as N
from glyphlake.functions import text as T
from glyphlake.operators import authoring, fingerprint, layers, ocr, watermark
from glyphlake.operators.resolve import resolve
from glyphlake.sources import containers, images

ACTIONS = [
    ("url", "javascript:alert(1)", None),
    ("url", "data:text/html,x", None),
    ("url", "file:///etc/passwd", None),
    ("url", "  JaVaScRiPt:alert(1)", None),
    ("url", "http://example.com", "https://example.com"),
    ("url", "example.com", "https://example.com"),
    ("phone", "+1 (800) 555\nrm -rf; <script>", "tel:+1800555"),
    ("address", "Plot 4B, Pune 411001", "https://maps.google.com/?q=Plot%204B%2C%20Pune%20411001"),
    ("text", "hello", None),
    ("url", "https://x.example/" + "a" * 100_000, "https://x.example/" + "a" * 100_000),
]


def test_actions(spark):
    df = spark.createDataFrame(ACTIONS, "type string, text string, expected string")
    rows = df.select("expected", T.action_uri(F.col("type"), F.col("text")).alias("uri")).collect()
    assert all(r["uri"] == r["expected"] for r in rows)


@pytest.mark.parametrize("may,asked,mode", [(True, "full", "full"), (False, "raster_only", "button_only"), (False, "blocked", "button_only"), (None, "blocked", "blocked")])
def test_modes(spark, may, asked, mode):
    df = spark.createDataFrame([(may, asked)], "may boolean, asked string")
    assert df.select(layers.resolved_mode(F.col("may"), F.col("asked"))).first()[0] == mode


def test_rounding(spark):
    df = spark.createDataFrame([(-2.5,), (2.5,), (0.49999,)], "x double")
    assert [r[0] for r in df.select(N.round_up(F.col("x"))).collect()] == [-2, 3, 0]


def test_types(spark):
    rows = [("+91-98765-43210", "phone"), ("www.a.com", "url"), ("a@b.co", "email"), ("12", "text"), (" HTTPS://X.y﻿", "url")]
    df = spark.createDataFrame(rows, "t string, e string").select("e", T.infer_type(F.col("t")).alias("got"))
    assert all(r["e"] == r["got"] for r in df.collect())


def test_orientation_and_size():
    px = np.arange(2 * 3 * 4, dtype=np.uint8).reshape(2, 3, 4)
    assert [images.oriented(px, k).shape[:2] for k in range(1, 9)] == [(2, 3)] * 4 + [(3, 2)] * 4
    assert (images.oriented(px, 3) == px[::-1, ::-1]).all() and (images.oriented(px, 5) == px.transpose(1, 0, 2)).all()
    assert images.canonical(np.zeros((100, 300, 4), np.uint8)).shape == (344, 1024, 4)


def test_hash_distances(spark):
    rows = [(1, "f" * 64, "f" * 63 + "e", 1), (2, "f" * 64, "0" * 64, 256), (3, "f" * 64, "f", None), (4, None, "f" * 64, None)]
    from glyphlake.functions.bits import hex_distance

    df = spark.createDataFrame(rows, "i int, a string, b string, d int")
    assert all(r["d"] == r["got"] for r in df.select("d", hex_distance(F.col("a"), F.col("b")).alias("got")).collect())


def test_index_equals_nested_loop(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**32, (40, 8))
    near = base.copy()
    for r in near:
        for bit in rng.choice(256, rng.integers(0, 40), replace=False):
            r[bit // 32] ^= 1 << int(bit % 32)
    q = spark.createDataFrame([(i, [int(x) for x in r]) for i, r in enumerate(near)], "query_id long, hash array<long>")
    e = spark.createDataFrame([(i, i, [int(x) for x in r]) for i, r in enumerate(base)], "key long, reg_ord long, hash array<long>")
    got = {m: sorted(map(tuple, fingerprint.candidates(q, e, 24, 256, m).select("query_id", "key", "dist").collect())) for m in ("nested", "index")}
    assert got["nested"] == got["index"] and len(got["nested"]) > 5


def test_readings():
    assert list(ocr.readings("Ol")) == ["Ol", "0l", "O1", "01"]
    assert sum(1 for _ in ocr.readings("O" * 40)) == K.CANDIDATES


def test_authoring_then_resolution(spark):
    y, x = np.mgrid[0:256, 0:512]
    px = np.stack([x % 256, y % 256, (x * y) % 256, np.full_like(x, 255)], -1).astype(np.uint8)
    rasters = spark.createDataFrame([(1, 512, 256, px.tobytes()), (2, 512, 256, px[::-1].tobytes())], "image_id long, w int, h int, rgba binary")
    good = {"id": "t1", "text": "+91 98765 43210", "type": "phone", "primary": True, "selectable": True, "bounds": {"x": 10.5, "y": 10.5, "w": 50.5, "h": 20.5}}
    defs = [{"image_id": i, "contentId": f"c{i}", "permissions": dict.fromkeys(("platformCanDisableSelection", "platformCanDisableLinks", "platformCanDisableAll"), True), "textLayer": [good if i == 1 else good | {"text": ""}]} for i in (1, 2)]
    schema = f"image_id long, contentId string, permissions struct<platformCanDisableSelection:boolean,platformCanDisableLinks:boolean,platformCanDisableAll:boolean>, textLayer array<{layers.OBJECT}>"
    d = spark.createDataFrame([(json.dumps(x),) for x in defs], "j string").select(F.from_json("j", schema).alias("d")).select("d.*")
    carriers, entries, rejected = authoring.write(rasters, d)
    assert [(r["image_id"], r["errors"]) for r in rejected.collect()] == [(2, ["V-04"])]
    layer = json.loads(containers.extract(carriers).first()["layer"])
    assert layer["textLayer"][0]["text"] == good["text"] and layer["binding"]["payloadMode"] == "direct" and layer["contentId"] == "c1"
    entry = entries.first()
    assert len(entry["key"]) == 64 and len(entry["region_hash"]) == 8 and layer["pixelDigest"] == entry["key"]
    reg = entries.withColumn("reg_ord", F.lit(0))
    asks = spark.createDataFrame([(1, None, None, None, "c1", None), (2, None, None, None, None, entry["hash"]), (3, None, None, None, "+1 800 555 0100", None), (4, None, None, None, K.ID_PREFIX + "x", None)], "query_id long, layer_text string, stored_digest array<long>, live_digest array<long>, t1_text string, hash array<long>")
    got = {r["query_id"]: (r["tier"], r["status"], r["value_type"]) for r in resolve(asks, reg).collect()}
    assert got == {1: ("content_id", "exact", None), 2: ("fingerprint", "verified", None), 3: ("value", "exact", "phone"), 4: ("value", "unverified_id", "unknown")}


def test_png_decodes(spark, tmp_path):
    px = np.random.default_rng(0).integers(0, 256, (16, 24, 4), dtype=np.uint8)
    px[..., 3] = 255
    (tmp_path / "a.png").write_bytes(images.to_png(px))
    row = images.read(spark, str(tmp_path)).first()
    assert (np.frombuffer(row["rgba"], np.uint8).reshape(16, 24, 4) == px).all()
    assert watermark.extract(px) is None
