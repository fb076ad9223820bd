"""Carriers: round trips, preserving, malformed bytes."""

import json
import struct

import pytest

from glyphlake import formats as K
from glyphlake.plans.carriers import BASES
from glyphlake.sources import containers as C


def box(text):
    body = text.encode()
    about = b"jumb" + K.BOX_UUID + b"\x03" + K.BOX_LABEL
    about = struct.pack(">I", len(about) + 4) + about
    return struct.pack(">I", 16 + len(about) + len(body)) + b"jumb" + about + struct.pack(">I", 8 + len(body)) + b"json" + body


LAYER = json.dumps({K.VERSION_FIELD: "0.3", "textLayer": [{"id": "t1", "text": "+91 98765 43210 ₹", "type": "phone"}]})


@pytest.mark.parametrize("fmt", BASES)
def test_round_trip(fmt):
    out, status = C.inject(BASES[fmt], box(LAYER))
    assert status == "ok" and C.layer_of(C.box_of(out)) == LAYER


@pytest.mark.parametrize("source", BASES)
@pytest.mark.parametrize("output", BASES)
def test_layers_are_preserved(source, output):
    marked, _ = C.inject(BASES[source], box(LAYER))
    kept = C.preserved(marked, BASES[output])
    assert C.layer_of(C.box_of(kept)) == LAYER
    assert C.preserved(marked, kept) == kept  # a layer that is there stays
    assert C.preserved(BASES[source], BASES[output]) == BASES[output]
    assert C.preserved(b"\0\1\2\3", BASES[output]) == BASES[output]


MALFORMED = [
    None,
    b"",
    bytes(range(8)),
    b"\x89PNG\1\2\3\4\5\6\7\x08",
    K.PNG_SIGNATURE + b"abc",
    K.PNG_SIGNATURE + struct.pack(">I", 0x7FFFFFFF) + K.PNG_CHUNK + b"xx",
    b"\xff\xd8\xff",
    b"\xff\xd8\xff\xeb\x00",
    b"\xff\xd8\xff\xeb\x00\x01",
    b"RIFF\0\0\0\0WEBP" + K.WEBP_CHUNK + b"\xff\xff\xff\x7f",
    b"\1\2\3\4",
]


@pytest.mark.parametrize("data", MALFORMED)
def test_malformed_gives_nothing(data):
    assert C.layer_of(C.box_of(data)) is None
    assert isinstance(C.scan(data), list)


def test_bad_boxes():
    good = box(LAYER)
    assert C.layer_of(good) == LAYER
    assert C.layer_of(good[:40]) is None
    assert C.layer_of(good.replace(K.BOX_UUID, bytes(16))) is None
    assert C.layer_of(good[:8] + struct.pack(">I", 0) + good[12:]) is None  # a box of no length
    assert C.layer_of(box("{not json")) is None
    assert C.inject(BASES["jpeg"], bytes(70_000)) == (None, K.TOO_LONG)
    assert C.inject(K.PNG_SIGNATURE, b"x")[0] is None


def test_columns_equal_bytes(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(LAYER,)], "layer string").select(C.boxed(F.col("layer")).alias("b"))
    assert bytes(df.first()["b"]) == box(LAYER)
    rows = [(k, v) for k, v in BASES.items()] + [("none", b"\1\2\3\4\5\6\7\x08")]
    found = C.extract(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert {r["path"]: r["fmt"] for r in found} == {"png": "png", "jpeg": "jpeg", "webp": "webp", "none": None}
    assert all(r["layer"] is None for r in found)


def test_files(spark, tmp_path):
    marked, _ = C.inject(BASES["png"], box(LAYER))
    (tmp_path / "a.png").write_bytes(marked)
    (tmp_path / "b.txt").write_bytes(b"no image")
    found = C.extract(C.read(spark, str(tmp_path))).collect()
    assert [r["layer"] for r in found] == [LAYER]


def test_layers_are_stripped_and_all_else_stays():
    from glyphlake.plans.carriers import BASES
    from glyphlake.sources import containers as C

    for base in BASES.values():
        box = b"\0\0\0\x08jumb"
        full, _ = C.inject(base, box)
        assert C.box_of(full) is not None and C.box_of(C.without_layer(full)) is None
        kinds = [p[0] for p in C.scan(C.without_layer(full))]
        assert [p[0] for p in C.scan(full) if p[0] in kinds] == kinds and len(C.scan(full)) == len(kinds) + 1
    assert C.without_layer(None) is None and C.without_layer(b"text") == b"text"
