"""Queries on carriers, marks, the stash and the built-in relational operators that come with Spark."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import formats as K
from ..operators import layers as L
from ..operators import watermark as M
from ..sources import containers as C
from ..streaming import stash
from .base import query, table

_JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02xyz\xff\xd9"
_FRAME = b"\x00\x00\x00\x9d\x01\x2a" + struct.pack("<HH", 64, 48) + bytes(6)
_WEBP = b"RIFF" + struct.pack("<I", 12 + len(_FRAME)) + b"WEBPVP8 " + struct.pack("<I", len(_FRAME)) + _FRAME
_PNG = K.PNG_SIGNATURE + C.png_chunk(b"IHDR", bytes(13)) + C.png_chunk(b"IEND", b"")
BASES = {"png": _PNG, "jpeg": _JPEG, "webp": _WEBP}


def carriers(spark, d: str) -> DataFrame:
    """Documents' whole texts as layers, in turn in each format: image_id, content, layer."""
    docs = table(spark, d, "documents")
    turn = F.col("doc_id") % 3
    content = F.when(turn == 0, F.lit(BASES["png"])).when(turn == 1, F.lit(BASES["jpeg"])).otherwise(F.lit(BASES["webp"]))
    layer = F.to_json(F.struct(F.lit(K.VERSION).alias(K.VERSION_FIELD), F.array(F.struct(F.lit("t1").alias("id"), F.col("text"))).alias("textLayer")))
    return docs.select(F.col("doc_id").alias("image_id"), content.alias("content"), layer.alias("layer"))


def written(spark, d: str) -> DataFrame:
    return C.write(carriers(spark, d))


_FMT = "CASE doc_id % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' ELSE 'webp' END"


# Whole texts. A box over what a JPEG segment holds isn't written, one over the payload cap isn't read.

_ABOUT = 4 + 4 + len(K.BOX_UUID) + 1 + len(K.BOX_LABEL)
_HEAD, _TAIL = f'{{"{K.VERSION_FIELD}":"{K.VERSION}","textLayer":[{{"id":"t1"', "}]}"
_BOXED = f"""boxes AS (SELECT doc_id, text, {_FMT} AS fmt, {16 + _ABOUT + len(_HEAD + _TAIL)} + coalesce(octet_length(encode(to_json(text)::VARCHAR)) + {len(',"text":')}, 0) AS size FROM documents),
w AS (SELECT *, size + {len(K.JPEG_IDENT) + 4 + 2} > {K.SEGMENT_CAP} AS long, size > {K.PAYLOAD_CAP} AS unread FROM boxes)"""


@query(f"""WITH {_BOXED} SELECT doc_id AS image_id, CASE WHEN fmt = 'jpeg' AND long THEN '{K.TOO_LONG}' ELSE 'ok' END AS status, fmt, 'image/' || fmt AS mime, CASE WHEN NOT (fmt = 'jpeg' AND long OR unread) THEN md5(text) END AS text FROM w""")
def container_roundtrip(spark, d):
    found = C.extract(written(spark, d).select("image_id", "status", "content"))
    text = F.from_json("layer", L.LAYER)["textLayer"][0]["text"]
    return found.select("image_id", "status", "fmt", "mime", F.md5(text).alias("text"))


@query(f"""WITH {_BOXED} SELECT turn, type, count(*) AS n FROM (SELECT doc_id % 3 AS turn, unnest(CASE WHEN fmt = 'png' THEN CASE WHEN unread THEN ['IHDR'] ELSE ['IHDR', '{K.PNG_CHUNK.decode()}', 'IEND'] END
WHEN fmt = 'jpeg' THEN CASE WHEN long THEN ['E0', 'DA'] ELSE ['E0', 'EB', 'DA'] END WHEN unread THEN ['VP8X', 'VP8 '] ELSE ['VP8X', 'VP8 ', '{K.WEBP_CHUNK.decode()}'] END) AS type FROM w) GROUP BY ALL""")
def container_parts(spark, d):
    rows = C.parts(written(spark, d), "image_id")
    return rows.groupBy((F.col("image_id") % 3).alias("turn"), "type").agg(F.count("*").alias("n"))


@query(f"""WITH {_BOXED} SELECT doc_id AS image_id, o.fmt, CASE WHEN NOT ((w.fmt = 'jpeg' OR o.fmt = 'jpeg') AND long OR unread) THEN md5(text) END AS text FROM w, (VALUES ('png'), ('jpeg'), ('webp')) o(fmt)""")
def preserve_matrix(spark, d):
    """All documents' layers, in one format, carried over to bare outputs in every format."""
    src = written(spark, d).select("image_id", "content")
    bare = F.explode(F.array(*[F.struct(F.lit(k).alias("fmt"), F.lit(v).alias("content")) for k, v in BASES.items()])).alias("o")
    kept = C.preserve(src, src.select("image_id", bare).select("image_id", "o.*"))
    return kept.select("image_id", "fmt", F.md5(F.from_json(C.layer_json("content"), L.LAYER)["textLayer"][0]["text"]).alias("text"))


@query("SELECT page_id, unnest(regexp_extract_all(html, '(?:src|href)\\s*=\\s*[\"'']([^\"''>]+\\.(?:png|jpe?g|webp))[\"'']', 1)) AS link FROM pages")
def page_image_links(spark, d):
    return C.links(table(spark, d, "pages"))


@query("SELECT doc_id, octet_length(encode(text)) AS bytes, octet_length(encode(text)) BETWEEN 1 AND 26214400 AS accepted FROM documents")
def stash_cap(spark, d):
    n = F.octet_length(F.encode("text", "UTF-8"))
    return table(spark, d, "documents").select("doc_id", n.cast("long").alias("bytes"), stash.accepted(n).alias("accepted"))


@query("""WITH t AS (SELECT json_extract_string(props, '$.k') AS key, event_id, ts, CASE event_type WHEN 'signup' THEN 'put' ELSE 'get' END AS op, value FROM events WHERE event_type IN ('signup', 'view')),
n AS (SELECT *, lead(op) OVER w AS nop, lead(ts) OVER w AS nts, lead(event_id) OVER w AS nid FROM t WINDOW w AS (PARTITION BY key ORDER BY ts, event_id))
SELECT key, event_id AS put_id, nid AS get_id, value FROM n WHERE op = 'put' AND nop = 'get' AND nts - ts <= INTERVAL 100 MINUTE""")
def stash_ttl_batch(spark, d):
    e = table(spark, d, "events").where("event_type in ('signup', 'view')").withColumn("ts", F.col("ts").cast("timestamp"))
    op = F.when(F.col("event_type") == "signup", "put").otherwise("get")
    return stash.served(e.select(F.get_json_object("props", "$.k").alias("key"), "event_id", "ts", op.alias("op"), "value"), 6000)


def rasters(spark, d: str) -> DataFrame:
    """A textured raster of 256 by 256 for each of 64 vectors in a row, its payload from the first one's id."""
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 64).alias("image_id"), "vec_id", "embedding")
    g = e.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("v")).where(F.size("v") == 64)
    return g.select("image_id", F.flatten(F.transform("v", lambda x: x["embedding"])).alias("px"), L.payload_bytes(F.concat(F.lit("img-"), "image_id")).alias("payload"))


def painted(spark, d: str) -> DataFrame:
    import numpy as np
    import pandas as pd

    def run(frames):
        for pdf in frames:
            rows = []
            for r in pdf.itertuples():
                small = np.clip(128 + 255 * np.asarray(r.px, float).reshape(64, 64), 0, 255)
                big = np.tile(small, (8, 12)).astype(np.uint8)  # 512 rows of 768
                rgba = np.stack([big, np.roll(big, 3, 0), np.roll(big, 5, 1), np.full_like(big, 255)], axis=-1)
                rows.append((r.image_id, 768, 512, rgba.tobytes(), r.payload))
            yield pd.DataFrame(rows, columns=["image_id", "w", "h", "rgba", "payload"])

    return rasters(spark, d).mapInPandas(run, "image_id long, w int, h int, rgba binary, payload binary")


_WHOLE = "SELECT vec_id // 64 AS image_id FROM embeddings GROUP BY 1 HAVING count(*) = 64"


@query(f"SELECT image_id, 'img-' || image_id AS text FROM ({_WHOLE})")
def wm_roundtrip(spark, d):
    found = M.extract_table(M.embed_table(painted(spark, d)).select("image_id", "w", "h", "rgba"))
    return found.select("image_id", F.replace(F.decode("payload", "UTF-8"), F.lit("\x00"), F.lit("")).alias("text"))


@query(f"SELECT image_id, a.attack, true AS survived FROM ({_WHOLE}), (VALUES ('none'), ('jpeg85'), ('jpeg60'), ('jpeg40'), ('twice')) a(attack)")
def attack_matrix(spark, d):
    marked = M.embed_table(painted(spark, d)).select("image_id", "w", "h", "rgba")
    hit = M.attack_table(marked, ["none", "jpeg85", "jpeg60", "jpeg40", "twice"]).withColumn("n", F.xxhash64("image_id", "attack"))
    back = M.extract_table(hit.select(F.col("n").alias("image_id"), "w", "h", "rgba")).select(F.col("image_id").alias("n"), "payload")
    told = F.coalesce(F.col("payload") == L.payload_bytes(F.concat(F.lit("img-"), "image_id")), F.lit(False))
    return hit.select("n", "image_id", "attack").join(back, "n").select("image_id", "attack", told.alias("survived"))


@query("SELECT doc_id, md5(text) AS payload FROM documents")
def rs_roundtrip(spark, d):
    """Whole texts in code words of 16 bytes; two bytes of each are damaged and mended."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    from ..functions import codes

    def mended(ids: list, texts: list) -> list:
        """The texts' bytes from the damaged words; null for a null text or one that has a word beyond repair."""
        raw = [(t or "").encode() for t in texts]
        size = np.array([len(r) for r in raw], np.int64)
        count = -(-size // 16)
        text = np.repeat(np.arange(len(raw)), count)
        k = 16 * (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count))
        length = np.minimum(size[text] - k, 16)
        own = np.arange(16) >= 16 - length[:, None]
        data = np.zeros(own.shape, np.uint8)
        data[own] = np.frombuffer(b"".join(raw), np.uint8)
        words, n = codes.rs_encode_rows(data), length + codes.K.PARITY
        i = np.array([x or 0 for x in ids], np.int64)[text]
        row, left, at = np.arange(len(text)), words.shape[1] - n, i % n + k
        words[row, left + at % n] ^= (1 + i % 255).astype(np.uint8)
        words[row, left + (at * 7 + 3) % n] ^= (1 + i % 200).astype(np.uint8)
        back, ok = codes.rs_decode_rows(words, n)
        out, ends = back[own].tobytes(), np.cumsum(size)
        lost = np.bincount(text[~ok], minlength=len(raw))
        return [None if t is None or no else out[e - z : e] for t, no, e, z in zip(texts, lost, ends.tolist(), size.tolist())]

    def run(batches):
        for batch in batches:
            part = np.cumsum(pc.binary_length(batch["text"]).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) >> 21
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    own = batch.slice(a, b - a)
                    yield pa.RecordBatch.from_arrays([own["doc_id"], pa.array(mended(own["doc_id"].to_pylist(), own["text"].to_pylist()), pa.binary())], ["doc_id", "raw"])

    rows = table(spark, d, "documents").select("doc_id", "text").mapInArrow(run, "doc_id long, raw binary")
    return rows.select("doc_id", F.md5("raw").alias("payload"))


# --- inherited from Spark ---


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, grouping_id(l_returnflag, l_linestatus) AS g FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def inherit_cube(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"), F.grouping_id().alias("g"))


@query("SELECT event_type, user_id % 5 AS u, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ROLLUP (event_type, user_id % 5)")
def inherit_rollup(spark, d):
    e = table(spark, d, "events").withColumn("u", F.col("user_id") % 5)
    return e.rollup("event_type", "u").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("""SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS rk, count(*) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS last3, ntile(4) OVER w AS quarter
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def inherit_windows(spark, d):
    w, r = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", F.row_number().over(w).alias("rn"), F.rank().over(r).alias("rk"), F.count("*").over(w.rowsBetween(-2, 0)).alias("last3"), F.ntile(4).over(w).alias("quarter"))


@query("""(SELECT l_suppkey AS k, 'both' AS side FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT s_suppkey, 'both' FROM supplier WHERE s_acctbal > 0) UNION ALL
(SELECT s_suppkey, 'only' FROM supplier EXCEPT SELECT l_suppkey, 'only' FROM lineitem WHERE l_quantity > 49)""")
def inherit_sets(spark, d):
    l, s = table(spark, d, "lineitem"), table(spark, d, "supplier")
    big = lambda q: l.where(F.col("l_quantity") > q).select(F.col("l_suppkey").alias("k"))
    both = big(45).intersect(s.where("s_acctbal > 0").select(F.col("s_suppkey").alias("k")))
    only = s.select(F.col("s_suppkey").alias("k")).subtract(big(49))
    return both.withColumn("side", F.lit("both")).unionByName(only.withColumn("side", F.lit("only")))


@query("""SELECT c_custkey, 'has' AS orders FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) UNION ALL
SELECT c_custkey, 'none' FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def inherit_semi_anti(spark, d):
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    has = c.join(o.where("o_totalprice > 200000"), "c_custkey", "left_semi").withColumn("orders", F.lit("has"))
    return has.unionByName(c.join(o, "c_custkey", "left_anti").withColumn("orders", F.lit("none")))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, max(value) AS top FROM events GROUP BY ALL")
def inherit_event_windows(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("top"))
