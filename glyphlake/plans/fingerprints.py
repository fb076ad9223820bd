"""Queries on fingerprints and the registry. A vector stands for an image: its 64 values are hashed, and a coarser copy of it is the query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import formats as K
from ..operators import fingerprint as P
from ..operators import registry as R
from .base import query, table

EXACT, WIDE = 12, 20  # thresholds for 64-bit hashes of these tables


def rounded(e: F.Column, places: int) -> F.Column:
    return F.transform(e, lambda x: F.floor(x.cast("double") * 10.0**places + 0.5) / 10.0**places)


def hashed(spark, d: str, places: int | None = None) -> DataFrame:
    e = table(spark, d, "embeddings")
    values = F.transform("embedding", lambda x: x.cast("double")) if places is None else rounded(F.col("embedding"), places)
    return e.select("vec_id", P.median_words(values, 64).alias("hash"))


def entries(spark, d: str) -> DataFrame:
    return hashed(spark, d).select(F.col("vec_id").alias("key"), F.col("vec_id").alias("reg_ord"), "hash")


def asked(spark, d: str, places: int) -> DataFrame:
    return hashed(spark, d, places).select(F.col("vec_id").alias("query_id"), "hash")


def _hash_sql(name: str, value: str) -> str:
    half = lambda a, b: f"list_reduce(list_concat([0::BIGINT], list_transform(e[{a}:{b}], lambda x: CASE WHEN x > m THEN 1 ELSE 0 END::BIGINT)), lambda p, q: p * 2 + q)"
    return f"""{name} AS (SELECT vec_id, {half(1, 32)} AS hi, {half(33, 64)} AS lo FROM (
  SELECT vec_id, e, list_sort(e[2:64])[32] AS m FROM (SELECT vec_id, list_transform(embedding, lambda x: {value}) AS e FROM embeddings)))"""


_R = _hash_sql("r", "x::DOUBLE")
_Q = {p: _hash_sql("q", f"floor(x::DOUBLE * {10.0**p} + 0.5) / {10.0**p}") for p in (1, 2)}
_PAIRS = "pairs AS (SELECT q.vec_id AS query_id, r.vec_id AS key, bit_count(xor(q.hi, r.hi)) + bit_count(xor(q.lo, r.lo)) AS dist FROM q, r)"


def _ranked(places: int, within: int) -> str:
    return f"""WITH {_R}, {_Q[places]}, {_PAIRS},
c AS (SELECT query_id, key, dist::INTEGER AS dist, row_number() OVER (PARTITION BY query_id ORDER BY dist, key)::INTEGER AS rank FROM pairs WHERE dist <= {within})"""


@query(f"WITH {_R} SELECT vec_id, hi, lo FROM r")
def fp_hash64(spark, d):
    return hashed(spark, d).select("vec_id", F.col("hash")[0].alias("hi"), F.col("hash")[1].alias("lo"))


@query(_ranked(2, EXACT) + " SELECT query_id, key, dist, rank FROM c")
def fp_candidates(spark, d):
    return P.candidates(asked(spark, d, 2), entries(spark, d), EXACT, 64).select("query_id", "key", "dist", "rank")


@query(_ranked(2, EXACT) + " SELECT query_id, key, dist, rank FROM c")
def fp_mih_candidates(spark, d):
    return P.candidates(asked(spark, d, 2), entries(spark, d), EXACT, 64, "index", 8).select("query_id", "key", "dist", "rank")


@query(_ranked(1, WIDE) + " SELECT query_id, key, dist FROM c WHERE rank = 1")
def fp_top1(spark, d):
    return P.nearest(P.candidates(asked(spark, d, 1), entries(spark, d), WIDE, 64, most=1)).select("query_id", "key", "dist")


@query(_ranked(1, WIDE) + ", s AS (SELECT *, lead(dist) OVER (PARTITION BY query_id ORDER BY dist, key) AS second FROM c) SELECT query_id, key, dist FROM s WHERE rank = 1 AND coalesce(second > dist + 4, true)")
def fp_ambiguity_veto(spark, d):
    return P.unambiguous(P.candidates(asked(spark, d, 1), entries(spark, d), WIDE, 64, most=2)).select("query_id", "key", "dist")


@query(_ranked(2, 16) + " SELECT query_id, key, dist FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM c) WHERE n = 1 AND dist <= 6")
def fp_tight_single(spark, d):
    return P.tight_single(P.candidates(asked(spark, d, 2), entries(spark, d), 16, 64, most=2)).select("query_id", "key", "dist")


def rasters(spark, d: str, places: int | None = None) -> DataFrame:
    """Each 16 vectors in a row make one raster of 32 by 32, of values rounded to ``places``: image_id, grey."""
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 16).alias("image_id"), "vec_id", "embedding" if places is None else rounded(F.col("embedding"), places).alias("embedding"))
    rows = e.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("v")).where(F.size("v") == 16)
    return rows.select("image_id", F.transform(F.flatten(F.transform("v", lambda x: x["embedding"])), lambda x: 128 + 255 * x.cast("double")).alias("grey"))


_PHASH = """WITH g AS (SELECT vec_id // 16 AS image_id, (vec_id % 16) * 64 + i - 1 AS idx, 128 + 255 * embedding[i]::DOUBLE AS v
  FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)),
whole AS (SELECT image_id FROM g GROUP BY 1 HAVING count(*) = 1024),
px AS (SELECT g.image_id, idx // 32 AS x, idx % 32 AS y, v FROM g JOIN whole USING (image_id)),
b AS (SELECT u, x, cos((2 * x + 1) * u * pi() / 64) AS c FROM (SELECT unnest(range(0, 16)) AS u), (SELECT unnest(range(0, 32)) AS x)),
t AS (SELECT image_id, u, y, sum(c * v) AS v FROM px JOIN b USING (x) GROUP BY ALL),
low AS (SELECT image_id, t.u * 16 + b.u AS i, sum(c * v) AS v FROM t JOIN b ON t.y = b.x GROUP BY ALL),
m AS (SELECT image_id, list_sort(list(v))[128] AS m FROM low WHERE i > 0 GROUP BY 1),
w AS (SELECT image_id, i // 32 AS k, sum(CASE WHEN v > m THEN (1::BIGINT << (31 - i % 32)) ELSE 0 END)::BIGINT AS w FROM low JOIN m USING (image_id) GROUP BY ALL)
SELECT image_id, string_agg(lpad(lower(to_hex(w)), 8, '0'), '' ORDER BY k) AS phash FROM w GROUP BY 1"""


@query(_PHASH)
def fp_phash256(spark, d):
    return rasters(spark, d).select("image_id", P.words_hex(P.phash("grey")).alias("phash"))


@query(f"WITH {_R}, {_Q[1]} SELECT vec_id, coalesce(bit_count(xor(q.hi, r.hi)) + bit_count(xor(q.lo, r.lo)) > 10, false) AS stale FROM r JOIN q USING (vec_id)")
def stale_flags(spark, d):
    live = hashed(spark, d, 1).withColumnRenamed("hash", "live")
    return hashed(spark, d).join(live, "vec_id").select("vec_id", P.stale(F.col("hash"), F.col("live")).alias("stale"))


@query(_ranked(1, 24) + f""", h AS (SELECT query_id, key, dist, abs(query_id - key) % 90 AS rdist FROM c WHERE key % 3 = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rdist, key) AS n, lead(rdist) OVER (PARTITION BY query_id ORDER BY rdist, key) AS second FROM h),
won AS (SELECT query_id, key, dist FROM o WHERE n = 1 AND rdist <= 40 AND coalesce(second > rdist + 4, true)),
lone AS (SELECT query_id, min(key) AS key, min(dist) AS dist FROM c WHERE query_id NOT IN (SELECT query_id FROM h) GROUP BY 1 HAVING count(*) = 1 AND min(dist) <= 6)
SELECT query_id, key, dist FROM won UNION ALL SELECT query_id, key, dist FROM lone""")
def t2_verified(spark, d):
    """Every third entry has a region; its distance is made up from the ids."""
    found = P.pairs(asked(spark, d, 1), entries(spark, d), 24, 64)
    region = F.when(F.col("key") % 3 == 0, (F.abs(F.col("query_id") - F.col("key")) % 90).cast("int"))
    return P.verified(found, region).select("query_id", "key", "dist")


_AREA = 112  # a wide threshold, so that queries have several candidates
_BASIS = "cos((2 * r + 1) * u * pi() / 64)"
_REGION = f"""WITH g AS (SELECT vec_id // 16 AS image_id, (vec_id % 16) * 64 + i - 1 AS idx, embedding[i]::DOUBLE AS e FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)),
whole AS (SELECT image_id FROM g GROUP BY 1 HAVING count(*) = 1024),
px AS (SELECT side, g.image_id, idx // 32 AS y, idx % 32 AS x, 128 + 255 * CASE side WHEN 'q' THEN floor(e * 10 + 0.5) / 10 ELSE e END AS v FROM g JOIN whole USING (image_id), (VALUES ('q'), ('r')) s(side)),
b AS (SELECT o, u, CASE WHEN o < 0 THEN r ELSE o + r // 2 END AS p, sum({_BASIS}) AS c FROM (SELECT unnest([-1, 0, 8, 16]) AS o), (SELECT unnest(range(0, 16)) AS u), (SELECT unnest(range(0, 32)) AS r) GROUP BY ALL),
t AS (SELECT side, image_id, o AS top, u, x, sum(c * v) AS v FROM px JOIN b ON p = y GROUP BY ALL),
low AS (SELECT side, image_id, top, o AS lft, t.u * 16 + b.u AS i, sum(c * v) AS v FROM t JOIN b ON p = x WHERE (top < 0) = (o < 0) GROUP BY ALL),
m AS (SELECT side, image_id, top, lft, list_sort(list(v))[128] AS m FROM low WHERE i > 0 GROUP BY ALL),
w AS (SELECT side, image_id, top, lft, i // 32 AS k, sum(CASE WHEN v > m THEN (1::BIGINT << (31 - i % 32)) ELSE 0 END)::BIGINT AS w FROM low JOIN m USING (side, image_id, top, lft) GROUP BY ALL),
c AS (SELECT q.image_id AS query_id, r.image_id AS key, sum(bit_count(xor(q.w, r.w)))::INTEGER AS dist FROM w q JOIN w r USING (k) WHERE q.side = 'q' AND r.side = 'r' AND q.top < 0 AND r.top < 0 GROUP BY ALL HAVING sum(bit_count(xor(q.w, r.w))) <= {_AREA}),
d AS (SELECT query_id, key, any_value(dist) AS dist, sum(bit_count(xor(q.w, r.w)))::INTEGER AS rdist FROM c JOIN w q ON q.image_id = query_id JOIN w r ON r.image_id = key AND r.k = q.k AND r.top = q.top AND r.lft = q.lft
  WHERE q.side = 'q' AND r.side = 'r' AND key % 4 <> 0 AND q.lft = key % 3 * 8 AND q.top = key // 3 % 3 * 8 GROUP BY ALL)"""


def regions(spark, d: str) -> DataFrame:
    """Registry of rasters with a quarter-size region each, but for every fourth: key, reg_ord, hash, region, region_hash."""
    i = F.col("image_id")
    left, top = (i % 3) * 8, F.floor(i / 3) % 3 * 8
    percent = lambda at, pad: at.cast("double") / 32 * 100 + 100 * pad
    size = lambda pad: F.lit(50 - 200 * pad)
    box = F.struct(percent(left, K.PAD_X).alias("x"), percent(top, K.PAD_Y).alias("y"), size(K.PAD_X).alias("w"), size(K.PAD_Y).alias("h"))
    rows = rasters(spark, d).select(i.alias("key"), i.alias("reg_ord"), P.phash("grey").alias("hash"), "grey", F.when(i % 4 != 0, box).alias("region"))
    side = F.lit(K.GRID)
    return rows.withColumn("region_hash", P.region_phash("grey", side, side, F.array("region"))[0]).drop("grey")


def region_distances(spark, d: str) -> DataFrame:
    own = rasters(spark, d, 1).select(F.col("image_id").alias("query_id"), "grey", F.lit(K.GRID).alias("width"), F.lit(K.GRID).alias("height"))
    found = P.candidates(own.select("query_id", P.phash("grey").alias("hash")), regions(spark, d), _AREA)
    return P.region_checked(found, own)


@query(_REGION + " SELECT c.query_id, c.key, c.dist, rdist FROM c LEFT JOIN d USING (query_id, key)")
def t2_region_distances(spark, d):
    """Coarse rasters, hashed within each candidate's bounds."""
    return region_distances(spark, d).select("query_id", "key", "dist", "rdist")


@query(_REGION + """, o AS (SELECT *, row_number() OVER w AS n, lead(rdist) OVER w AS second FROM d WINDOW w AS (PARTITION BY query_id ORDER BY rdist, key))
SELECT query_id, key, dist FROM o WHERE n = 1 AND rdist <= 40 AND coalesce(second > rdist + 4, true) UNION ALL
SELECT query_id, min(key), min(dist) FROM c WHERE query_id NOT IN (SELECT query_id FROM d) GROUP BY 1 HAVING count(*) = 1 AND min(dist) <= 6""")
def t2_region_verified(spark, d):
    """The candidate whose region agrees with the query's own pixels, or nothing."""
    return P.verified(region_distances(spark, d), F.col("rdist")).select("query_id", "key", "dist")


_KEY = "json_extract_string(props, '$.k')"


@query(f"SELECT key, event_id, value FROM (SELECT {_KEY} AS key, event_id, value, row_number() OVER (PARTITION BY {_KEY} ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type = 'signup') WHERE n = 1")
def reg_upsert(spark, d):
    e = table(spark, d, "events").where("event_type = 'signup'")
    rows = e.select(F.get_json_object("props", "$.k").alias("key"), "event_id", "ts", "value")
    half = F.col("event_id") % 2 == 0
    return R.upsert(rows.where(half), rows.where(~half), ["ts", "event_id"]).select("key", "event_id", "value")


@query("""WITH s AS (SELECT vec_id AS key, 'seed-' || vec_id AS content_id, label FROM embeddings WHERE vec_id % 2 = 0),
t AS (SELECT vec_id AS key, 'img-' || vec_id AS content_id, label + 1 AS label FROM embeddings WHERE vec_id % 3 = 0)
SELECT key, coalesce(t.content_id, s.content_id) AS content_id, coalesce(t.label, s.label)::INTEGER AS label FROM s FULL JOIN t USING (key)""")
def reg_overlay(spark, d):
    e = table(spark, d, "embeddings").withColumnRenamed("vec_id", "key")
    named = lambda p: F.concat(F.lit(p), F.col("key").cast("string")).alias("content_id")
    seed = e.where("key % 2 = 0").select("key", named("seed-"), "label")
    store = e.where("key % 3 = 0").select("key", named("img-"), (F.col("label") + 1).cast("int").alias("label"))
    return R.overlay(seed, store)


@query("""WITH t AS (SELECT vec_id AS query_id, 'img-' || (vec_id * 7 % 600) AS t1_text FROM embeddings),
r AS (SELECT 'img-' || (vec_id // 2) AS content_id, min(vec_id) AS key FROM embeddings GROUP BY 1)
SELECT query_id, key FROM t JOIN r ON t1_text = content_id""")
def reg_content_id(spark, d):
    e = table(spark, d, "embeddings")
    texts = e.select(F.col("vec_id").alias("query_id"), F.concat(F.lit("img-"), (F.col("vec_id") * 7 % 600).cast("string")).alias("t1_text"))
    reg = e.select(F.col("vec_id").alias("key"), F.col("vec_id").alias("reg_ord"), F.concat(F.lit("img-"), F.floor(F.col("vec_id") / 2).cast("string")).alias("content_id"))
    return R.by_content_id(texts, reg).select("query_id", "key")


@query("SELECT label::INTEGER AS label, count(*) AS entries FROM embeddings GROUP BY 1")
def reg_count(spark, d):
    return table(spark, d, "embeddings").groupBy(F.col("label").cast("int").alias("label")).agg(F.count("*").alias("entries"))


@query("SELECT vec_id, vec_id % 4 <> 0 AS valid FROM embeddings")
def reg_key_format(spark, d):
    size = F.when(F.col("vec_id") % 4 == 0, 63).otherwise(64)
    e = table(spark, d, "embeddings").select("vec_id", F.substr(F.repeat(F.lpad(F.hex("vec_id"), 16, "0"), 4), F.lit(1), size).alias("key"))
    return e.join(R.well_formed(e).select("vec_id", F.lit(True).alias("ok")), "vec_id", "left").select("vec_id", F.coalesce("ok", F.lit(False)).alias("valid"))


@query(f"""WITH {_R}, {_Q[2]}, {_PAIRS},
i AS (SELECT vec_id AS query_id, CASE WHEN vec_id % 5 = 0 THEN 'layer ' || vec_id END AS layer_text, CASE WHEN vec_id % 5 <> 0 AND vec_id % 7 = 0 THEN 'img-' || vec_id WHEN vec_id % 11 = 0 THEN '+1 800 555 01' || (10 + vec_id % 90) WHEN vec_id % 13 = 0 THEN '{K.ID_PREFIX}lost' END AS t1_text FROM embeddings),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, key) AS n, lead(dist) OVER (PARTITION BY query_id ORDER BY dist, key) AS second FROM pairs WHERE dist <= {EXACT} AND query_id % 4 <> 0),
won AS (SELECT query_id, key FROM near WHERE n = 1 AND coalesce(second > dist + 4, true))
SELECT query_id, tier, CASE tier WHEN 'content_id' THEN query_id::VARCHAR WHEN 'fingerprint' THEN key::VARCHAR END AS key,
  CASE tier WHEN 'container' THEN layer_text WHEN 'value' THEN t1_text END AS value,
  CASE tier WHEN 'value' THEN CASE WHEN t1_text LIKE '+%' THEN 'phone' ELSE 'unknown' END END AS value_type,
  CASE tier WHEN 'fingerprint' THEN 'verified' WHEN 'value' THEN CASE WHEN t1_text LIKE '+%' THEN 'exact' ELSE 'unverified_id' END ELSE 'exact' END AS status
FROM (SELECT i.*, won.key, CASE WHEN layer_text IS NOT NULL THEN 'container' WHEN t1_text LIKE 'img-%' THEN 'content_id' WHEN won.key IS NOT NULL THEN 'fingerprint' WHEN t1_text IS NOT NULL THEN 'value' END AS tier FROM i LEFT JOIN won USING (query_id)) WHERE tier IS NOT NULL""")
def resolve_tiers(spark, d):
    from ..operators.resolve import resolve

    i = F.col("query_id")
    t1 = F.when((i % 5 != 0) & (i % 7 == 0), F.concat(F.lit("img-"), i.cast("string"))).when(i % 11 == 0, F.concat(F.lit("+1 800 555 01"), (10 + i % 90).cast("string"))).when(i % 13 == 0, K.ID_PREFIX + "lost")
    images = asked(spark, d, 2).withColumn("layer_text", F.when(i % 5 == 0, F.concat(F.lit("layer "), i.cast("string")))).withColumn("t1_text", t1)
    images = images.withColumn("hash", F.when(i % 4 != 0, F.col("hash"))).withColumn("stored_digest", F.lit(None).cast("array<long>")).withColumn("live_digest", F.col("hash"))
    reg = entries(spark, d).withColumn("content_id", F.concat(F.lit("img-"), F.col("key").cast("string")))
    return resolve(images, reg, EXACT, 64).drop("stale")
