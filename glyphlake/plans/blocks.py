"""Queries on luminance blocks. A vector's 64 values, scaled, are one block; 16 blocks in a row are one image."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import round_at
from ..operators import blocks as B
from .base import query, table

LENGTH = 5  # bits of these small streams
_BASIS = "[" + ", ".join(repr(x) for x in B.basis()) + "]::DOUBLE[]"


def blocks(spark, d: str) -> DataFrame:
    """vec_id, image_id, block_idx, px; every third block is smooth."""
    e = table(spark, d, "embeddings")
    scale = F.when(F.col("vec_id") % 3 == 0, 0.05).otherwise(1.0)
    px = F.transform("embedding", lambda x: 128 + 255 * scale * x.cast("double"))
    return e.select("vec_id", F.floor(F.col("vec_id") / 16).alias("image_id"), (F.col("vec_id") % 16).alias("block_idx"), px.alias("px"))


_FOLD = "list_reduce(list_concat([0.0::DOUBLE], {}), lambda p, q: p + q)"
_PX = """b AS (SELECT vec_id, vec_id // 16 AS image_id, vec_id % 16 AS block_idx, vec_id % 2 AS bit,
  list_transform(embedding, lambda x: 128 + 255 * (CASE WHEN vec_id % 3 = 0 THEN 0.05::DOUBLE ELSE 1.0::DOUBLE END) * x::DOUBLE) AS px FROM embeddings)"""
_SIGMA = f"""m AS (SELECT *, {_FOLD.format("px")} / 64 AS mean FROM b),
s AS (SELECT * EXCLUDE mean, sqrt({_FOLD.format("list_transform(px, lambda x: (x - mean) * (x - mean))")} / 64) AS sigma FROM m)"""
_C = f"""c AS (SELECT *, {_FOLD.format(f"list_transform(range(1, 65), lambda i: px[i] * ({_BASIS})[i])")} AS c FROM s)"""
_BASE = f"WITH {_PX}, {_SIGMA}, {_C}"
_VOTE = "abs(c - (2 * floor((c - 26) / 52 + 0.5) + 1) * 26) - abs(c - 2 * floor(c / 52 + 0.5) * 26)"


def measured(spark, d: str) -> DataFrame:
    return blocks(spark, d).withColumn("sigma", B.spread(F.col("px"))).withColumn("c", B.coefficient(F.col("px")))


@query(f"{_BASE} SELECT vec_id, floor(sigma * 1e6 + 0.5) / 1e6 AS sigma, sigma >= 8 AS textured FROM c")
def blk_stddev(spark, d):
    return measured(spark, d).select("vec_id", round_at(F.col("sigma"), 6).alias("sigma"), (F.col("sigma") >= 8).alias("textured"))


@query(f"{_BASE} SELECT vec_id, floor(c * 1e6 + 0.5) / 1e6 AS c21 FROM c")
def blk_dct21(spark, d):
    return measured(spark, d).select("vec_id", round_at(F.col("c"), 6).alias("c21"))


@query(f"""{_BASE}, k AS (SELECT *, CASE WHEN sigma >= 8 THEN 26.0::DOUBLE ELSE 13.0::DOUBLE END AS q FROM c),
l AS (SELECT *, floor(c / q + 0.5) AS lev FROM k),
n AS (SELECT *, CASE WHEN (lev::BIGINT % 2 + 2) % 2 = bit THEN lev ELSE lev + CASE WHEN c - lev * q >= 0 THEN 1 ELSE -1 END END AS lev2 FROM l)
SELECT vec_id, floor((lev2 * q + CASE WHEN q = 26 THEN greatest(-4.0, least(4.0, c - lev2 * q)) ELSE 0 END) * 1e6 + 0.5) / 1e6 AS goal FROM n""")
def blk_qim_embed(spark, d):
    step = F.when(F.col("sigma") >= 8, 26.0).otherwise(13.0)
    goal = B.embedded(F.col("c"), F.col("vec_id") % 2, step)
    return measured(spark, d).select("vec_id", round_at(goal, 6).alias("goal"))


@query(f"{_BASE} SELECT image_id, block_idx % {LENGTH} AS pos, floor(sum({_VOTE}) * 1e6 + 0.5) / 1e6 AS votes, CASE WHEN sum({_VOTE}) < 0 THEN 1 ELSE 0 END::INTEGER AS bit FROM c WHERE sigma >= 3 GROUP BY ALL")
def blk_soft_votes(spark, d):
    rows = measured(spark, d).where("sigma >= 3").withColumn("v", B.vote(F.col("c"), F.lit(26.0)))
    return B.soft_bits(rows, LENGTH).select("image_id", "pos", round_at(F.col("votes"), 6).alias("votes"), "bit")


_POSITION = f"""{_BASE}, p AS (SELECT image_id, block_idx % {LENGTH} AS pos, count(*) FILTER (WHERE sigma >= 8) AS n FROM c GROUP BY ALL),
v AS (SELECT image_id, sum(n)::BIGINT AS eligible, CASE WHEN count(*) < {LENGTH} THEN 0 ELSE min(n) END AS least FROM p GROUP BY 1)"""


@query(f"{_POSITION} SELECT image_id, eligible, least FROM v")
def blk_position_votes(spark, d):
    return B.position_votes(measured(spark, d), LENGTH)


@query(f"{_BASE} SELECT image_id, CASE WHEN count(*) FILTER (WHERE sigma >= 8) >= 8 THEN 'selective' ELSE 'dual' END AS placement FROM c GROUP BY 1")
def blk_placement(spark, d):
    return B.placement(B.position_votes(measured(spark, d), 1), 1).select("image_id", "placement")


@query("""WITH e AS (SELECT vec_id, unnest(range(1, 65)) AS i, embedding FROM embeddings),
a AS (SELECT * FROM (VALUES ('none', 1e6::DOUBLE), ('q100', 100.0), ('q25', 25.0), ('q10', 10.0)) t(attack, k)),
x AS (SELECT vec_id, attack, 255 * embedding[i]::DOUBLE AS v, 255 * (CASE WHEN attack = 'none' THEN embedding[i]::DOUBLE ELSE floor(embedding[i]::DOUBLE * k + 0.5) / k END) AS w FROM e, a)
SELECT vec_id, attack, floor((CASE WHEN avg((v - w) ** 2) = 0 THEN 99.0 ELSE 10 * log10(65025.0 / avg((v - w) ** 2)) END) * 1e4 + 0.5) / 1e4 AS psnr, count(*) FILTER (WHERE v <> w) AS changed FROM x GROUP BY ALL""")
def psnr_matrix(spark, d):
    """Each block under each attack of a fixed list: content by attack."""
    attacks = F.explode(F.array(*[F.struct(F.lit(a).alias("attack"), F.lit(k).alias("k")) for a, k in (("none", 1e6), ("q100", 100.0), ("q25", 25.0), ("q10", 10.0))]))
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", attacks.alias("a")).select("vec_id", "embedding", "a.*")
    rows = rows.select("vec_id", "attack", "k", F.explode("embedding").alias("e")).withColumn("e", F.col("e").cast("double"))
    w = 255 * F.when(F.col("attack") == "none", F.col("e")).otherwise(F.floor(F.col("e") * F.col("k") + 0.5) / F.col("k"))
    rows = rows.withColumn("v", 255 * F.col("e")).withColumn("w", w)
    error = F.avg((F.col("v") - F.col("w")) * (F.col("v") - F.col("w")))
    return rows.groupBy("vec_id", "attack").agg(round_at(B.psnr(error), 4).alias("psnr"), F.count_if(F.col("v") != F.col("w")).alias("changed"))
