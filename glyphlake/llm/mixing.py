"""Mixing sources to target weights, with DataFrame functions only.

The words of a source form one stream: its documents one after another, in an order
fixed by hashes and ids. The stream is cut into blocks of ``block`` words. The mix
takes ``target`` words of each source: every slot of an output shard names a source;
how many slots each source gets in a shard is drawn by a multinomial over shards,
conditioned on the source's total so that its words meet the target. A source's slots
are numbered through all shards, and slot k maps to a block through a pseudorandom
permutation of the block indices (a swap-or-not shuffle), a new one for each pass
over the source. Blocks join the stream's pieces by (source, block).

Defined cases: null or empty text has size 0 and is never taken; a null source is a
source of its own, after all others; a source of size 0 has target 0; equal rows are
counted one by one; an empty table gives an empty mix; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise

ROUNDS = 16
LOT = 4096  # slots that are generated together
PART = 256  # documents of a source that are sorted together


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, key (text form of the source that tells null from empty), size, h (orders equal ids)."""
    return docs.select(
        "doc_id",
        "source",
        F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source")).alias("key"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("doc_id", "text").alias("h"),
    )


def targets(base: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """key, source_size, target for each source.

    Filled like water: with sources sorted by cap/weight, the level is the first at which
    the remaining words, shared by the remaining weights, stay under the next source's cap.
    """
    per = base.groupBy("key").agg(F.sum("size").alias("source_size"), F.first("source").alias("source"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int"))
    per = per.select("key", "source_size", weight.alias("w"), (F.col("source_size") * cap).alias("most"))
    order = Window.orderBy(F.col("most") / F.col("w"), "key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * share
    level = (total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(onward)
    per = per.withColumn("level", level).withColumn("n", F.row_number().over(order))
    fits = F.when(F.col("level") <= F.col("most") / F.col("w"), F.struct("n", "level"))
    per = per.withColumn("level", F.min(fits).over(Window.partitionBy())["level"])
    return per.select("key", "source_size", F.least("most", F.coalesce(F.col("level") * F.col("w"), "most")).alias("target"))


def permuted(x: Column, n: Column, tweak: list[Column], inverse: bool = False) -> Column:
    """A pseudorandom permutation of 0..n-1: each round pairs x with K-x and swaps where a hash of the pair says so."""
    rounds = F.array(*[F.lit(r) for r in (reversed(range(ROUNDS)) if inverse else range(ROUNDS))])

    def step(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit(11), r, *tweak), n) - at, n)
        return F.when(F.pmod(F.xxhash64(F.lit(13), r, F.greatest(at, other), *tweak), F.lit(2)) == 1, other).otherwise(at)

    return F.aggregate(rounds, x.cast("long"), step)


def begun(rows: DataFrame, index: str, value: str, width: int = 1024) -> DataFrame:
    """rows(key, index, value), one a key and index, with ``begin``, the values' sum over smaller indexes of the key.

    Indexes are summed in stretches of ``width`` and within them, so that no task sorts all of a key.
    """
    rows = rows.withColumn("stretch", F.floor(F.col(index) / width))
    before = lambda order, *keys: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy("key", "stretch").agg(F.sum(value).alias("all"))
    tops = tops.select("key", "stretch", F.coalesce(F.sum("all").over(before("stretch", "key")), F.lit(0)).alias("top"))
    inner = F.coalesce(F.sum(value).over(before(index, "key", "stretch")), F.lit(0))
    return rows.withColumn("begin", inner).join(tops, ["key", "stretch"]).withColumn("begin", F.col("begin") + F.col("top")).drop("stretch", "top")


def tasks(df: DataFrame) -> int:
    """How many tasks a step with much to make from few rows gets; Spark would join them by what they read."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def streamed(base: DataFrame) -> DataFrame:
    """base with ``off``, the place of the document's first word in its source's stream.

    A source is split by hash into parts of a few hundred documents, so that no task sorts
    a whole source; the parts' sums give where each part begins.
    """
    largest = base.groupBy("key").count().agg(F.max("count")).first()[0] or 0
    base = base.withColumn("part", F.pmod("h", F.lit(largest // PART + 1)))
    own = Window.partitionBy("key", "part").orderBy("doc_id", "h", "size").rowsBetween(Window.unboundedPreceding, -1)
    parts = begun(base.groupBy("key", "part").agg(F.sum("size").alias("s")), "part", "s").drop("s")
    off = F.col("begin") + F.coalesce(F.sum("size").over(own), F.lit(0))
    return base.join(parts, ["key", "part"]).withColumn("off", off).drop("part", "begin")


def drawn(goal: DataFrame, block: int = 1024, seed: int = 0) -> DataFrame:
    """Slots of the mix: shard, key, slot, blk, take (the first ``take`` words of block ``blk``)."""
    size, want = F.col("source_size"), F.col("want")
    goal = goal.where("source_size > 0").withColumn("want", F.floor(F.col("target") + 0.5)).withColumn("n", F.ceil(size / block))
    goal = goal.withColumn("slots", F.floor(want / size) * F.col("n") + F.least("n", F.ceil(want % size / block) + 1))
    shards = goal.agg(F.ceil(F.coalesce(F.sum("slots"), F.lit(0)) / LOT).alias("shards"))
    goal = goal.crossJoin(F.broadcast(shards))  # one row, made by an aggregate
    lots = goal.select("key", "shards", "slots", F.explode(F.sequence(F.lit(0), F.floor((F.col("slots") - 1) / LOT))).alias("lot"))
    lots = lots.repartition(tasks(lots), "key", "lot")  # few sources, many slots
    draws = (
        lots.select("key", "shards", F.explode(F.sequence(F.col("lot") * LOT, F.least((F.col("lot") + 1) * LOT, "slots") - 1)).alias("k"))
        .groupBy("key", F.pmod(F.xxhash64(F.lit(seed), "key", "k"), F.col("shards")).alias("shard"))
        .agg(F.count("*").alias("m"))
    )
    first = begun(draws, "shard", "m").repartition(tasks(draws), "key", "shard")
    slots = first.select("key", "shard", F.explode(F.sequence("begin", F.col("begin") + F.col("m") - 1)).alias("slot"))
    slots = slots.join(goal, "key")
    turn, q, n = F.col("turn"), F.col("q"), F.col("n")
    slots = slots.withColumn("turn", F.floor(F.col("slot") / n)).withColumn("q", F.col("slot") % n)
    tweak = [F.lit(seed), F.col("key"), turn]
    slots = slots.withColumn("blk", permuted(q, n, tweak)).withColumn("tail_q", permuted(n - 1, n, tweak, inverse=True))
    short = n * block - size  # words that the last block lacks
    slots = slots.withColumn("len", block - F.when(F.col("blk") == n - 1, short).otherwise(0))
    begin = turn * size + q * block - F.when(F.col("tail_q") < q, short).otherwise(0)
    return slots.select("shard", "key", "slot", "blk", F.greatest(F.lit(0), F.least("len", want - begin)).alias("take")).where("take > 0")


def pieces(stream: DataFrame, block: int = 1024) -> DataFrame:
    """Where documents lie in blocks: key, off, blk, a, b (words a to b of the block)."""
    off, end = F.col("off"), F.col("off") + F.col("size")
    blk = F.explode(F.sequence(F.floor(off / block), F.floor((end - 1) / block))).alias("blk")
    rows = stream.where("size > 0").select("key", "off", end.alias("end"), blk)
    return rows.select("key", "off", "blk", F.greatest(F.lit(0), off - F.col("blk") * block).alias("a"), F.least(F.lit(block), F.col("end") - F.col("blk") * block).alias("b"))


def mix(docs: DataFrame, block: int = 1024, seed: int = 0, **how) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, source."""
    base = materialise(sized(docs), "mix-sizes")
    goal, stream = targets(base, **how), materialise(streamed(base), "mix-stream")
    met = drawn(goal, block, seed).join(pieces(stream, block), ["key", "blk"])
    got = F.greatest(F.lit(0), F.least("take", "b") - F.col("a"))
    met = met.groupBy("key", "off").agg(F.sum(got).alias("got"))
    taken = F.when(F.col("size") > 0, F.coalesce("got", F.lit(0))).otherwise(0).cast("long").alias("taken")
    return stream.join(met, ["key", "off"], "left").join(goal, "key").select("doc_id", "size", "source_size", "target", taken, "source")
