"""Helpers shared by the training-data operators.

Words are maximal runs of bytes other than ASCII white space (0x20, 0x09-0x0D).
``bytes.split()`` without arguments splits on exactly these, and ``bytes.lower()``
changes A-Z only, so both are used on UTF-8 bytes throughout.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local session gets its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="glyphlake-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialise(df: DataFrame, label: str, by: str | None = None, dense: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts its lineage and survives lost executors.

    by: a column of few values; a filter on it reads only files of its own.
    dense: smaller files for more work.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    release(spark)
    writer = df.write.option("compression", "zstd") if dense else df.write
    (writer.partitionBy(by) if by else writer).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.written_at = path
    return out


def release(spark: SparkSession) -> None:
    """Asks for the collection of finished steps' handles, whose shuffle files Spark then deletes; nothing depends on it but disk."""
    gc.collect()
    jvm = getattr(getattr(spark, "sparkContext", None), "_jvm", None)
    if jvm is not None:
        jvm.System.gc()


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """While it lasts, Python functions get that many rows at a time, at most: for rows of many kilobytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(df: DataFrame) -> None:
    """Deletes a table that ``materialise`` wrote and that nothing reads any more."""
    path = vars(df).pop("written_at", None)
    if path:
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that df doesn't have."""
    have = {c.lower() for c in df.columns}
    while f"__{name}" in have:
        name = f"{name}_"
    return f"__{name}"


HEAVY = 1 << 16  # keys that are sent to all tasks, at most


def matched(rows: DataFrame, table: DataFrame, on: list[str], weight: str, how: str = "inner", most: int | None = None, floor: int = 0) -> DataFrame:
    """rows joined with ``table``, which has one row a key and in ``weight`` how many rows hold the key.

    The heaviest keys, all of at least 2**k rows for the least k that leaves at most ``most``
    (HEAVY) of them, are sent to all tasks; rows of the others meet in a shuffle, where no key is
    heavy. Both are read several times, so they should be written. how: inner, or left, which
    keeps rows whose key isn't in ``table``; these should be few for each key.
    floor: k is at least that. Where keys of under 2**floor rows are always there, small tables and
    large ones take the same joins, and the rows that these make grow as the input does.
    """
    most = HEAVY if most is None else most
    tails = table.agg(*[F.count_if(F.col(weight) >= 2**k).alias(str(k)) for k in range(48)]).first()
    k = next(k for k in range(floor, 48) if (tails[str(k)] or 0) <= most)
    heavy = F.broadcast(table.where(F.col(weight) >= 2**k).drop(weight))
    if k == 0:
        return rows.join(heavy, on, how)
    rest = [c for c in table.columns if c not in (*on, weight)]
    marked = rows.join(heavy.select(*on, F.struct(F.lit(True).alias("heavy"), *rest).alias("__own")), on, "left")
    light = marked.where("__own is null").drop("__own").join(table.where(F.col(weight) < 2**k).drop(weight), on, how)
    return marked.where("__own is not null").select(*rows.columns, *[F.col(f"__own.{c}").alias(c) for c in rest]).unionByName(light)


WORDS = 1 << 22  # words of 64 bits that tell keys, at most


def key_bits(h: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of each 64-bit hash, and the two bits, or the one, that it sets there."""
    h, one, low = h.view(np.uint64), np.uint64(1), np.uint64(63)
    return (h >> np.uint64(12)) % np.uint64(words), one << (h & low) | one << (h >> np.uint64(6) & low)


def possible(rows: DataFrame, table: DataFrame, h: str) -> DataFrame:
    """rows, written, without most of those whose 64-bit hash ``h`` isn't in ``table``; none that is in it is lost.

    The table's hashes set bits (a Bloom filter of one word a key, 16 bits a key or more until
    WORDS are too few), which are sent to all tasks. The table is read twice, rows once.
    """
    words = min(WORDS, table.count() // 4 + 1)
    bit = lambda x: F.expr(f"shiftleft(1L, cast({x} & 63 as int))")
    word = F.pmod(F.shiftrightunsigned(h, 12), F.lit(words)).alias("word")
    held = table.groupBy(word).agg(F.bit_or(bit(f"`{h}`").bitwiseOR(bit(f"shiftright(`{h}`, 6)"))).alias("bits")).toArrow()
    filled = np.zeros(words, np.uint64)
    filled[held["word"].to_numpy()] = held["bits"].to_numpy().view(np.uint64)
    sent = rows.sparkSession.sparkContext.broadcast(filled)

    @F.pandas_udf("boolean")
    def may(x: pd.Series) -> pd.Series:
        at, bits = key_bits(x.to_numpy(np.int64), len(sent.value))
        return pd.Series(sent.value[at] & bits == bits)

    out = materialise(rows.where(may(h)), "possible")
    sent.destroy()
    return out


def level(h: Column) -> Column:
    """A whole number from 0 to 64 that never falls as the 64-bit hash h grows; each level holds about twice the hashes of the one below."""
    return F.floor(F.log2(F.greatest(h.cast("double") + 2.0**63, F.lit(1.0)))).cast("int")


def least(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The n rows of each key with the least 64-bit hashes in ``order``, or all if there are fewer; null keys are left out.

    Rows are counted by level first, and only the levels that hold the least n are sorted: about
    2 n rows a key, however many there are. The keys must be few. ``rows`` is read twice.
    """
    by_level = Window.partitionBy(key).orderBy("level")
    tally = rows.groupBy(key, level(F.col(order)).alias("level")).agg(F.count("*").alias("n"))
    before = tally.withColumn("before", F.sum("n").over(by_level) - F.col("n")).where(F.col("before") < n)
    limits = before.groupBy(key).agg(F.max("level").alias("__top"))
    near = rows.join(F.broadcast(limits), key).where(level(F.col(order)) <= F.col("__top")).drop("__top")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order, *[c for c in rows.columns if c not in (key, order)]))
    return near.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def id_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_buffer(texts) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes one after another, and the n+1 bounds. Null counts as empty."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    bounds = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(b) for b in raw], out=bounds[1:])
    return np.frombuffer(b"".join(raw), np.uint8), bounds


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PUNCT = _SPACE.copy()
_PUNCT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_WORD_BASE = np.uint64(0x5851F42D4C957F2D)


def powers(base: int | np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), np.uint64(base), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts, lower: bool = False, bare: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, the n+1 word bounds of the texts, and each word's byte start and end.

    bare: ASCII punctuation parts words, too."""
    return word_places(texts, lower, bare)[:4]


def word_places(texts, lower: bool = False, bare: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What ``word_hashes`` gives, and the bytes that the places refer to."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    if lower:
        buf = _LOWER[buf]
    edges = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(b) + 1 for b in raw], out=edges[1:])
    space = (_PUNCT if bare else _SPACE)[buf]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]])) if len(buf) else np.zeros(0, np.int64)
    ends = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]])) if len(buf) else starts
    bounds = np.searchsorted(starts, edges)
    if not len(starts):
        return np.zeros(0, np.uint64), bounds, starts, ends, buf
    length = ends - starts
    at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    h = _BYTE[buf[np.flatnonzero(~space)]] * powers(_WORD_BASE, int(length.max()))[at]
    h = np.add.reduceat(h, np.cumsum(length) - length)
    return mix64(h + length.astype(np.uint64)), bounds, starts, ends, buf


def batches(frames, limit: int, column: str = "text"):
    """Re-cuts pandas frames so that each holds about ``limit`` characters at most (one row may exceed it)."""
    for pdf in frames:
        if len(pdf):
            size = pdf[column].str.len().fillna(0).to_numpy(np.int64) + 16
            part = np.cumsum(size) // limit
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(pdf)]
            for a, b in zip(cuts, cuts[1:]):
                yield pdf.iloc[a:b]
