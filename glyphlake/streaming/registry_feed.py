"""Registry entries arriving as a stream, merged into a table kept as Parquet versions.

Entries lie in parts by the first two digits of their key. A batch rewrites only the parts that
it touches, as version v<batch>, and then says in list m<batch> which version each part has; a
list counts once it is written whole. The lists of the last two batches and the versions they
name are kept, so that a batch can be repeated and readers of the last list aren't disturbed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import registry

KEPT = 2
PART = "lower(substring(key, 1, 2))"  # 256 at most


def _listed(spark: SparkSession, folder: str, prefix: str) -> dict[int, object]:
    """The numbers and paths of what is written whole under a prefix."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
    named = [(p.getName(), p) for p in found if fs.exists(p.suffix("/_SUCCESS"))]
    return {int(n[1:]): p for n, p in named if n[:1] == prefix and n[1:].isdigit()}


def parts(spark: SparkSession, folder: str, below: int | None = None) -> dict[str, int]:
    """Each part's version by the newest list (under a number)."""
    lists = [n for n in _listed(spark, folder, "m") if below is None or n < below]
    return {r["part"]: r["version_of"] for r in spark.read.parquet(f"{folder}/m{max(lists)}").collect()} if lists else {}


def _read(spark: SparkSession, folder: str, versions: dict[str, int]) -> DataFrame | None:
    paths = [f"{folder}/v{v}/part={p}" for p, v in sorted(versions.items())]
    return spark.read.parquet(*paths) if paths else None


def current(spark: SparkSession, folder: str, below: int | None = None) -> DataFrame | None:
    """The newest whole state of the table (under a number), or None if there is none."""
    return _read(spark, folder, parts(spark, folder, below))


def _forget(spark: SparkSession, folder: str) -> None:
    """Deletes lists before the last ones, and versions that none of these names."""
    lists, versions = _listed(spark, folder, "m"), _listed(spark, folder, "v")
    kept = sorted(lists)[-KEPT:]
    named = {v for n in kept for v in parts(spark, folder, n + 1).values()}
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in [p for n, p in lists.items() if n not in kept] + [p for v, p in versions.items() if v not in named and v < max(kept)]:
        path.getFileSystem(conf).delete(path, True)


def merge(folder: str):
    """For foreachBatch: writes batch n from the state before, so that a repeated batch changes nothing."""

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = registry.well_formed(batch).withColumn("version", F.lit(number))
        before = parts(spark, folder, number)
        touched = [r["part"] for r in batch.select(F.expr(PART).alias("part")).distinct().collect()]
        old = _read(spark, folder, {p: before[p] for p in touched if p in before})
        rows = registry.latest(batch if old is None else old.unionByName(batch), ["version", "seq"])
        rows.withColumn("part", F.expr(PART)).write.mode("overwrite").partitionBy("part").parquet(f"{folder}/v{number}")
        now = before | dict.fromkeys(touched, number)
        spark.createDataFrame(sorted(now.items()), "part string, version_of int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/m{number}")
        _forget(spark, folder)

    return one


def feed(entries: DataFrame, folder: str, checkpoint: str):
    """Starts the stream over what is available and returns its query."""
    return entries.writeStream.foreachBatch(merge(folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
