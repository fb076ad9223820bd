"""The registry of fingerprints as a table: key, reg_ord (place of insertion), entry columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, seq: list[str], key: str = "key") -> DataFrame:
    """The last row of each key by ``seq``. A key keeps its first place of insertion."""
    last = Window.partitionBy(key).orderBy(*[F.col(s).desc() for s in seq])
    rows = rows.withColumn("_n", F.row_number().over(last))
    if "reg_ord" in rows.columns:
        rows = rows.withColumn("reg_ord", F.min("reg_ord").over(Window.partitionBy(key)))
    return rows.where("_n = 1").drop("_n")


def upsert(registry: DataFrame, new: DataFrame, seq: list[str], key: str = "key") -> DataFrame:
    return latest(registry.unionByName(new, allowMissingColumns=True), seq, key)


def overlay(seed: DataFrame, store: DataFrame, key: str = "key") -> DataFrame:
    """All keys of both; the store's entry counts where both have one."""
    rest = [c for c in seed.columns if c != key]
    own = F.col("b._there").isNotNull()
    both = seed.alias("a").join(store.withColumn("_there", F.lit(1)).alias("b"), key, "full_outer")
    return both.select(key, *[F.when(own, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in rest])


def by_content_id(texts: DataFrame, registry: DataFrame) -> DataFrame:
    """texts(query_id, t1_text) that name an entry's content id; the first entry of equal ids counts."""
    first = registry.withColumn("_n", F.row_number().over(Window.partitionBy("content_id").orderBy("reg_ord"))).where("_n = 1").drop("_n")
    return texts.join(first, texts["t1_text"] == first["content_id"])


def well_formed(rows: DataFrame, key: str = "key") -> DataFrame:
    """Entries whose key is a full hash."""
    return rows.where(F.col(key).rlike("^[0-9a-fA-F]{64}$"))
