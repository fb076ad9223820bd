"""Reading the driver's tables and collecting queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a query under its function's name, and the SQL that it must equal."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, pos, token: the parts of each text between white space."""
    words = F.filter(F.split("text", r"[ \t\n\r]+"), lambda w: w != "")
    return docs.select("doc_id", F.posexplode(words).alias("pos", "token"))


TOKENS = """tokens AS (SELECT doc_id, i - 1 AS pos, w[i] AS token FROM (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (
    SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '') AS w FROM documents)))"""
