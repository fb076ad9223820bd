"""The corpus pipeline: five stages, each of which works on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result to
the session's shared folder as Parquet and hands it to the next. Stages but the last return
the columns of documents, whatever their names. SQL can't express the whole (hyperdimensional
profiles, BM25 with verification, hashed permutations), so there is no ORACLE_SQL; a test
holds each stage against a plain version on a small table.

Defined cases, for all stages: an empty table gives an empty table; null ids, languages and
sources are values like others; extra columns are carried unchanged, or, in the last stage,
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.llm import decontam, jaccard, langid, mixing, suffix
from glyphlake.llm.common import fresh, materialise, table

ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told: null text, or no letter in it.

    Rows that stand twice both stay or both go. Without any known language nothing can be told, and all go.
    """
    names = fresh(docs, "lang"), fresh(docs, "score")
    langs, protos = langid.learn(docs)
    return langid.predict(docs, langs, protos, docs.columns, names).where(F.col(names[0]) != langid.UND).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each group that links of Jaccard similarity 0.8 connect.

    Documents without words are in no group and stay; rows equal in id and text count as one.
    """
    return jaccard.one_of_each(docs)


def repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts bytes that repeated 200-byte strings cover; documents of which no word is left go.

    A character torn by a cut goes with it. ``n_chars`` becomes that of the text that is left.
    Null texts have no words and go. Rows that stand twice lose all that windows cover.
    """
    cut = suffix.cleaned(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark; null and wordless texts hold none and stay."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes: one row a row, null texts with size 0."""
    return mixing.mix(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_bytes", repeated_bytes),
    ("benchmark_items", benchmark_items),
    ("mixture", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
