"""Verify mode: finding the exact text that a checksum vouches for among misread words."""

from __future__ import annotations

import re
import unicodedata
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import formats as K


def word_windows(lines: DataFrame, longest: int | None = None) -> DataFrame:
    """lines(doc, line, words array) to all runs of words: doc, line, start, stop, span.

    longest: most words in a window; None for all, which grows with the square of a line.
    """
    n = F.size("words")
    rows = lines.where(n > 0).select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("start"))
    last = n if longest is None else F.least(n, F.col("start") + longest)
    rows = rows.select("*", F.explode(F.sequence(F.col("start") + 1, last)).alias("stop"))
    return rows.select("doc", "line", "start", "stop", F.array_join(F.slice("words", F.col("start") + 1, F.col("stop") - F.col("start")), " ").alias("span"))


def readings(text: str):
    """What a text may have been: each of its confusable characters replaced or not, the first changing fastest, 4096 at most."""
    slots = [i for i, c in enumerate(text) if c in K.CONFUSIONS]
    chars = list(text)
    for mask in range(min(2 ** len(slots), K.CANDIDATES)):
        for s, i in enumerate(slots[:12]):
            chars[i] = K.CONFUSIONS[text[i]] if mask >> s & 1 else text[i]
        yield "".join(chars)


def exact_reading(text: str | None, expected: int) -> str | None:
    """The first reading's normal form (as a phone, or with white space joined) that has the expected CRC-32."""
    for reading in readings(text or ""):
        phone = re.sub("[^+0-9]", "", reading)
        if sum(c != "+" for c in phone) >= 8 and zlib.crc32(phone.encode()) == expected:
            return phone
        generic = " ".join(unicodedata.normalize("NFC", reading).split())
        if generic and zlib.crc32(generic.encode()) == expected:
            return generic
    return None


@F.pandas_udf(StringType())
def exact(span: pd.Series, expected: pd.Series) -> pd.Series:
    return pd.Series([exact_reading(s, e) for s, e in zip(span, expected)], dtype=object)


def search(windows: DataFrame, expected: Column) -> DataFrame:
    """The tightest window of each document of which a reading has the expected CRC-32; the first of equally tight ones."""
    rows = windows.withColumn("exact", exact("span", expected)).where("exact is not null")
    best = F.min_by(F.struct("line", "start", "stop", "span", "exact"), F.struct(F.col("stop") - F.col("start"), F.col("line"), F.col("start")))
    return rows.groupBy("doc").agg(best.alias("b")).select("doc", "b.*")


def joined_box(words: DataFrame, width: Column, height: Column) -> DataFrame:
    """words(doc, pos, x0, y0, x1, y1, start, stop) of a window to its box in percent."""
    own = words.where("pos >= start and pos < stop").groupBy("doc", "start", "stop").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    pct = lambda v, size: F.floor(100 * v / size * 100 + 0.5) / 100
    return own.select("doc", "start", "stop", pct(F.col("x0"), width).alias("x"), pct(F.col("y0"), height).alias("y"), pct(F.col("x1") - F.col("x0"), width).alias("w"), pct(F.col("y1") - F.col("y0"), height).alias("h"))
