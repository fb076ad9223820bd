"""Luminance blocks as rows: texture, one cosine coefficient, quantisation and votes, all as column expressions.

A block is an array of 64 doubles, row by row.
"""

from __future__ import annotations

from math import cos, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import formats as K
from ..functions.numbers import round_up


def basis(u: int = K.COEFFICIENT[0], v: int = K.COEFFICIENT[1]) -> list[float]:
    """Weights of a block's cells in coefficient (u, v) of the orthonormal cosine transform."""
    scale = lambda k: sqrt(0.125) if k == 0 else 0.5
    return [scale(u) * scale(v) * cos((2 * x + 1) * u * pi / 16) * cos((2 * y + 1) * v * pi / 16) for x in range(8) for y in range(8)]


def folded(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def spread(block: Column) -> Column:
    """Population standard deviation."""
    mean = folded(block) / 64
    return F.sqrt(folded(F.transform(block, lambda x: (x - mean) * (x - mean))) / 64)


def coefficient(block: Column, u: int = K.COEFFICIENT[0], v: int = K.COEFFICIENT[1]) -> Column:
    return folded(F.zip_with(block, F.array(*map(F.lit, basis(u, v))), lambda x, w: x * w))


def embedded(c: Column, bit: Column, step: Column, margin: float | None = K.MARGIN) -> Column:
    """The coefficient moved to a level of the bit's parity; in the full band part of its residual stays."""
    level = round_up(c / step)
    residual = c - level * step
    level = F.when(F.pmod(level, F.lit(2)) == bit, level).otherwise(level + F.when(residual >= 0, 1).otherwise(-1))
    free = (step - F.lit(margin or 0.0)) / 2
    kept = F.greatest(-free, F.least(free, c - level * step))
    return level * step + F.when(step >= K.STEP, kept).otherwise(0.0)


def vote(c: Column, step: Column) -> Column:
    """Distance to the nearest odd level less that to the nearest even one: below 0 speaks for 1."""
    even = 2 * round_up(c / (2 * step)) * step
    odd = (2 * round_up((c - step) / (2 * step)) + 1) * step
    return F.abs(c - odd) - F.abs(c - even)


def position(index: Column, length: int) -> Column:
    return F.pmod(index, F.lit(length))


def soft_bits(blocks: DataFrame, length: int) -> DataFrame:
    """blocks(image_id, block_idx, v) to the bit at each position: image_id, pos, votes, bit."""
    votes = blocks.groupBy("image_id", position(F.col("block_idx"), length).alias("pos")).agg(F.sum("v").alias("votes"))
    return votes.withColumn("bit", F.when(F.col("votes") < 0, 1).otherwise(0))


def position_votes(blocks: DataFrame, length: int, texture: float = K.TEXTURE_EMBED) -> DataFrame:
    """blocks(image_id, block_idx, sigma) to image_id, eligible blocks, and the least eligible at any position."""
    ok = F.col("sigma") >= texture
    per = blocks.groupBy("image_id", position(F.col("block_idx"), length).alias("pos")).agg(F.count_if(ok).alias("n"))
    met = per.groupBy("image_id").agg(F.sum("n").alias("eligible"), F.min("n").alias("least"), F.count("*").alias("positions"))
    return met.select("image_id", "eligible", F.when(F.col("positions") < length, 0).otherwise(F.col("least")).alias("least"))


def placement(votes: DataFrame, length: int) -> DataFrame:
    """Textured blocks only where they can carry the whole stream, else both bands."""
    enough = (F.col("eligible") >= K.MIN_REPEATS * length) & (F.col("least") >= K.MIN_VOTES)
    return votes.withColumn("placement", F.when(enough, "selective").otherwise("dual"))


def psnr(squared: Column) -> Column:
    """Peak signal-to-noise ratio of a mean squared error; 99 without error."""
    return F.when(squared == 0, 99.0).otherwise(10 * F.log10(255.0 * 255.0 / squared))


_COS = np.cos((2 * np.arange(8)[None, :] + 1) * np.arange(8)[:, None] * np.pi / 16) * np.where(np.arange(8)[:, None] == 0, 8**-0.5, 0.5)


@F.pandas_udf(T.StructType([T.StructField(k, T.ArrayType(T.DoubleType())) for k in ("forward", "back")]))
def dct_pair(block: pd.Series) -> pd.DataFrame:
    """The orthonormal cosine transform of blocks of 8 by 8 values, and its inverse."""
    px = np.stack(block.to_list()).astype(float).reshape(-1, 8, 8) if len(block) else np.zeros((0, 8, 8))
    forward = _COS @ px @ _COS.T
    back = _COS.T @ forward @ _COS
    return pd.DataFrame({"forward": list(forward.reshape(-1, 64)), "back": list(back.reshape(-1, 64))})
