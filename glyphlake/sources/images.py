"""Pixels: decoding through Spark's image source, orientation, canonical size, and PNG encoding."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .. import formats as K
from ..operators.watermark import half_up, resized
from .containers import png_chunk


def read(spark: SparkSession, path: str) -> DataFrame:
    """origin, w, h, rgba of the images below a folder; files that can't be decoded are left out."""
    raw = spark.read.format("image").option("dropInvalid", "true").load(path).select("image.*")

    def run(frames):
        for pdf in frames:
            rows = []
            for r in pdf.itertuples():
                px = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
                rgba = np.full((r.height, r.width, 4), 255, np.uint8)
                rgba[..., :3] = px[..., 2::-1] if r.nChannels >= 3 else px
                if r.nChannels == 4:
                    rgba[..., 3] = px[..., 3]
                rows.append((r.origin, r.width, r.height, rgba.tobytes()))
            yield pd.DataFrame(rows, columns=["origin", "w", "h", "rgba"])

    return raw.mapInPandas(run, "origin string, w int, h int, rgba binary")


def oriented(rgba: np.ndarray, orientation: int) -> np.ndarray:
    """A raster as it is to be shown, for EXIF orientations 1 to 8; others change nothing."""
    turn = {3: 2, 6: 3, 8: 1, 5: 3, 7: 1}.get(orientation, 0)
    out = np.rot90(rgba, turn)
    if orientation in (2, 5, 7):
        out = out[:, ::-1]
    elif orientation == 4:
        out = out[::-1]
    return np.ascontiguousarray(out)


def canonical(rgba: np.ndarray) -> np.ndarray:
    """At canonical width, height a multiple of 8."""
    h, w = rgba.shape[:2]
    return resized(rgba, K.WIDTH, max(8, int(half_up(np.float64(h / w * K.WIDTH / 8))) * 8))


def to_png(rgba: np.ndarray) -> bytes:
    h, w = rgba.shape[:2]
    lines = np.concatenate([np.zeros((h, 1), np.uint8), rgba.reshape(h, w * 4)], axis=1)
    return K.PNG_SIGNATURE + png_chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + png_chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + png_chunk(b"IEND", b"")
