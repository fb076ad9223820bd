"""Watermarks in rasters: 16 or 6 bytes in one cosine coefficient of each 8 by 8 luminance block, in numpy.

Rasters are (height, width, 4) uint8 arrays with sides that are multiples of 8.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .. import formats as K
from ..functions import codes
from .blocks import basis

_WEIGHTS = np.array(basis()).reshape(8, 8)


def luma(rgba: np.ndarray) -> np.ndarray:
    return rgba[..., :3].astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def cut(plane: np.ndarray) -> np.ndarray:
    """Blocks of a plane in row order, n by 8 by 8."""
    h, w = (n // 8 for n in plane.shape)
    return plane[: h * 8, : w * 8].reshape(h, 8, w, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)


def pasted(blocks: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    h, w = (n // 8 for n in shape)
    return blocks.reshape(h, w, 8, 8).transpose(0, 2, 1, 3).reshape(h * 8, w * 8)


def half_up(x: np.ndarray) -> np.ndarray:
    return np.floor(x + 0.5)


def _moved(c: np.ndarray, bits: np.ndarray, step: float, free: float) -> np.ndarray:
    """Coefficients brought to a level of the bits' parity, residuals kept up to ``free``."""
    level = half_up(c / step)
    wrong = np.mod(level, 2) != bits
    level = level + np.where(wrong, np.where(c - level * step >= 0, 1, -1), 0)
    return level * step + np.clip(c - level * step, -free, free)


def votes(c: np.ndarray, step: float) -> np.ndarray:
    even = 2 * half_up(c / (2 * step)) * step
    odd = (2 * half_up((c - step) / (2 * step)) + 1) * step
    return np.abs(c - odd) - np.abs(c - even)


def coefficients(plane: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The carrying coefficient and the spread of each block."""
    b = cut(plane)
    return np.tensordot(b, _WEIGHTS, 2), b.std(axis=(1, 2))


def placement(spread: np.ndarray, length: int) -> str:
    textured = spread >= K.TEXTURE_EMBED
    per = np.bincount(np.arange(len(spread)) % length, textured, length)
    return "selective" if textured.sum() >= K.MIN_REPEATS * length and per.min() >= K.MIN_VOTES else "dual"


def embed(rgba: np.ndarray, payload: bytes) -> tuple[np.ndarray, dict]:
    """The marked raster, and its placement and block counts."""
    out, bits = rgba.copy(), codes.stream(payload)
    _, spread = coefficients(luma(rgba))
    rough, own = spread >= K.TEXTURE_EMBED, bits[np.arange(len(spread)) % len(bits)]
    how = placement(spread, len(bits))
    h, w = (n // 8 * 8 for n in rgba.shape[:2])
    for _ in range(K.PASSES):
        c, _ = coefficients(luma(out))
        goal = np.where(rough, _moved(c, own, K.STEP, (K.STEP - K.MARGIN) / 2), c if how == "selective" else _moved(c, own, K.SMOOTH_STEP, 0.0))
        change = pasted((goal - c)[:, None, None] * _WEIGHTS, (h, w))
        out[:h, :w, :3] = half_up(np.clip(out[:h, :w, :3] + change[..., None], 0, 255)).astype(np.uint8)
    return out, {"placement": how, "marked": int(len(spread) if how == "dual" else rough.sum()), "blocks": len(spread)}


def extract(rgba: np.ndarray, length: int = K.CAPACITY, mode: str = "correct") -> bytes | None:
    """The payload, or None: votes of textured blocks, of both bands, then of all blocks at full step are tried."""
    c, spread = coefficients(luma(rgba))
    n = codes.stream_length(length)
    at, rough = np.arange(len(c)) % n, spread >= K.TEXTURE_DECODE
    full = votes(c, K.STEP)
    for v in (np.where(rough, full, 0.0), np.where(spread >= K.TEXTURE_EMBED, full, votes(c, K.SMOOTH_STEP)), full):
        found = codes.unstream((np.bincount(at, v, n) < 0).astype(np.uint8), length, mode)
        if found is not None:
            return found
    return None


def psnr(a: np.ndarray, b: np.ndarray) -> float:
    error = ((a[..., :3].astype(float) - b[..., :3]) ** 2).mean()
    return 99.0 if error == 0 else float(10 * np.log10(255**2 / error))


# --- attacks ---

_T = np.array([[np.sqrt((1 if k == 0 else 2) / 8) * np.cos((2 * x + 1) * k * np.pi / 16) for x in range(8)] for k in range(8)])
# The JPEG standard's example luminance table
_JPEG = np.array([16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99]).reshape(8, 8)


def like_jpeg(rgba: np.ndarray, quality: int) -> np.ndarray:
    """Block transform and quantisation of each channel as JPEG's luminance at a quality; no entropy coding."""
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    table = np.clip(np.floor((_JPEG * scale + 50) / 100), 1, 255)
    out = rgba.copy()
    h, w = (n // 8 * 8 for n in rgba.shape[:2])
    for ch in range(3):
        d = _T @ (cut(rgba[:h, :w, ch].astype(float)) - 128) @ _T.T
        out[:h, :w, ch] = np.clip(half_up(pasted(_T.T @ (half_up(d / table) * table) @ _T, (h, w)) + 128), 0, 255)
    return out


def resized(rgba: np.ndarray, width: int, height: int) -> np.ndarray:
    """By area where it shrinks, linearly where it grows."""

    def weights(n: int, to: int) -> np.ndarray:
        if to < n:
            edge, at = np.arange(to + 1) * n / to, np.arange(n)
            part = np.clip(np.minimum(edge[1:, None], at + 1) - np.maximum(edge[:-1, None], at), 0, None)
        else:
            place = np.clip((np.arange(to) + 0.5) * n / to - 0.5, 0, n - 1)
            part = np.clip(1 - np.abs(place[:, None] - np.arange(n)), 0, None)
        return part / part.sum(axis=1, keepdims=True)

    a, b = weights(rgba.shape[0], height), weights(rgba.shape[1], width)
    return np.clip(half_up(np.einsum("ij,jkc,lk->ilc", a, rgba.astype(float), b, optimize=True)), 0, 255).astype(np.uint8)


def noisy(rgba: np.ndarray, sigma: float = 2.0, seed: int = 0) -> np.ndarray:
    out = rgba.copy()
    out[..., :3] = np.clip(half_up(rgba[..., :3] + np.random.default_rng(seed).normal(0, sigma, rgba[..., :3].shape)), 0, 255)
    return out


ATTACKS = {
    "none": lambda r: r,
    "jpeg85": lambda r: like_jpeg(r, 85),
    "jpeg75": lambda r: like_jpeg(r, 75),
    "jpeg60": lambda r: like_jpeg(r, 60),
    "jpeg40": lambda r: like_jpeg(r, 40),
    "twice": lambda r: like_jpeg(like_jpeg(r, 75), 70),
    "down900": lambda r: resized(resized(r, 900, 900 * r.shape[0] // r.shape[1]), r.shape[1], r.shape[0]),
    "screenshot": lambda r: noisy(resized(resized(r, r.shape[1] * 85 // 100, r.shape[0] * 85 // 100), r.shape[1], r.shape[0])),
}


# --- tables of rasters ---


def _raster(row) -> np.ndarray:
    return np.frombuffer(row.rgba, np.uint8).reshape(row.h, row.w, 4)


def embed_table(rasters: DataFrame) -> DataFrame:
    """rasters(image_id, w, h, rgba, payload): the same with marks, and placement, marked, blocks, psnr. A null payload leaves the raster as it is."""

    def run(frames):
        for pdf in frames:
            rows = []
            for row in pdf.itertuples():
                before = _raster(row)
                after, told = embed(before, row.payload) if row.payload is not None else (before, {"placement": None, "marked": 0, "blocks": 0})
                rows.append((row.image_id, row.w, row.h, after.tobytes(), told["placement"], told["marked"], told["blocks"], psnr(before, after)))
            yield pd.DataFrame(rows, columns=["image_id", "w", "h", "rgba", "placement", "marked", "blocks", "psnr"])

    return rasters.mapInPandas(run, "image_id long, w int, h int, rgba binary, placement string, marked int, blocks int, psnr double")


def extract_table(rasters: DataFrame, length: int = K.CAPACITY, mode: str = "correct") -> DataFrame:
    """rasters(image_id, w, h, rgba) to image_id and the payload found, or null."""

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({"image_id": pdf["image_id"], "payload": [extract(_raster(row), length, mode) for row in pdf.itertuples()]})

    return rasters.mapInPandas(run, "image_id long, payload binary")


def attack_table(rasters: DataFrame, names: list[str]) -> DataFrame:
    """Each raster under each attack: image_id, attack, w, h, rgba."""

    def run(frames):
        for pdf in frames:
            for row in pdf.itertuples():
                yield pd.DataFrame([(row.image_id, a, row.w, row.h, ATTACKS[a](_raster(row)).tobytes()) for a in names], columns=["image_id", "attack", "w", "h", "rgba"])

    return rasters.select("image_id", "w", "h", "rgba").mapInPandas(run, "image_id long, attack string, w int, h int, rgba binary")
