"""Repeated windows: which windows of ``width`` tokens start at more than one place of a corpus.

Equal windows are found by passes over ever longer digits of the suffixes, as a radix sort
from the most significant digit does; a suffix whose bucket holds no other is dropped.

1. First digit: ``gram`` tokens. Not every suffix needs a row here. Each window takes the
   smallest hash among the grams inside it (the leftmost of equals), which depends on the
   window's content alone, so equal windows take equal grams at equal offsets. Windows in
   succession that take the same gram form a run, and a row is made for each run, about
   2/(width-gram) of the tokens.
2. Next digits: a run is cut into parts of ``parts`` windows, at fixed offsets from the gram,
   and a part's digit is the tokens that all its windows share (width-part+1 of them). The
   last part size is 1, where the digit is the whole window.

In each pass a bucket of one row holds no repeated window and goes. Where all rows of a
bucket have the same tokens, or some rows of it do, those rows' windows are repeated and
done. One row of each kind in a mixed bucket goes on to the next pass.

Buckets are only counted, with partial sums before each shuffle; no group is collected. Rows
meet the few largest buckets without a shuffle.
Digits are 64-bit hashes, the last one is of 128 bits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, byte_buffer, discard, matched, materialise, mix64, possible, powers, word_hashes

BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
INVERSE = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in BASE)
SEGMENT = 1 << 20  # windows worked on at a time
PLACE = np.uint64((1 << 24) - 1)
CHARS = 1 << 21


@dataclass(frozen=True)
class Grain:
    """Tokens are bytes or words; a window is ``width`` of them, a first digit ``gram``."""

    kind: str
    width: int
    gram: int
    parts: tuple[int, ...] = (1,)

    def tokens(self, texts) -> tuple[np.ndarray, np.ndarray]:
        if self.kind == "bytes":
            return byte_buffer(texts)
        return word_hashes(texts)[:2]

    def values(self, tokens: np.ndarray, lane: int) -> np.ndarray:
        return mix64(tokens.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019 * (lane + 1) & (2**64 - 1))) if self.kind == "words" else _BYTE_VALUES[lane][tokens]


_BYTE_VALUES = [mix64(np.arange(256, dtype=np.uint64) + np.uint64(1000 * (lane + 1))) for lane in (0, 1)]


class Prefixes:
    """Polynomial hashes of any part of a token array, modulo 2**64."""

    def __init__(self, values: np.ndarray, lane: int = 0):
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(BASE[lane], len(values))[: len(values)], out=self.sums[1:])
        self.back = powers(INVERSE[lane], len(values) + 1)

    def of(self, lo, hi) -> np.ndarray:
        return mix64((self.sums[hi] - self.sums[lo]) * self.back[lo])


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of every n neighbours."""
    size = 1
    while size * 2 <= n:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def runs(tokens: np.ndarray, bounds: np.ndarray, grain: Grain):
    """lo, hi (first and last window of each run, as places in ``tokens``), the gram's place, its hash, the run's tokens' hash."""
    out = []
    width, gram = grain.width, grain.gram
    for s in range(0, max(0, len(tokens) - width + 1), SEGMENT):
        part = tokens[s : s + SEGMENT + width - 1]
        n = len(part) - width + 1
        end = bounds[np.searchsorted(bounds, np.arange(s, s + n), side="right")]
        ok = np.flatnonzero(np.arange(s, s + n) + width <= end)
        if not len(ok):
            continue
        p = Prefixes(grain.values(part, 0))
        at = np.arange(len(part) - gram + 1)
        h = p.of(at, at + gram)
        took = (sliding_min((h & ~PLACE) | at.astype(np.uint64), width - gram + 1) & PLACE).astype(np.int64)[ok]
        new = np.flatnonzero(np.concatenate([[True], (took[1:] != took[:-1]) | (ok[1:] != ok[:-1] + 1)]))
        lo, hi = ok[new], ok[np.append(new[1:], len(ok)) - 1]
        out.append((lo + s, hi + s, took[new] + s, h[took[new]], p.of(lo, hi + width)))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2


def ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo, lo+1, ..., lo+n-1 for each pair, one after another."""
    return np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())


def cut(lo: np.ndarray, n: np.ndarray, off: np.ndarray, part: int):
    """Runs (first window, number of windows, gram's place less lo) cut into parts: the same three, and the part's number."""
    last = (off - n + 1) // part
    count = off // part - last + 1
    run = np.repeat(np.arange(len(lo)), count)
    number = ranges(last, count)
    gram = (lo + off)[run]
    first = np.maximum(lo[run], gram - number * part - part + 1)
    end = np.minimum((lo + n)[run], gram - number * part + 1)
    return first, end - first, gram - first, number


def digits(tokens: np.ndarray, grain: Grain, lo, n, off, number, part: int):
    """The digit of each part and a hash of all its tokens (of the digit again, by another base, where the part is one window)."""
    h, whole = np.zeros(len(lo), np.uint64), np.zeros(len(lo), np.uint64)
    gram, order = lo + off, np.argsort(lo, kind="stable")
    reach = grain.width + max(part, grain.width)
    for s in range(0, len(tokens), SEGMENT):
        a, b = np.searchsorted(lo[order], [s, s + SEGMENT])
        if b > a:
            own = order[a:b]
            begin = max(0, s - part)
            piece = tokens[begin : s + SEGMENT + reach]
            p = Prefixes(grain.values(piece, 0))
            core = gram[own] - number[own] * part - part + 1 - begin
            shared = core + part - 1, core + grain.width
            h[own] = mix64(p.of(*shared) + number[own].astype(np.uint64))
            if part > 1:
                whole[own] = p.of(lo[own] - begin, (lo + n)[own] - begin + grain.width - 1)
            else:
                whole[own] = Prefixes(grain.values(piece, 1), 1).of(*shared)
    return h, whole


FOUND = ["rid", "lo", "n", "h", "whole"]
ROWS = "rid long, lo long, n int, off int, h long, whole long"


def _rows(rid, bounds, lo, n, off, h, whole) -> pd.DataFrame:
    d = np.searchsorted(bounds, lo, side="right") - 1
    return pd.DataFrame({"rid": rid.to_numpy()[d], "lo": lo - bounds[d], "n": n.astype(np.int32), "off": off.astype(np.int32), "h": h.view(np.int64), "whole": whole.view(np.int64)})


def covered(size: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Marks the tokens lo to hi-1 of each pair."""
    step = np.zeros(size + 1, np.int32)
    np.add.at(step, lo, 1)
    np.add.at(step, hi, -1)
    return np.cumsum(step[:-1]) > 0


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and rid, a hash of both: rows that share it are equal and get equal results."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rid"))


def run_rows(docs: DataFrame, grain: Grain) -> DataFrame:
    def make(frames):
        for pdf in batches(frames, CHARS):
            tokens, bounds = grain.tokens(pdf["text"])
            lo, hi, gram, h, whole = runs(tokens, bounds, grain)
            yield _rows(pdf["rid"], bounds, lo, hi - lo + 1, gram - lo, h, whole)

    return docs.select("rid", "text").mapInPandas(make, ROWS)


def part_rows(docs: DataFrame, grain: Grain, part: int) -> DataFrame:
    """docs(rid, text, at array<struct<lo,n,off>>) to a row for each part of its runs."""

    def make(frames):
        for pdf in batches(frames, CHARS):
            tokens, bounds = grain.tokens(pdf["text"])
            given = np.array([(x["lo"] + b, x["n"], x["off"]) for b, at in zip(bounds, pdf["at"]) for x in at], np.int64).reshape(-1, 3)
            lo, n, off, number = cut(*given.T, part)
            yield _rows(pdf["rid"], bounds, lo, n, off, *digits(tokens, grain, lo, n, off, number, part))

    return docs.select("rid", "text", "at").mapInPandas(make, ROWS)


def one_pass(rows: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Repeated rows (rid, lo, n, and h, whole: rows that share both are equal), the rows that go on (rid, lo, n, off), and the tables written for them."""
    rows = materialise(rows, "repeat-rows")
    buckets = rows.groupBy("h").agg(F.count("*").alias("c"), F.min("whole").alias("a"), F.max("whole").alias("b"))
    buckets = materialise(buckets.where("c > 1").select("h", "c", (F.col("a") == F.col("b")).alias("same")), "repeat-buckets")
    near = possible(rows, buckets, "h")
    discard(rows)
    hit = materialise(matched(near, buckets, ["h"], "c", floor=2), "repeat-hits")
    discard(near)
    mixed = hit.where("not same")
    kinds = mixed.groupBy("h", "whole").agg(F.count("*").alias("c"), F.min(F.struct("rid", "lo", "n", "off")).alias("one"))
    kinds = materialise(kinds, "repeat-kinds")
    twice = matched(mixed, kinds.where("c > 1").select("h", "whole", "c"), ["h", "whole"], "c")
    return hit.where("same").select(*FOUND).unionByName(twice.select(*FOUND)), kinds.select("one.*"), [buckets, hit, kinds]


def places(docs: DataFrame, grain: Grain) -> tuple[DataFrame, list[DataFrame]]:
    """docs of ``keyed`` to every repeated place: rid, lo, n (windows lo to lo+n-1), and h, whole: places that share both hold equal tokens.

    Also the tables that it is read from, to be discarded once it is written."""
    found, rest, tables = one_pass(run_rows(docs, grain))
    for part in grain.parts:
        at = rest.groupBy("rid").agg(F.collect_list(F.struct("lo", "n", "off")).alias("at"))
        more, rest, written = one_pass(part_rows(docs.join(at, "rid"), grain, part))
        found, tables = found.unionByName(more), tables + written
    return found, tables


def repeated(docs: DataFrame, grain: Grain) -> DataFrame:
    """docs of ``keyed`` to rid and spans, array<struct<lo,n>>: windows lo to lo+n-1 are repeated."""
    return places(docs, grain)[0].groupBy("rid").agg(F.collect_list(F.struct("lo", "n")).alias("spans"))
