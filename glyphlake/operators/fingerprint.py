"""Perceptual fingerprints and their similarity search.

A hash is an array of 32-bit words held as BIGINT, first word first, highest bit first.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import formats as K

WORD = 32
WORDS = 8  # words that are compared without a loop
NESTED_ROWS = 20_000  # registries up to this many rows are compared whole
SPARSE = 1 / 32  # of all pairs, what an index may visit
MEET, LOTS, BLOCK = 1 << 11, 256, 1 << 16  # queries that meet a block of so many entries; from LOTS lots of queries on, lots grow
CELLS, SIDE = 1 << 19, 64  # pairs compared at a time, and queries among them
ROWS = 1 << 16
WHOLE = 1 << 20  # registries up to this many rows are met whole by each lot
HELD = 1 << 21  # near pairs that a lot keeps at a time, of several queries


def median_words(values: Column, count: int) -> Column:
    """A bit for each value above the median of all but the first: the lower middle element, as a discrete median."""

    def words(values: Column, middle: Column) -> Column:
        return F.array(*[F.aggregate(F.slice(values, WORD * k + 1, WORD), F.lit(0).cast("long"), lambda h, v: h * 2 + F.when(v > middle, 1).otherwise(0)) for k in range(count // WORD)])

    once = lambda x, f: F.transform(F.array(x), f)[0]  # noqa: E731  else the list is made and sorted anew for each of its values
    return once(values, lambda v: once(F.array_sort(F.slice(v, 2, count - 1))[(count - 2) // 2], lambda m: words(v, m)))


def words_hex(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: F.lpad(F.lower(F.hex(w)), 8, "0")), "")


def distance(a: Column, b: Column) -> Column:
    """Hamming distance; null where a hash is missing or the sizes differ."""
    word = lambda k: F.coalesce(F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))), F.lit(0))
    rest = F.aggregate(F.zip_with(F.slice(a, WORDS + 1, 1 << 20), F.slice(b, WORDS + 1, 1 << 20), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    both = reduce(lambda x, y: x + y, [word(k) for k in range(WORDS)]) + F.when(F.size(a) > WORDS, rest).otherwise(0)
    return F.when(F.size(a) == F.size(b), both)


_BASIS = np.cos((2 * np.arange(K.GRID)[None, :] + 1) * np.arange(K.LOW)[:, None] * np.pi / (2 * K.GRID))


def phash_words(grey: np.ndarray) -> np.ndarray:
    """n rasters of 32 by 32 grey values to n rows of 8 words: low cosine coefficients above their median."""
    low = (_BASIS @ grey.reshape(-1, K.GRID, K.GRID) @ _BASIS.T).reshape(len(grey), -1)
    middle = np.sort(low[:, 1:], axis=1)[:, (low.shape[1] - 2) // 2]
    return np.packbits(low > middle[:, None], axis=1).view(">u4").astype(np.int64)


@F.pandas_udf(T.ArrayType(T.LongType()))
def phash(grey: pd.Series) -> pd.Series:
    """Of 1 024 grey values; null for any other number of them."""
    out = pd.Series([None] * len(grey), index=grey.index, dtype=object)
    ok = grey.map(lambda g: g is not None and len(g) == K.GRID**2)
    if ok.any():
        out[ok] = pd.Series(list(phash_words(np.stack(grey[ok].to_list()).astype(float))), index=grey.index[ok])
    return out


def shrunk(plane: np.ndarray, size: int = K.GRID) -> np.ndarray:
    """A grey plane brought to size by size: halved by boxes of two while twice as large, then averaged by area."""
    while min(plane.shape) >= 4 * size:
        h, w = (n // 2 * 2 for n in plane.shape)
        plane = plane[:h, :w].reshape(h // 2, 2, w // 2, 2).mean(axis=(1, 3))

    def weights(n: int) -> np.ndarray:
        edge = np.arange(size + 1) * n / size
        at = np.arange(n)
        part = np.clip(np.minimum(edge[1:, None], at + 1) - np.maximum(edge[:-1, None], at), 0, None)
        return part / part.sum(axis=1, keepdims=True)

    return weights(plane.shape[0]) @ plane @ weights(plane.shape[1]).T


def region_box(bounds: dict, width: int, height: int) -> tuple[int, int, int, int]:
    """Pixel box of percentage bounds with the format's padding, inside the image: left, top, right, bottom."""
    up = lambda v: int(np.floor(v + 0.5))
    left = max(0, up((bounds["x"] / 100 - K.PAD_X) * width))
    top = max(0, up((bounds["y"] / 100 - K.PAD_Y) * height))
    right = min(width, left + max(1, up((bounds["w"] / 100 + 2 * K.PAD_X) * width)))
    bottom = min(height, top + max(1, up((bounds["h"] / 100 + 2 * K.PAD_Y) * height)))
    return left, top, max(right, left + 1), max(bottom, top + 1)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.LongType())))
def region_phash(grey: pd.Series, width: pd.Series, height: pd.Series, regions: pd.Series) -> pd.Series:
    """Hashes of a grey raster's regions (percentage bounds), one for each; null for a null raster, regions or region."""

    def one(g, w, h, boxes):
        if g is None or boxes is None or not w or not h:
            return None
        plane = np.asarray(g, float).reshape(int(h), int(w))
        cut = [None if b is None else region_box(b, int(w), int(h)) for b in boxes]
        return [None if c is None else phash_words(shrunk(plane[c[1] : c[3], c[0] : c[2]])[None])[0] for c in cut]

    return pd.Series([one(*r) for r in zip(grey, width, height, regions)], index=grey.index, dtype=object)


LOT = 64  # candidates of a query whose regions are hashed in one visit of its raster


def region_checked(found: DataFrame, rasters: DataFrame) -> DataFrame:
    """Candidates found(query_id, key, rank, region, region_hash, ...) with rdist: how far the query's own
    raster, hashed within the candidate's bounds, is from the candidate's region hash.

    rasters(query_id, grey, width, height). rdist is null where the candidate has no region or
    the query no raster. A raster travels once for each LOT candidates, not for each.
    """
    with_region = found.where("region is not null and region_hash is not null")
    lots = with_region.groupBy("query_id", F.floor(F.col("rank") / LOT).alias("lot")).agg(F.collect_list(F.struct("key", "region", "region_hash")).alias("c"))
    seen = lots.join(rasters.select("query_id", "grey", "width", "height"), "query_id")
    seen = seen.select("query_id", "c", region_phash("grey", "width", "height", F.col("c.region")).alias("own"))
    each = seen.select("query_id", F.explode(F.arrays_zip("c", "own")).alias("e"))
    near = each.select("query_id", F.col("e.c.key").alias("key"), distance(F.col("e.c.region_hash"), F.col("e.own")).alias("rdist"))
    return found.join(near, ["query_id", "key"], "left")


def masks(bits: int, radius: int) -> list[int]:
    return [reduce(lambda a, b: a | 1 << b, c, 0) for r in range(radius + 1) for c in combinations(range(bits), r)]


def packed(rows: DataFrame, parts: int, name: str, *by: str) -> DataFrame:
    """Rows with a hash, dealt to ``parts`` tables (by some columns, if named) of Arrow's stream format in the binary column ``name``."""

    def run(batches):
        own = [b for b in batches if b.num_rows]
        if own:
            table = pa.Table.from_batches(own)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], [name])

    return rows.where("hash is not null").repartition(parts, *by).mapInArrow(run, f"{name} binary")


def unpacked(raw) -> pa.Table:
    with pa.ipc.open_stream(raw) as stream:
        return stream.read_all().combine_chunks()


def by_size(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places of the rows whose hashes have n words, and the words, for each n. A hash that lacks a word is left out."""
    lists = table["hash"].combine_chunks()
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values = lists.flatten()
    known = np.add.reduceat(np.append(values.is_valid().to_numpy(zero_copy_only=False), False), np.cumsum(size) - size, dtype=np.int64) if len(size) else size
    words, row = values.fill_null(0).to_numpy(zero_copy_only=False), np.repeat(np.arange(len(size)), size)
    out = {}
    for n in np.unique(size[(size > 0) & (known == size)]):
        ok = (size == n) & (known == n)
        out[int(n)] = np.flatnonzero(ok), words[ok[row]].astype(np.uint64).reshape(-1, n)
    return out


def joined_words(w: np.ndarray) -> list[np.ndarray]:
    """Columns of 64 bits, two words in each."""
    w = w if w.shape[1] % 2 == 0 else np.pad(w, ((0, 0), (0, 1)))
    return list(np.ascontiguousarray((w[:, 0::2] << np.uint64(WORD) | w[:, 1::2]).T))


def compared(q: np.ndarray, e: np.ndarray, within: int):
    """Lots of (query, entry, distance) for all pairs of hashes within a distance; a query's pairs are in one lot."""
    qw, ew = joined_words(q), joined_words(e)
    for s in range(0, len(q), SIDE):
        found = []
        for t in range(0, len(e), CELLS // SIDE):
            dist = sum(np.bitwise_count(a[s : s + SIDE, None] ^ b[None, t : t + CELLS // SIDE]).astype(np.int16 if len(qw) > 3 else np.uint8, copy=False) for a, b in zip(qw, ew))
            at = np.flatnonzero(dist.ravel() <= within)
            i, j = np.divmod(at, dist.shape[1])
            found.append((i + s, j + t, dist.ravel()[at].astype(np.int32)))
        yield tuple(map(np.concatenate, zip(*found)))


def probed(q: np.ndarray, e: np.ndarray, within: int, bits: int):
    """The same by equal chunks of ``bits`` bits: some chunk of such a pair differs by within/chunks bits at most.

    Each pair is told by the first chunk that is near enough."""
    per, low = WORD // bits, np.uint64((1 << bits) - 1)
    cut = lambda w: [(w[:, k] >> np.uint64(WORD - bits * (j + 1)) & low).astype(np.int64) for k in range(w.shape[1]) for j in range(per)]
    qc, ec, qw, ew = cut(q), cut(e), joined_words(q), joined_words(e)
    radius = within // len(qc)
    near = np.array(masks(bits, radius), np.int64)
    index = []
    for c in ec:
        order = np.argsort(c, kind="stable")
        index.append((order, np.searchsorted(c[order], np.arange((1 << bits) + 1)), [w[order] for w in ew]))
    step = max(1, min(CELLS // len(near), SIDE * BLOCK // max(1, len(e))))
    for s in range(0, len(q), step):
        found = []
        for no, (order, start, words) in enumerate(index):
            probe = qc[no][s : s + step, None] ^ near
            lo, n = start[probe].ravel(), (start[probe + 1] - start[probe]).ravel()
            who = np.repeat(np.arange(s, min(s + step, len(q))), len(near))
            cuts = np.flatnonzero(np.diff(np.cumsum(n) // CELLS)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(n)]):
                total = int(n[a:b].sum())
                at = np.repeat(lo[a:b] - np.cumsum(n[a:b]) + n[a:b], n[a:b]) + np.arange(total)
                i = np.repeat(who[a:b], n[a:b])
                dist = sum(np.bitwise_count(x[i] ^ y[at]).astype(np.int32) for x, y in zip(qw, words))
                ok = np.flatnonzero(dist <= within)
                i, j, dist = i[ok], order[at[ok]], dist[ok]
                told = np.zeros(len(i), bool)
                for x, y in zip(qc[:no], ec[:no]):
                    told |= np.bitwise_count(x[i] ^ y[j]) <= radius
                found.append((i[~told], j[~told], dist[~told]))
        if found:
            yield tuple(map(np.concatenate, zip(*found)))


def foremost(i: np.ndarray, j: np.ndarray, dist: np.ndarray, most: int):
    """The first pairs of each query by distance and place of the entry."""
    at = np.lexsort((j, dist, i))
    at = at[np.arange(len(at)) - np.searchsorted(i[at], i[at]) < most]
    return i[at], j[at], dist[at]


def way(method: str, entries: int, within: int, count: int, bits: int) -> str:
    """How a meeting finds its pairs. nested compares all pairs, index those with a chunk of ``bits`` bits in common or
    nearly so; auto takes the index for a registry over NESTED_ROWS rows, if it leaves out most pairs."""
    if method != "auto":
        return method
    visited = count // bits * len(masks(bits, within // max(1, count // bits))) / 2**bits if entries > NESTED_ROWS else 1
    return "index" if visited < SPARSE else "nested"


def by_reg_ord(table: pa.Table) -> pa.Table:
    """Entries in their order."""
    return table.take(pc.sort_indices(table["reg_ord"], null_placement="at_start")).combine_chunks()


def told(q: pa.Table, i: np.ndarray, e: pa.Table, j: np.ndarray, **numbers: np.ndarray):
    """Batches of query_id, the entry's columns and some numbers for places i of queries and j of entries."""
    rest = e.select([c for c in e.column_names if c != "hash"])
    for s in range(0, len(i), ROWS):
        own, other = q["query_id"].take(pa.array(i[s : s + ROWS])), rest.take(pa.array(j[s : s + ROWS]))
        columns = [own.combine_chunks(), *[c.combine_chunks() for c in other.columns], *[pa.array(x[s : s + ROWS].astype(np.int32)) for x in numbers.values()]]
        yield pa.RecordBatch.from_arrays(columns, ["query_id", *rest.column_names, *numbers])


def told_schema(queries: DataFrame, registry: DataFrame, *numbers: str) -> T.StructType:
    rest = [registry.schema[c] for c in registry.columns if c not in ("key", "hash")]
    return T.StructType([queries.schema["query_id"], registry.schema["key"], *rest, *[T.StructField(x, T.IntegerType()) for x in numbers]])


def pairs(queries: DataFrame, registry: DataFrame, within: int = K.MATCH, count: int = 256, method: str = "auto", bits: int = 16, most: int | None = None) -> DataFrame:
    """queries(query_id, hash), registry(key, reg_ord, hash, ...) to query_id, the registry's columns but the hash, and dist, for all pairs with dist <= within.

    Lots of queries meet blocks of the registry, and only what is near enough leaves a meeting. method: see ``way``.
    most: no more than so many leave a meeting for each query, the first by distance and reg_ord.
    """
    entries = registry.count()
    method = way(method, entries, within, count, bits)
    lots = packed(queries.select("query_id", "hash"), min(-(-queries.count() // MEET) or 1, LOTS), "lot")
    blocks = packed(registry.select("key", *[c for c in registry.columns if c != "key"]), -(-entries // BLOCK) or 1, "block")

    def run(batches):
        for batch in batches:
            for lot, block in zip(batch["lot"], batch["block"]):
                q, e = unpacked(lot.as_buffer()), by_reg_ord(unpacked(block.as_buffer()))
                asked, known = by_size(q), by_size(e)
                for size in asked.keys() & known.keys():
                    (qi, qw), (ei, ew) = asked[size], known[size]
                    for i, j, dist in compared(qw, ew, within) if method == "nested" else probed(qw, ew, within, bits):
                        if most is not None:
                            i, j, dist = foremost(i, j, dist, most)
                        yield from told(q, qi[i], e, ei[j], dist=dist)

    return lots.crossJoin(blocks).mapInArrow(run, told_schema(queries, registry, "dist"))


def in_order(group: np.ndarray, qw: np.ndarray, ew: np.ndarray, within: int, method: str, bits: int):
    """All near pairs of queries (in order of their group) and entries, as lots of (query, entry, distance, rank): a
    group's pairs are in one lot, in order of distance and entry. At most about HELD are kept at a time, or those of one group."""
    first = np.flatnonzero(np.diff(group, prepend=-1))
    edge, waiting = np.append(first, len(group)), [(0, len(first))]
    while waiting:
        a, b = waiting.pop()
        lo, hi = edge[a], edge[b]
        kept, held = [], 0
        for s in range(0, len(ew), BLOCK):
            part = ew[s : s + BLOCK]
            for i, j, dist in compared(qw[lo:hi], part, within) if method == "nested" else probed(qw[lo:hi], part, within, bits):
                kept.append((i.astype(np.int32), (j + s).astype(np.int32), dist.astype(np.int16)))
                held += len(i)
                if held > HELD and b - a > 1:
                    break
            if held > HELD and b - a > 1:
                break
        if held > HELD and b - a > 1:
            waiting += [((a + b) // 2, b), (a, (a + b) // 2)]
        elif held:
            i, j, dist = (np.concatenate(x) for x in zip(*kept))
            del kept
            own = group[lo:hi][i]
            order = np.lexsort((j, dist, own))
            own = own[order]
            yield i[order] + lo, j[order], dist[order], np.arange(len(own)) - np.searchsorted(own, own) + 1


def ranked(queries: DataFrame, registry: DataFrame, entries: int, within: int, method: str, bits: int) -> DataFrame:
    """``pairs`` with rank, for a registry that a task can hold: each lot meets all of it, so that its pairs are ranked where they are found and none is sent."""
    lots = packed(queries.select("query_id", "hash"), min(-(-queries.count() // MEET) or 1, LOTS), "lot", "query_id")
    blocks = packed(registry.select("key", *[c for c in registry.columns if c != "key"]), -(-entries // BLOCK) or 1, "block")

    def meetings(batches):
        lot, blocks = None, []
        for batch in batches:
            for own, block in zip(batch["lot"], batch["block"]):
                own = own.as_buffer()
                if lot is not None and not own.equals(lot):
                    yield lot, blocks
                    blocks = []
                lot, blocks = own, [*blocks, unpacked(block.as_buffer())]
        if lot is not None:
            yield lot, blocks

    def run(batches):
        for lot, blocks in meetings(batches):
            q, e = unpacked(lot), by_reg_ord(pa.concat_tables(blocks))
            group = pc.dictionary_encode(q["query_id"].combine_chunks(), null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
            asked, known = by_size(q), by_size(e)
            for size in asked.keys() & known.keys():
                (qi, qw), (ei, ew) = asked[size], known[size]
                order = np.argsort(group[qi], kind="stable")
                qi, qw = qi[order], qw[order]
                for i, j, dist, rank in in_order(group[qi], qw, ew, within, method, bits):
                    yield from told(q, qi[i], e, ei[j], dist=dist, rank=rank)

    return lots.crossJoin(F.broadcast(blocks)).mapInArrow(run, told_schema(queries, registry, "dist", "rank"))


def candidates(queries: DataFrame, registry: DataFrame, within: int = K.MATCH, count: int = 256, method: str = "auto", bits: int = 16, most: int | None = None) -> DataFrame:
    """``pairs``, nearest first by rank. most: the first so many of each query.

    All candidates of a registry up to WHOLE rows are ranked where they are found; else they are sent to be ranked.
    """
    if most is None and (entries := registry.count()) <= WHOLE:
        return ranked(queries, registry, entries, within, way(method, entries, within, count, bits), bits)
    found = pairs(queries, registry, within, count, method, bits, most)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "reg_ord")))
    return found if most is None else found.where(F.col("rank") <= most)


def nearest(found: DataFrame) -> DataFrame:
    """The first candidate of each query."""
    return found.where("rank = 1")


def unambiguous(found: DataFrame, by: str = "dist", most: int | None = None, gap: int = K.GAP) -> DataFrame:
    """The best candidate of each query, unless the runner-up comes within ``gap`` of it or it is beyond ``most``."""
    order = Window.partitionBy("query_id").orderBy(by, "reg_ord")
    best = found.withColumn("n", F.row_number().over(order)).withColumn("second", F.lead(by).over(order)).where("n = 1")
    best = best.where(F.coalesce(F.col("second") > F.col(by) + gap, F.lit(True)))
    return (best if most is None else best.where(F.col(by) <= most)).drop("n", "second")


def tight_single(found: DataFrame, most: int = K.TIGHT) -> DataFrame:
    """A query's only candidate, if it is very near."""
    return found.withColumn("n", F.count("*").over(Window.partitionBy("query_id"))).where((F.col("n") == 1) & (F.col("dist") <= most)).drop("n")


def verified(found: DataFrame, region: Column | None = None, veto=None) -> DataFrame:
    """One trusted candidate of each query, or none.

    Candidates with a region hash compete by region distance (at most 40, runner-up not within
    4). Where no candidate of a query has one, a tight single candidate will do. veto: a
    boolean column or UDF on the winner, applied last.
    """
    found = found.withColumn("rdist", region if region is not None else F.lit(None).cast("int"))
    near = F.when(F.col("rdist") <= K.REGION + K.GAP, F.col("rdist"))  # what is farther neither wins nor makes a winner doubtful
    firsts = [F.min_by(c, "reg_ord").alias(c) for c in found.columns if c not in ("query_id", "reg_ord", "rdist")]
    kinds = found.groupBy("query_id", near.alias("rdist")).agg(F.count("*").alias("n"), F.count("rdist").alias("regions"), F.min("reg_ord").alias("reg_ord"), *firsts)
    whole, order = Window.partitionBy("query_id"), Window.partitionBy("query_id").orderBy(F.asc_nulls_last("rdist"))
    kinds = kinds.withColumn("has", F.sum("regions").over(whole) > 0).withColumn("first", F.row_number().over(order)).withColumn("next", F.lead("rdist").over(order)).where("first = 1")
    clear = (F.col("rdist") <= K.REGION) & (F.col("n") == 1) & F.coalesce(F.col("next") > F.col("rdist") + K.GAP, F.lit(True))
    out = kinds.where(F.when(F.col("has"), clear).otherwise((F.col("n") == 1) & (F.col("dist") <= K.TIGHT))).select(*found.columns)
    return out if veto is None else out.where(veto)


def stale(stored: Column, live: Column, beyond: int = K.STALE) -> Column:
    """Both digests are there and too far apart."""
    return F.coalesce(distance(stored, live) > beyond, F.lit(False))
