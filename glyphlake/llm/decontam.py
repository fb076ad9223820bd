"""Benchmark decontamination: finds documents that hold items of a test set.

The items are indexed with BM25 (terms: lower-case words without ASCII punctuation; document
frequencies and the mean length are those of the whole benchmark); a term's impact on an item
is divided by ``share`` of the score that the item gets with its own words, so that an item is
retrieved when its sum is 1 or more. Common words, in over 5 % of the items, have no postings:
an item's commonest are left out as long as they can add SLACK to its sum at most, and its other
impacts are divided by 1 less what they can add. So whatever reaches 1 with all words is found,
and the left-out words are added before it is retrieved. Documents are cut into passages of
128 words, one every 64. An item of at most 65 words lies whole in one of them; a longer one
is indexed in segments of at most 64 words, each like an item of its own, so that every
segment of a copy does. Every passage is a query, and all items above the threshold are
retrieved by block-max WAND: postings are in item order, in blocks that know their greatest
impact, and items are skipped while the bounds of the terms that reach them stay below 1.
The blocks' bounds are first summed for all passages at once; a passage whose terms stay
below 1 in every block needs no cursor.

A retrieved item is verified on the passage and a passage's length around it, or, if it is
longer, where the item would lie around its segment and a passage's length on either side (its
score is that of its best segment): the item's
question (its lines but the last, or its first half if the last line has under five words or
is the only one) and its answer (the rest) must each have ``overlap`` of their distinct word trigrams (words, if fewer than three) there.

The benchmark comes to the driver (LIMIT characters at most; more raises an error) and is indexed
in lots of about ``lot`` items and segments. Documents are read once for as many lots as
INDEX_BYTES hold together, which are sent to the executors.

Defined cases: null or wordless items match nothing, null or wordless texts hold nothing;
equal items are all reported; equal documents each give their rows; empty tables give no
rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, fresh, word_hashes

PASSAGE, STRIDE, BLOCK = 128, 64, 4
COMMON, SLACK = 0.05, 0.3
LIMIT, INDEX_BYTES = 1 << 28, 1 << 27
K1, B = 1.2, 0.75
CHARS = 1 << 21


def parts(text: str) -> tuple[str, str]:
    """An item's question and answer."""
    lines = [x for x in text.splitlines() if x.strip()]
    if len(lines) > 1 and len(lines[-1].split()) >= 5:
        return "\n".join(lines[:-1]), lines[-1]
    words = text.split()
    return " ".join(words[: (len(words) + 1) // 2]), " ".join(words[(len(words) + 1) // 2 :])


def grams(words: np.ndarray) -> set[tuple[int, ...]]:
    w = words.tolist()
    return set(zip(w, w[1:], w[2:])) if len(w) > 2 else {(x,) for x in w}


class Units:
    """Items, long ones in segments of at most a stride: their distinct terms and counts, unit by unit."""

    def __init__(self, items: list[tuple[int, str]]):
        hashes, bounds, _, _ = word_hashes([t for _, t in items], lower=True, bare=True)
        words = np.diff(bounds)
        units = np.where(words > STRIDE + 1, -(-words // STRIDE), 1)
        self.home = np.repeat(np.arange(len(items)), units)  # each unit's item
        part = np.arange(len(self.home)) - np.repeat(np.cumsum(units) - units, units)
        self.words, self.offset = words[self.home], words[self.home] * part // units[self.home]
        bounds = np.append(bounds[:-1][self.home] + self.offset, bounds[-1:])
        self.length = np.diff(bounds)
        own = [np.unique(hashes[a:b], return_counts=True) for a, b in zip(bounds[:-1], bounds[1:])]
        self.unit = np.repeat(np.arange(len(own)), [len(t) for t, _ in own])
        self.term, self.tf = (np.concatenate([x[k] for x in own]) if own else np.zeros(0, np.uint64) for k in (0, 1))


class Statistics:
    """How many units hold each term, how many units there are, and their mean length, over all lots."""

    def __init__(self, lots: list[Units]):
        self.terms, self.df = np.unique(np.concatenate([u.term for u in lots]) if lots else np.zeros(0, np.uint64), return_counts=True)
        lengths = [u.length for u in lots]
        self.units, self.mean = sum(map(len, lengths)), sum(int(x.sum()) for x in lengths) / max(1, sum(map(len, lengths)))


class Index:
    """Postings of units, unit numbers in order, with the greatest impact of each block and term."""

    def __init__(self, items: list[tuple[int, str]], share: float, units: Units | None = None, all_: Statistics | None = None):
        units = units or Units(items)
        all_ = all_ or Statistics([units])
        self.home, self.words, self.offset, own = units.home, units.words, units.offset, len(units.home)
        self.ids = [i for i, _ in items]
        self.sides = [[grams(word_hashes([x], lower=True, bare=True)[0]) for x in parts(t)] for _, t in items]
        self.terms, term = np.unique(units.term, return_inverse=True)
        df, item = all_.df[np.searchsorted(all_.terms, units.term)], units.unit
        norm = K1 * (1 - B + B * units.length / max(1e-9, all_.mean))
        impact = np.log(1 + (all_.units - df + 0.5) / (df + 0.5)) * units.tf * (K1 + 1) / (units.tf + norm[item])
        impact /= share * np.bincount(item, impact, own)[item]
        # each unit's commonest words, as long as they add up to little
        order = np.lexsort((units.term, -df, item))
        total = np.cumsum(impact[order])
        before = np.concatenate([[0], total])[np.searchsorted(item, np.arange(own))] if len(item) else total
        out = np.zeros(len(term), bool)
        out[order] = (df[order] > max(1, COMMON * all_.units)) & (total - before[item] <= SLACK)
        self.slack = np.bincount(item[out], impact[out], own)
        self.left = [{} for _ in range(own)]
        for u, t, x in zip(item[out].tolist(), term[out].tolist(), impact[out].tolist()):
            self.left[u][t] = x
        item, term = item[~out], term[~out]
        impact = impact[~out] / (1 - self.slack[item])
        order = np.lexsort((item, term))
        self.item, self.impact = item[order], impact[order]
        self.start = np.searchsorted(term[order], np.arange(len(self.terms) + 1))
        self.blocks = np.zeros((len(self.terms) + 1, -(-own // BLOCK) or 1), np.float32)  # greatest impact in each block of items
        np.maximum.at(self.blocks, (term, item // BLOCK), impact * (1 + 1e-6))
        self.most = self.blocks[:-1].max(axis=1)
        self.cursors: dict[int, tuple] = {}

    def size(self) -> int:
        """Bytes, about."""
        return self.blocks.nbytes + 48 * len(self.item) + 200 * sum(len(x) for x in self.sides)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Term numbers, -1 for words of no item."""
        if not len(self.terms):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def search(self, terms: np.ndarray) -> list[tuple[int, float]]:
        """All units whose impacts on these distinct terms, common ones included, sum to 1 or more."""
        have, found = set(terms.tolist()), []
        for u, score in self.reached(terms):
            score = score * (1 - self.slack[u]) + sum(x for t, x in self.left[u].items() if t in have)
            if score >= 1 - 1e-9:
                found.append((u, float(score)))
        return found

    def reached(self, terms: np.ndarray) -> list[tuple[int, float]]:
        """All units whose postings' impacts on these distinct terms sum to 1 or more."""
        lists = []
        for t in terms.tolist():
            if t not in self.cursors:
                a, b = self.start[t], self.start[t + 1]
                items, impacts = self.item[a:b].tolist(), self.impact[a:b].tolist()
                self.cursors[t] = items, impacts, float(self.most[t]), [max(impacts[k : k + BLOCK]) for k in range(0, len(items), BLOCK)]
            if self.cursors[t][0]:
                lists.append([self.cursors[t][0][0], 0, *self.cursors[t]])
        found = []
        while lists:
            lists.sort(key=lambda x: x[0])
            bound, pivot = 0.0, None
            for k, cursor in enumerate(lists):
                bound += cursor[4]
                if bound >= 1 - 1e-9:
                    pivot = k
                    break
            if pivot is None:
                break
            at = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == at:
                pivot += 1
            near, end = 0.0, len(self.home)
            for cursor in lists[: pivot + 1]:  # the block in which each would meet the pivot
                k = cursor[1] // BLOCK
                while (k + 1) * BLOCK < len(cursor[2]) and cursor[2][min((k + 1) * BLOCK, len(cursor[2])) - 1] < at:
                    k += 1
                near += cursor[5][k]
                last = min((k + 1) * BLOCK, len(cursor[2]))
                end = min(end, cursor[2][last - 1] + 1 if last < len(cursor[2]) or cursor[2][last - 1] >= at else end)
            if near >= 1 - 1e-9:
                if lists[0][0] == at:
                    score = sum(c[3][c[1]] for c in lists[: pivot + 1])
                    if score >= 1 - 1e-9:
                        found.append((at, score))
                    goal = at + 1
                else:
                    goal = at
            else:
                goal = max(at + 1, end)
                if pivot + 1 < len(lists):
                    goal = max(at + 1, min(goal, lists[pivot + 1][0]))
            for cursor in lists[: pivot + 1]:
                items, k = cursor[2], cursor[1]
                while k < len(items) and items[k] < goal:
                    k += 1
                cursor[1], cursor[0] = k, items[k] if k < len(items) else -1
            lists = [c for c in lists if c[0] >= 0]
        return found


def retrieved(index: Index, hashes: np.ndarray, bounds: np.ndarray):
    """text, start, unit number and score of each retrieval in some texts' words.

    A passage is two strides in a row. Each stride's distinct terms give its bound for every
    block of items; a passage whose bounds are below 1 in all blocks is passed over.
    """
    terms, n = index.numbers(hashes), np.diff(bounds)
    strides = np.maximum(1, -(-n // STRIDE))
    first = np.cumsum(strides) - strides
    text = np.repeat(np.arange(len(n)), n)
    stride = first[text] + (np.arange(len(terms)) - bounds[text]) // STRIDE
    known = terms >= 0
    pairs = np.unique(stride[known] * len(index.blocks) + terms[known])
    where, what = pairs // len(index.blocks), pairs % len(index.blocks)
    bound = np.zeros((int(strides.sum()) + 1, index.blocks.shape[1]), np.float32)
    own = np.flatnonzero(np.diff(where, prepend=-1))
    if len(own):
        bound[where[own]] = np.add.reduceat(index.blocks[what], own)
    inner = np.ones(len(bound), bool)  # strides that have a next one in their text
    inner[first + strides - 1] = False
    inner[-1] = False
    both = bound[:-1] + bound[1:] * inner[:-1, None]
    starts = inner[:-1].copy()
    starts[first] = True
    home = np.repeat(np.arange(len(n)), strides)
    cut = np.searchsorted(where, np.arange(len(bound) + 1))
    for k in np.flatnonzero(starts & (both.max(axis=1) >= 1 - 1e-5)):
        own = np.unique(what[cut[k] : cut[k + 1 + bool(inner[k])]])
        for item, score in index.search(own):
            yield int(home[k]), int((k - first[home[k]]) * STRIDE), item, score


def matches(index: Index, hashes: np.ndarray, bounds: np.ndarray, overlap: float) -> list[tuple]:
    """text, item number, best score, question and answer overlap of each verified item."""
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    for text, s, unit, score in retrieved(index, hashes, bounds):
        a, b, item = bounds[text], bounds[text + 1], int(index.home[unit])
        at, long = a + s - int(index.offset[unit]), int(index.words[unit]) > STRIDE + 1
        here = hashes[max(a, at - PASSAGE) : max(a, min(b, at + 2 * PASSAGE + long * int(index.words[unit])))]
        have = grams(here) | {(x,) for x in here.tolist()}  # sides of one or two words are compared by words
        question, answer = (len(side & have) / len(side) if side else 1.0 for side in index.sides[item])
        if min(question, answer) >= overlap and (score, question, answer) > best.get((text, item), (0.0, 0.0, 0.0)):
            best[text, item] = (score, question, answer)
    return sorted((*key, *found) for key, found in best.items())


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.5, overlap: float = 0.5, lot: int = 512) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap, rid: one row for each item that a document holds."""
    items = benchmark.where("text is not null").select("item_id", "text")
    words = F.size(F.split("text", r"\s+"))
    units, chars = items.agg(F.sum(F.when(words > STRIDE + 1, F.ceil(words / STRIDE)).otherwise(1)), F.sum(F.length("text"))).first()
    if (chars or 0) > LIMIT:
        raise ValueError(f"the benchmark has {chars} characters; {LIMIT} at most are indexed at once")
    lots: list[list[tuple[int, str]]] = [[] for _ in range(int(units or 0) // lot + 1)]
    order = F.pmod(F.xxhash64("item_id", "text"), F.lit(len(lots))).alias("k")
    for r in items.select("item_id", "text", order).orderBy("k", "item_id", "text").collect():
        lots[r["k"]].append((r["item_id"], r["text"]))
    counted = [Units(x) for x in lots]
    all_ = Statistics(counted)
    reads: list[list[Index]] = [[]]
    for own, units_ in zip(lots, counted):
        index = Index(own, share, units_, all_)
        if reads[-1] and sum(x.size() for x in reads[-1]) + index.size() > INDEX_BYTES:
            reads.append([])
        reads[-1].append(index)
    out, fields = None, "item_id long, score double, question_overlap double, answer_overlap double, rid long"
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rid"))
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(fields)])
    for read in reads:
        sent = docs.sparkSession.sparkContext.broadcast(read)

        def run(frames, sent=sent):
            for pdf in batches(frames, CHARS):
                hashes, bounds, _, _ = word_hashes(pdf["text"], lower=True, bare=True)
                doc_id, rid = pdf["doc_id"].to_numpy(), pdf["rid"].to_numpy()
                rows = [(doc_id[d], index.ids[i], *rest, rid[d]) for index in sent.value for d, i, *rest in matches(index, hashes, bounds, overlap)]
                if rows:
                    yield pd.DataFrame(rows, columns=schema.names)

        one = keyed.mapInPandas(run, schema)
        out = one if out is None else out.unionByName(one)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """All columns of the documents that hold no item."""
    key = fresh(docs, "rid")
    hit = contaminated(docs, benchmark, **how).select(F.col("rid").alias(key)).distinct()
    return docs.withColumn(key, F.xxhash64("doc_id", "text")).join(hit, key, "left_anti").select(*docs.columns)
