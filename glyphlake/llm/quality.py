"""Quality classifier from weak labels.

Overlapping heuristic labellers each vote good, bad or nothing on a document. How often each
pattern of votes occurs is counted over all documents; expectation-maximisation on these
counts estimates each labeller's accuracies and the share of good documents, without any
true label, and gives every pattern a posterior; texts without words are bad beforehand. A linear scorer on hashed features (words,
character trigrams of their shapes, and the labellers' measures) then learns the posteriors of a
bounded sample of documents and scores every whole text, also where no labeller votes.

The sample is the ``fit`` documents of smallest hash. With k labellers there are at most
3**k patterns, which is all that reaches the driver.

Defined cases: null text counts as empty, and an empty text is bad (score 0); an empty table
gives no rows; equal texts get equal scores; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, byte_buffer, mix64, word_hashes

LABELLERS = ["length", "symbols", "digits", "capitals", "bars", "word_length", "repeats", "endings"]
BINS = 1 << 14
CHARS = 1 << 21

_CLASS = np.zeros(256, np.uint8)  # 1 space, 2 lower, 3 upper, 4 digit, 5 plain punctuation, 6 other symbols, 7 beyond ASCII
_CLASS[[0x20, *range(0x09, 0x0E)]] = 1
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 2, 3, 4
_CLASS[33:48], _CLASS[58:65], _CLASS[91:97], _CLASS[123:127] = 6, 6, 6, 6
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 5
_CLASS[128:] = 7


def measures(texts) -> np.ndarray:
    """Words, symbol share, digit share, capital share, bar share, word length, repeated-word share, ended-line share."""
    buf, bounds = byte_buffer(texts)
    kind = _CLASS[buf]
    words, wb, start, end = word_hashes(texts, lower=True)
    total = lambda mark: np.diff(np.concatenate([[0], np.cumsum(mark)])[bounds])
    solid = np.maximum(1, total(kind != 1))
    letters = np.maximum(1, total((kind == 2) | (kind == 3)))
    line_end = np.flatnonzero(buf == 10)
    stop = np.isin(buf, np.frombuffer(b".!?:\"')", np.uint8))
    n = np.diff(wb)
    out = np.zeros((len(bounds) - 1, 8))
    out[:, 0] = n
    out[:, 1] = total(kind == 6) / solid
    out[:, 2] = total(kind == 4) / solid
    out[:, 3] = total(kind == 3) / letters
    out[:, 4] = total(buf == ord("|")) / solid
    out[:, 5] = solid / np.maximum(1, n)
    for d, (a, b) in enumerate(zip(wb[:-1], wb[1:])):
        out[d, 6] = 1 - len(np.unique(words[a:b])) / (b - a) if b > a else 0
        lines = line_end[(k := np.searchsorted(line_end, bounds[d])) : np.searchsorted(line_end, bounds[d + 1])]
        ends = np.append(lines, bounds[d + 1]) - 1
        ends = ends[(ends >= bounds[d]) & (np.diff(np.concatenate([[bounds[d] - 1], ends])) > 1)]
        out[d, 7] = stop[ends].mean() if len(ends) else 0
        del k
    return out


def votes(m: np.ndarray) -> np.ndarray:
    """1 good, -1 bad, 0 nothing, for each document and labeller."""
    n, symbols, digits, capitals, bars, length, repeats, endings = m.T
    say = lambda bad, good: np.where(bad, -1, np.where(good, 1, 0))
    return np.stack(
        [
            say(n < 1, n > 0),
            say(symbols > 0.08, symbols < 0.02),
            say(digits > 0.2, digits < 0.05),
            say(capitals > 0.3, capitals < 0.1),
            say(bars > 0.03, bars == 0),
            say((length > 12) | (length < 1.5), (length > 2) & (length < 8)),
            say((repeats > 0.8) & (n > 50), (repeats < 0.6)),
            say((endings < 0.3) & (n > 20), endings > 0.7),
        ],
        axis=1,
    ).astype(np.int8)


def ordered(p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """p[labeller, class, vote], changed where a labeller would vote good rather on bad documents, or bad on good ones.

    There both classes get the common rate, which is the best among those that are no worse than chance.
    """
    common = (p * weight[None, :, None]).sum(axis=1) / weight.sum()
    for v, wrong in ((2, p[:, 0, 2] > p[:, 1, 2]), (0, p[:, 1, 0] > p[:, 0, 0])):
        p[wrong, :, v] = common[wrong, None, v]
    p[:, :, 1] = np.maximum(1e-9, 1 - p[:, :, 0] - p[:, :, 2])
    return p


def estimated(patterns: np.ndarray, count: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of each pattern, p[labeller, true class, vote], and the share of good documents.

    No labeller is taken to be worse than chance, which keeps the classes' names. EM starts
    from every split by the number of good votes less bad ones; the likeliest end counts.
    """
    each, lead, best = np.arange(patterns.shape[1]), patterns.sum(axis=1), None
    some = [patterns == v for v in (-1, 0, 1)]
    for cut in np.unique(lead):
        post = np.where(lead >= cut, 0.9, 0.1)
        for _ in range(rounds):
            good = float(np.clip((post * count).sum() / count.sum(), 0.005, 0.995))
            weight = np.stack([(1 - post) * count, post * count])
            p = np.stack([(weight @ s).T for s in some], axis=2) + 0.1
            p = ordered(p / p.sum(axis=2, keepdims=True), weight.sum(axis=1) + 0.3)
            say = [np.log(p[each, c, patterns + 1]).sum(axis=1) + np.log(share) for c, share in ((0, 1 - good), (1, good))]
            post = 1 / (1 + np.exp(np.clip(say[0] - say[1], -500, 500)))
        likelihood = float((np.logaddexp(*say) * count).sum())
        if best is None or likelihood > best[0] + 1e-9:
            best = likelihood, post, p, good
    return best[1:]


def hashed(texts, m: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and values of each text's features: shares of hashed words and of byte-class trigrams, and the measures."""
    words, wb, _, _ = word_hashes(texts, lower=True)
    buf, bounds = byte_buffer(texts)
    kind = _CLASS[buf].astype(np.int64)
    tri = (kind[:-2] * 64 + kind[1:-1] * 8 + kind[2:]) if len(kind) > 2 else np.zeros(0, np.int64)
    word_bin = (mix64(words + np.uint64(77)) % np.uint64(BINS)).astype(np.int64)
    scaled = np.stack([np.minimum(np.log1p(m[:, 0]) / 8, 1), *(np.minimum(m[:, k] * s, 3) for k, s in ((1, 5), (2, 5), (3, 3), (4, 10), (5, 0.1), (6, 1), (7, 1)))], axis=1)
    out = []
    for d in range(len(wb) - 1):
        w, wn = np.unique(word_bin[wb[d] : wb[d + 1]], return_counts=True)
        t = np.bincount(tri[bounds[d] : max(bounds[d], bounds[d + 1] - 2)], minlength=512)
        own = np.flatnonzero(t)
        at = np.concatenate([w, BINS + own, BINS + 512 + np.arange(9)])
        value = np.concatenate([np.sqrt(wn / max(1, wn.sum())), np.sqrt(t[own] / max(1, t.sum())), scaled[d], [1.0]])
        out.append((at, value))
    return out


def fitted(rows: list[tuple[np.ndarray, np.ndarray]], goal: np.ndarray, epochs: int = 12, rate: float = 0.5) -> np.ndarray:
    """Weights of a logistic scorer, by adaptive gradient steps in a fixed random order."""
    w, g2, rng = np.zeros(BINS + 521), np.full(BINS + 521, 1e-2), np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            g = (1 / (1 + np.exp(-np.clip(w[at] @ x, -30, 30))) - goal[i]) * x + 1e-6 * w[at]
            g2[at] += g * g
            w[at] -= rate * g / np.sqrt(g2[at])
    return w


def classify(docs: DataFrame, fit: int = 2000) -> DataFrame:
    """doc_id, votes (one letter for each labeller), posterior, score, keep for each document."""
    spark = docs.sparkSession
    power = 3 ** np.arange(len(LABELLERS))

    def count(frames):
        total = np.zeros(3 ** len(LABELLERS), np.int64)
        for pdf in batches(frames, CHARS):
            np.add.at(total, (votes(measures(pdf["text"])) + 1) @ power, 1)
        own = np.flatnonzero(total)
        yield pd.DataFrame({"pattern": own, "n": total[own]})

    seen = docs.select("text").mapInPandas(count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    number = np.array([r["pattern"] for r in seen], np.int64)
    patterns = number[:, None] // power % 3 - 1
    posterior = np.full(3 ** len(LABELLERS), 0.5)
    wordless = patterns[:, 0] < 0
    posterior[number[wordless]] = 0.0  # known to be bad, and no evidence for the rest
    if (~wordless).any():
        posterior[number[~wordless]] = estimated(patterns[~wordless, 1:], np.array([r["n"] for r in seen], float)[~wordless])[0]

    ids = docs.select(F.xxhash64("doc_id", "text").alias("rid")).orderBy("rid").limit(fit)
    chosen = [r["rid"] for r in ids.collect()]
    few = docs.withColumn("rid", F.xxhash64("doc_id", "text")).where(F.col("rid").isin(chosen)) if chosen else docs.withColumn("rid", F.lit(0)).limit(0)

    def learn(frames):
        for pdf in batches(frames, CHARS):
            m = measures(pdf["text"])
            rows = hashed(pdf["text"], m)
            yield pd.DataFrame({"rid": pdf["rid"], "pattern": (votes(m) + 1) @ power, "at": [a.astype(np.int32).tobytes() for a, _ in rows], "x": [x.astype(np.float32).tobytes() for _, x in rows]})

    sample = few.select("rid", "text").mapInPandas(learn, "rid long, pattern long, at binary, x binary").dropDuplicates(["rid"]).orderBy("rid").collect()
    rows = [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["x"], np.float32).astype(float)) for r in sample]
    weights = spark.sparkContext.broadcast(fitted(rows, posterior[[r["pattern"] for r in sample]]) if rows else np.zeros(BINS + 521))

    def score(frames):
        letters = np.array(list("-.+"))
        for pdf in batches(frames, CHARS):
            m = measures(pdf["text"])
            v = votes(m)
            out = pdf[["doc_id"]].copy()
            out["votes"] = ["".join(letters[row + 1]) for row in v]
            out["posterior"] = np.where(m[:, 0] > 0, posterior[(v + 1) @ power], 0.0)
            s = np.array([weights.value[at] @ x for at, x in hashed(pdf["text"], m)])
            out["score"] = np.where(m[:, 0] > 0, 1 / (1 + np.exp(-np.clip(s, -30, 30))), 0.0)
            out["keep"] = out["score"] >= 0.5
            yield out

    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("votes string, posterior double, score double, keep boolean")])
    return docs.select("doc_id", "text").mapInPandas(score, schema)
