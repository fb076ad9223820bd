"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Each word (ASCII lower case, punctuation parts words) enters as a word vector (one for all
words that under 12 training texts hold) beside
the mean of its hashed character trigrams' vectors. Two gated recurrent units read a window
of words in both directions, attention weighs the states, and a logistic unit scores the
pooled state. Texts are cut into overlapping windows of 48 words, one every 32, down to their
last word; a logistic unit joins a text's highest two windows, the mean of all, and their number.

Trained on at most ``fit`` labelled documents of each label (those of smallest hash; rows of
the held-out bucket never): first on all their windows, then on the windows that count:
those of toxic documents that score high, and others' windows. Labels, languages, sources and ids are
never inputs of a score.

Defined cases: null text counts as empty; a text without words is one empty window, which
gets the model's score for nothing; without labels of both kinds all scores are 0; equal
texts get equal scores; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, id_bucket, least, mix64, word_hashes

LENGTH, STRIDE, HIDDEN, VECTOR = 48, 32, 8, 8
TRI_BINS, WORDS, SEEN = 1 << 12, 1 << 15, 12
CHARS = 1 << 21
STEPS = 200  # of training, at least


def rows_of(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Rows of the word vectors; row 0 is for words that training hardly saw."""
    if not len(known):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, at + 1, 0)


class Words:
    """Windows of a batch's texts over its distinct words."""

    def __init__(self, texts, known: np.ndarray | None = None):
        hashes, bounds, start, end = word_hashes(texts, lower=True, bare=True)
        distinct, at, self.which = np.unique(hashes, return_index=True, return_inverse=True)
        self.distinct = distinct
        self.word = rows_of(known, distinct) if known is not None else np.zeros(len(distinct), np.int64)
        raw = np.frombuffer(b" ".join([*(b"" if t is None else t.encode("utf-8", "surrogatepass").lower() for t in texts), b""]), np.uint8)
        a, n = start[at], (end - start)[at]
        # the trigrams of each word between blanks
        size = n + 2
        self.tri_start = np.cumsum(n) - n
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        inner = (place > 0) & (place <= np.repeat(n, size))
        source = np.repeat(a, size) + place - 1
        chars = np.where(inner, raw[np.clip(source, 0, max(0, len(raw) - 1))] if len(raw) else 0, 32).astype(np.uint64)
        middle = np.flatnonzero(inner)
        code = chars[middle - 1] | chars[middle] << np.uint64(8) | chars[middle + 1] << np.uint64(16)
        self.tri = (mix64(code + np.uint64(9)) % np.uint64(TRI_BINS)).astype(np.int64)
        self.tri_n = n
        length = np.diff(bounds)
        per = np.maximum(1, -(-np.maximum(0, length - LENGTH) // STRIDE) + 1)
        self.text = np.repeat(np.arange(len(length)), per)
        k = np.arange(len(self.text)) - np.repeat(np.cumsum(per) - per, per)
        self.begin = bounds[:-1][self.text] + k * STRIDE
        self.size = np.clip(length[self.text] - k * STRIDE, 0, LENGTH)

    def window(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct-word places (any where there is no word) and which are words, for some windows."""
        at = self.begin[own][:, None] + np.arange(LENGTH)
        valid = np.arange(LENGTH) < self.size[own][:, None]
        return (self.which[np.where(valid, at, 0)] if len(self.which) else np.zeros(at.shape, np.int64)), valid

    def inputs(self, p) -> np.ndarray:
        """A vector for each distinct word."""
        if not len(self.word):
            return np.zeros((1, 2 * VECTOR), np.float32)
        tri = np.add.reduceat(p["tri"][self.tri], self.tri_start) / self.tri_n[:, None]
        return np.concatenate([p["word"][self.word], tri.astype(np.float32)], axis=1)


def sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def start(rng, words: int) -> dict[str, np.ndarray]:
    p = {"word": rng.normal(0, 0.1, (words + 1, VECTOR)), "tri": rng.normal(0, 0.1, (TRI_BINS, VECTOR))}
    for d in "fb":
        p |= {f"W{d}": rng.normal(0, 0.3, (2 * VECTOR, 3 * HIDDEN)), f"U{d}": rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN)), f"c{d}": np.zeros(3 * HIDDEN)}
    p |= {"A": rng.normal(0, 0.3, (2 * HIDDEN, HIDDEN)), "u": rng.normal(0, 0.3, HIDDEN), "o": rng.normal(0, 0.3, 2 * HIDDEN), "z": np.zeros(1)}
    return {k: v.astype(np.float32) for k, v in p.items()}


def states(p, d: str, G: np.ndarray, valid: np.ndarray, tape: list | None = None) -> np.ndarray:
    """A unit's states over windows, time first; G: its input sums. tape: gets what going back needs."""
    steps = range(LENGTH) if d == "f" else range(LENGTH - 1, -1, -1)
    U, H = p[f"U{d}"], HIDDEN
    h = np.zeros((G.shape[1], H), np.float32)
    out = np.empty((LENGTH, G.shape[1], H), np.float32)
    for t in steps:
        s = h @ U
        zr = sigmoid(G[t, :, : 2 * H] + s[:, : 2 * H])
        z, r = zr[:, :H], zr[:, H:]
        c = np.tanh(G[t, :, 2 * H :] + r * s[:, 2 * H :])
        on = valid[t][:, None]
        new = np.where(on, h + z * (c - h), h)
        if tape is not None:
            tape.append((t, h, s[:, 2 * H :], z, r, c, on))
        h = out[t] = new
    return out


def pooled(p, S: np.ndarray, valid: np.ndarray):
    """Attention over states: hidden layer, weights, pooled states, logits."""
    M = np.tanh(S @ p["A"])
    e = np.where(valid, M @ p["u"], -1e9)
    w = np.exp(e - e.max(axis=0))
    w *= valid
    w /= np.maximum(w.sum(axis=0), 1e-9)
    q = (w[..., None] * S).sum(axis=0)
    return M, w, q, q @ p["o"] + p["z"][0]


def logits(p, batch: Words, own: np.ndarray, x: np.ndarray, block: int = 2048) -> np.ndarray:
    """Logits of some windows; x: the distinct words' vectors."""
    G = {d: (x @ p[f"W{d}"] + p[f"c{d}"]).astype(np.float32) for d in "fb"}
    out = np.zeros(len(own), np.float32)
    for s in range(0, len(own), block):
        which, valid = batch.window(own[s : s + block])
        which, valid = which.T, valid.T
        S = np.concatenate([states(p, d, G[d][which], valid) for d in "fb"], axis=2)
        out[s : s + block] = pooled(p, S, valid)[3]
    return out


def gradients(p, batch: Words, own: np.ndarray, y: np.ndarray, weight: np.ndarray):
    """Of the weighted logistic loss of some windows, by going back through time. The vectors' rows come as (rows, values)."""
    x = batch.inputs(p)
    which, valid = batch.window(own)
    which, valid = which.T, valid.T
    used, place = np.unique(which, return_inverse=True)
    place = place.reshape(which.shape)
    X = x[used]
    tapes, S = {"f": [], "b": []}, []
    for d in "fb":
        S.append(states(p, d, (X @ p[f"W{d}"] + p[f"c{d}"])[place], valid, tapes[d]))
    S = np.concatenate(S, axis=2)
    M, w, q, logit = pooled(p, S, valid)
    dl = (sigmoid(logit) - y) * weight / max(1e-9, weight.sum())
    g = {"z": np.array([dl.sum()]), "o": q.T @ dl}
    dq = dl[:, None] * p["o"]
    dw = (S * dq).sum(axis=2)
    de = w * (dw - (w * dw).sum(axis=0))
    dM = de[..., None] * p["u"] * (1 - M * M)
    g["u"] = (M * de[..., None]).sum(axis=(0, 1))
    flat = lambda a: a.reshape(-1, a.shape[-1])
    g["A"] = flat(S).T @ flat(dM)
    dS = w[..., None] * dq + dM @ p["A"].T
    H, dX = HIDDEN, np.zeros_like(X)
    for k, d in enumerate("fb"):
        U = p[f"U{d}"]
        gU, gG, dh = np.zeros_like(U), np.zeros((*which.shape, 3 * H), np.float32), 0
        for t, h, s, z, r, c, on in reversed(tapes[d]):
            dh = dh + dS[t, :, k * H : (k + 1) * H]
            live = dh * on
            dc = live * z * (1 - c * c)
            dz = live * (c - h) * z * (1 - z)
            dr = dc * s * r * (1 - r)
            ds = np.concatenate([dz, dr, dc * r], axis=1)
            gU += h.T @ ds
            gG[t] = np.concatenate([dz, dr, dc], axis=1)
            dh = dh - live * z + ds @ U.T
        per = np.zeros((len(used), 3 * H), np.float32)
        np.add.at(per, place.ravel(), flat(gG))
        g[f"U{d}"], g[f"W{d}"], g[f"c{d}"] = gU, X.T @ per, per.sum(axis=0)
        dX += per @ p[f"W{d}"].T
    if not len(batch.word):
        return g, {}
    rows, to = np.unique(batch.word[used], return_inverse=True)
    dword = np.zeros((len(rows), VECTOR), np.float32)
    np.add.at(dword, to, dX[:, :VECTOR])
    n = batch.tri_n[used]
    tri = batch.tri[np.repeat(batch.tri_start[used] - np.cumsum(n) + n, n) + np.arange(n.sum())]
    trows, to = np.unique(tri, return_inverse=True)
    dtri = np.zeros((len(trows), VECTOR), np.float32)
    np.add.at(dtri, to, np.repeat(dX[:, VECTOR:] / n[:, None], n, axis=0))
    return g, {"word": (rows, dword), "tri": (trows, dtri)}


class Adam:
    def __init__(self, p, rate: float, decay: float = 0.03):
        self.p, self.rate, self.decay, self.t = p, rate, decay, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, g, sparse):
        self.t += 1
        for k, d, at in [*((k, d, slice(None)) for k, d in g.items()), *((k, d, rows) for k, (rows, d) in sparse.items())]:
            self.m[k][at] = 0.9 * self.m[k][at] + 0.1 * d
            self.v[k][at] = 0.99 * self.v[k][at] + 0.01 * d * d
            if k in ("word", "tri"):  # vectors decay, so that a word seen in few texts says little
                self.p[k][at] *= 1 - self.decay
            self.p[k][at] -= self.rate * (self.m[k][at] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k][at] / (1 - 0.99**self.t)) + 1e-8)


def evidence(p, data: Words, texts: int) -> np.ndarray:
    """Of each text: its highest and second window's logits, and the mean logit of all windows."""
    logit = np.clip(logits(p, data, np.arange(len(data.text)), data.inputs(p)), -8, 8)
    out = np.full((texts, 4), -8.0)
    np.maximum.at(out[:, 0], data.text, logit)
    rest = logit < out[data.text, 0]
    np.maximum.at(out[:, 1], data.text[rest], logit[rest])
    n = np.bincount(data.text, minlength=texts)
    out[:, 2] = np.bincount(data.text, logit, texts) / n
    out[:, 3] = np.log(n)
    return np.concatenate([out / 4, np.ones((texts, 1))], axis=1)


def probability(p, data: Words, texts: int) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(evidence(p, data, texts) @ p["doc"], -30, 30)))


def network(texts: list[str | None], labels: np.ndarray, rounds: int = 5, batch: int = 128, rate: float = 0.03) -> dict[str, np.ndarray] | None:
    """The network's weights and the words it knows."""
    rng = np.random.default_rng(11)
    seen = Words(texts)
    owner = np.repeat(seen.text, seen.size)  # windows overlap, so pairs are counted once
    pairs = np.unique(np.stack([owner, seen.which[np.concatenate([np.arange(b, b + n) for b, n in zip(seen.begin, seen.size)])]]), axis=1) if len(seen.which) else np.zeros((2, 0), np.int64)
    spread = np.bincount(pairs[1], minlength=len(seen.distinct))
    often = np.argsort(-spread, kind="stable")[:WORDS]
    known = np.sort(seen.distinct[often[spread[often] >= SEEN]])
    p, data = start(rng, len(known)), Words(texts, known)
    adam, y = Adam(p, rate), labels[data.text].astype(np.float32)
    windows = np.arange(len(y))
    turn, steps = 0, 0
    while turn < rounds or steps < STEPS:
        use = windows
        if turn >= 2 and steps >= STEPS // 2:  # a toxic document counts by windows that score high; if none does, its label may be wrong
            logit = logits(p, data, windows, data.inputs(p))
            best = np.full(len(labels), -np.inf)
            np.maximum.at(best, data.text, logit)
            use = np.flatnonzero((y == 0) | (logit > 0) | ((logit >= best[data.text]) & (logit > -1)))
        positive, negative = use[y[use] == 1], use[y[use] == 0]
        negative = rng.permutation(negative)[: 4 * len(positive) + batch]
        order = rng.permutation(np.concatenate([positive, negative]))
        for s in range(0, len(order), batch):
            own = order[s : s + batch]
            adam.step(*gradients(p, data, own, y[own], np.ones(len(own), np.float32)))
            steps += 1
        turn += 1
    return p | {"known": known}


def trained(texts: list[str | None], labels: np.ndarray) -> dict[str, np.ndarray] | None:
    """The network's weights, the words it knows, and the logistic unit that joins a text's windows.

    The unit learns from texts that the network hasn't seen: a network of all texts but every
    fifth of each label gives the fifths' evidence; the network itself is of all texts.
    """
    labels = np.asarray(labels)
    if len(set(labels.tolist())) < 2:
        return None
    place = np.zeros(len(labels), np.int64)
    for y in (0, 1):
        place[labels == y] = np.arange((labels == y).sum())
    apart = place % 5 == 4
    p, judge, own = network(texts, labels), None, np.arange(len(labels))
    if len(set(labels[apart].tolist())) == 2:
        own = np.flatnonzero(apart)
        judge = network([texts[i] for i in np.flatnonzero(~apart)], labels[~apart])
    judge = judge or p
    x = evidence(judge, Words([texts[i] for i in own], judge["known"]), len(own))
    y, w = labels[own], np.zeros(5)
    for _ in range(3000):
        w -= 0.3 * (x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(y) + 1e-3 * w)
    return p | {"doc": w}


def sample(docs: DataFrame, labels: DataFrame, fit: int) -> DataFrame:
    """text and toxic of the rows to learn from. Their ids are chosen among the labels, so that no text is shuffled."""
    known = labels.where("toxic in (0, 1)").where(id_bucket(F.col("doc_id"), 5) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where("doc_id is not null").withColumn("hash", F.xxhash64("doc_id"))
    chosen = {r["doc_id"]: r["toxic"] for r in least(known, "toxic", "hash", fit).collect()}
    if not chosen:
        return docs.limit(0).select("text", F.lit(0).alias("toxic"))
    toxic = F.col("doc_id").isin([i for i, y in chosen.items() if y == 1]).cast("int").alias("toxic")
    return docs.where(F.col("doc_id").isin(list(chosen))).select("text", toxic, "doc_id").distinct().orderBy("toxic", F.xxhash64("doc_id", "text")).select("text", "toxic")


def classify(docs: DataFrame, labels: DataFrame, fit: int = 500) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""
    rows = sample(docs, labels, fit).collect()
    p = trained([r["text"] for r in rows], np.array([r["toxic"] for r in rows]))
    model = docs.sparkSession.sparkContext.broadcast(p)

    def make(frames):
        for pdf in batches(frames, CHARS):
            out = pdf[["doc_id"]].copy()
            if model.value is None:
                out["score"] = 0.0
            else:
                out["score"] = probability(model.value, Words(pdf["text"], model.value["known"]), len(pdf))
            yield out

    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])
    scored = docs.select("doc_id", "text").mapInPandas(make, schema)
    held = (id_bucket(F.col("doc_id"), 5) == 0).alias("held_out")
    return scored.select("doc_id", held, "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))
