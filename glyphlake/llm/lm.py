"""LM scoring: the log probability of every text under a small causal self-attention model.

Words (ASCII lower case) are cut into the subword ids of a public byte-level vocabulary,
and each text ends with one end token. The model is one head of causal self-attention over
windows of ids. It gives a distribution over classes of ids; an id's class times its share
of the class is mixed with how often the id follows the one before it, as Witten and Bell do:
(c(before, id) + t * attention) / (c(before) + t), where t is how many different ids follow.
Inside a word the same is done once more with the two ids before; there all ids that begin
a word count as one event, its end. So all ids together have probability 1. Texts are scored in overlapping windows: a window's
first tokens are context for the others, so each token is scored exactly once.

All of the model is learned from all training documents. Words, ids and pairs of ids are
counted over all of them. The pairs give the classes and the ids' vectors, the ids' counts the
shares. Pairs and triples
are the mixture's, all of them: the most frequent, as many as a fixed bound allows, are sent to all
executors, and tokens that need others wait until these have met their counts in a join. The
attention starts from a few epochs on ``fit`` documents (a parameter); from there, each shard
of the training documents trains a copy on all its tokens, and the copies' changes are
averaged, weighted by tokens. Shards are of bounded size and dealt by the rows' hash, so that
the model doesn't depend on how the table is partitioned.

Beside it stands a base: unigrams over whole words, counted over all training documents.
Words of high count are sent to all executors, as many as a fixed bound allows; all other
words meet their counts in a join.

Every text is read and coded once; counting, training and scoring read the codes.

Defined cases: null text counts as empty and has the end token alone; equal rows get equal
scores; without training documents all counts are 0, V and N, too, and the model is flat; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_rows, batches, discard, id_bucket, materialise, word_places

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
IDS, END = 50_257, 50_256
END_WORD = np.uint64(0xE5D0F7E87)  # stands for the end token among word hashes
WINDOW, STRIDE, DIM, CLASSES = 16, 12, 8, 16
HOT = 1 << 17  # words sent to all executors, at most
WORD, ID, PAIR, TRIPLE = range(4)
TALLY = 1 << 18  # keys that a task keeps in a tally before it sums them
KEPT = 1 << 19  # pairs, and triples, of ids sent to all executors, at most
CHARS = 1 << 21
FREQUENT = 192  # ids whose neighbours tell ids apart
SHARD_WORDS = 1 << 19
RATE = 0.003


# --- subwords ---


class Subwords:
    """A vocabulary of subword ids, from the lines of its ranks file."""

    def __init__(self, ranks: bytes):
        import tiktoken

        known = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line.strip())}
        self.coder = tiktoken.Encoding("words", pat_str=r" ?[^ ]{1,48}", mergeable_ranks=known, special_tokens={})
        self.size, self.opens = np.zeros(IDS, np.int64), np.zeros(IDS, bool)  # bytes; which ids begin a word
        for raw, i in known.items():
            self.size[i], self.opens[i] = len(raw), raw.startswith(b" ")
        self.opens[END] = True

    @staticmethod
    def at(path: str) -> Subwords:
        with open(path, "rb") as f:
            return Subwords(f.read())

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids one after another, and how many each has. A word is coded with a blank before it."""
        text = b" ".join([b"", *words])
        clean = text.decode("utf-8", "replace")
        ids = np.array(self.coder.encode_ordinary(clean), np.int64)
        if len(clean.encode()) == len(text):
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        else:
            ends = np.cumsum([len(w.decode("utf-8", "replace").encode()) + 1 for w in words])
        last = np.searchsorted(np.cumsum(self.size[ids]), ends)
        return ids, np.diff(last, prepend=-1)


def sequences(texts, coder: Subwords):
    """All texts' ids with the end token after each, their n+1 bounds, the distinct word hashes, each word's place among them, and the n+1 word bounds."""
    hashes, bounds, start, end, raw = word_places(texts, lower=True)
    which, distinct = pd.factorize(hashes)
    at = np.empty(len(distinct), np.int64)
    at[which[::-1]] = np.arange(len(which) - 1, -1, -1)
    raw = raw.tobytes()
    ids, count = coder.of([raw[a:b] for a, b in zip(start[at].tolist(), end[at].tolist())]) if len(at) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    begin = np.cumsum(count) - count
    # the end token is the last of the ids; each text's words are followed by it
    texts_n = len(bounds) - 1
    slot = np.arange(len(which)) + np.repeat(np.arange(texts_n), np.diff(bounds))
    n, lo = np.ones(len(which) + texts_n, np.int64), np.full(len(which) + texts_n, len(ids))
    n[slot], lo[slot] = count[which], begin[which]
    ends = np.cumsum(n)
    flat = np.append(ids, END)[np.repeat(lo - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)]
    total = np.concatenate([[0], ends])[bounds + np.arange(texts_n + 1)]
    return flat, total, np.asarray(distinct, np.uint64), which, bounds


def tally(which: np.ndarray, bounds: np.ndarray, distinct: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct words (places) and their counts, one text after another, and the n+1 bounds."""
    key = np.repeat(np.arange(len(bounds) - 1) * max(1, distinct), np.diff(bounds)) + which
    key.sort()
    new = np.flatnonzero(np.diff(key, prepend=-1))
    text = key[new] // max(1, distinct)
    return key[new] % max(1, distinct), np.diff(np.append(new, len(key))), np.searchsorted(text, np.arange(len(bounds)))


# --- the model ---


def before(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The id before each; a text begins after an end token."""
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[bounds[:-1]] = END
    return out


def tallied(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and their counts."""
    code = np.sort(code)
    new = np.flatnonzero(np.diff(code, prepend=-1))
    return code[new], np.diff(np.append(new, len(code)))


def followers(ids: np.ndarray, bounds: np.ndarray, opens: np.ndarray):
    """Codes and counts of ids with the one before, and of ``triples_of``."""
    first = before(ids, bounds)
    return tallied(first * IDS + ids), tallied(triples_of(ids, first, opens)[1])


def neighbours(count: np.ndarray, code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids that are frequent enough, and beside which frequent ids each stands: root shares of those before and after it."""
    top, seen = np.argsort(-count, kind="stable")[:FREQUENT], np.flatnonzero(count >= 5)
    column, row = np.full(IDS, -1), np.full(IDS, -1)
    column[top], row[seen] = np.arange(len(top)), np.arange(len(seen))
    x = np.zeros((2, len(seen), FREQUENT), np.float32)
    for side, (own, other) in enumerate(((code % IDS, code // IDS), (code // IDS, code % IDS))):
        ok = (row[own] >= 0) & (column[other] >= 0)
        x[side][row[own[ok]], column[other[ok]]] = n[ok]
    return seen, np.concatenate(list(np.sqrt(x / np.maximum(1, x.sum(axis=2, keepdims=True)))), axis=1)


def classes(seen: np.ndarray, x: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A class for each id: k-means on the ids before it. Seldom ids are dealt out."""
    rng, x, out = np.random.default_rng(3), x[:, :FREQUENT], np.arange(IDS) % CLASSES
    if len(seen) < CLASSES:
        return out
    centre = x[np.argsort(-count[seen], kind="stable")[:CLASSES]]
    for _ in range(8):
        own = (x @ centre.T - (centre**2).sum(axis=1) / 2).argmax(axis=1)
        for c in range(CLASSES):
            centre[c] = x[own == c].mean(axis=0) if (own == c).any() else x[rng.integers(len(x))]
    out[seen] = own
    return out


def vectors(seen: np.ndarray, x: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A vector for each id: its neighbours' principal components, each of variance 1 over the text. 0 for seldom ids."""
    out, w = np.zeros((IDS, DIM), np.float32), count[seen].astype(np.float64)
    if len(seen) <= DIM:
        return out
    mean = w @ x / w.sum()
    value, axis = np.linalg.eigh((x * (w / w.sum())[:, None]).T @ x - np.outer(mean, mean))
    axis = axis[:, ::-1][:, :DIM]
    axis *= np.where(axis[np.abs(axis).argmax(axis=0), np.arange(DIM)] < 0, -1, 1)
    out[seen] = np.clip((x - mean) @ axis / np.sqrt(np.maximum(value[::-1][:DIM], 1e-6)), -4, 4)
    return out


def windows(ids: np.ndarray, bounds: np.ndarray, stride: int = STRIDE):
    """Windows' inputs, the places of the tokens they score, and which are scored in each.

    Token t is predicted from inputs up to t-1; the first input of a text is the end token.
    """
    length, bounds, ids = np.diff(bounds).astype(np.int32), bounds.astype(np.int32), ids.astype(np.int32)
    per = np.maximum(1, -(-np.maximum(0, length - WINDOW) // stride) + 1)
    text = np.repeat(np.arange(len(length), dtype=np.int32), per)
    k = (np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)).astype(np.int32)
    step = np.arange(WINDOW, dtype=np.int32)
    target = (k * stride)[:, None] + step  # token's number in its text
    valid = target < length[text][:, None]
    scored = valid & ((step >= WINDOW - stride) | (k == 0)[:, None])
    goal = np.where(valid, target, 0) + bounds[text][:, None]
    source = np.where((target == 0) | ~valid, np.int32(END), ids[np.maximum(goal - 1, 0)])
    return source, goal, scored


_STEP = np.arange(WINDOW)
_BACK = np.maximum(_STEP[:, None] - _STEP[None, :], 0)
_MASK = np.where(_STEP[:, None] >= _STEP[None, :], 0, -1e9).astype(np.float32)


def softmax(x: np.ndarray) -> np.ndarray:
    """Over the last axis; exponents are bounded, as a greatest one costs more to find than all the rest."""
    x = np.exp(np.minimum(x, 60))
    x /= sums(x)
    return x


def sums(x: np.ndarray) -> np.ndarray:
    """Sums over the last axis, kept, as a product."""
    return x @ np.ones((x.shape[-1], 1), np.float32)


def start() -> dict[str, np.ndarray]:
    """Parameters before training: queries, keys, values and the straight way side by side, their output, and biases."""
    rng = np.random.default_rng(1)
    p = {"W": rng.normal(0, DIM**-0.5, (DIM, 4 * DIM)), "O": rng.normal(0, 0.2, (DIM, CLASSES)), "o": np.zeros(CLASSES), "b": np.zeros(WINDOW)}
    return {k: v.astype(np.float32) for k, v in p.items()}


def gradients(p: dict[str, np.ndarray], E: np.ndarray, src: np.ndarray, want: np.ndarray, use: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean loss of some windows' scored tokens: inputs, classes to be predicted, weights."""
    D_, scale = DIM, np.float32(DIM**-0.5)
    X = E[src]
    Q, K, V, R = np.split(X.reshape(-1, D_) @ p["W"], 4, axis=1)
    shape = (*src.shape, D_)
    Q, K, V = (np.ascontiguousarray(a).reshape(shape) for a in (Q, K, V))
    A = softmax(Q @ K.transpose(0, 2, 1) * scale + p["b"][_BACK] + _MASK)
    Y = R.reshape(shape) + A @ V
    D = softmax(Y.reshape(-1, D_) @ p["O"] + p["o"])
    D[np.arange(len(D)), want.ravel()] -= 1
    D *= (use / max(1.0, use.sum())).reshape(-1, 1).astype(np.float32)
    g = {"O": Y.reshape(-1, D_).T @ D, "o": np.ones(len(D), np.float32) @ D}
    dY = (D @ p["O"].T).reshape(shape)
    dA, dV = dY @ V.transpose(0, 2, 1), A.transpose(0, 2, 1) @ dY
    dS = A * (dA - sums(dA * A))
    g["b"] = np.bincount(_BACK.ravel(), (dS.sum(axis=0) * (_MASK == 0)).ravel(), WINDOW).astype(np.float32)
    dS *= scale
    d = np.concatenate([a.reshape(-1, D_) for a in (dS @ K, dS.transpose(0, 2, 1) @ Q, dV, dY)], axis=1)
    g["W"] = X.reshape(-1, D_).T @ d
    return g


def fitted(p: dict[str, np.ndarray], E: np.ndarray, kind: np.ndarray, ids: np.ndarray, bounds: np.ndarray, epochs: int = 3, batch: int = 256, rate: float = 0.01) -> dict[str, np.ndarray]:
    """Parameters trained further on some texts, each of whose tokens is predicted once an epoch."""
    rng = np.random.default_rng(1)
    p = {k: v.copy() for k, v in p.items()}
    m, v, t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    if not len(ids):
        return p
    source, goal, scored = windows(ids, bounds, WINDOW)
    want = kind.astype(np.int32)[ids[goal]]
    for _ in range(epochs):
        order = rng.permutation(len(source))
        for s in range(0, len(order), batch):
            own = order[s : s + batch]
            t += 1
            for k, d in gradients(p, E, source[own], want[own], scored[own]).items():
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.99 * v[k] + 0.01 * d * d
                p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    return p


class Counts:
    """Counts by code, found by hash: codes of a slot lie one after another. more: other numbers by code."""

    def __init__(self, code: np.ndarray, n: np.ndarray, *more: np.ndarray):
        self.bits = max(4, int(2 * max(1, len(code)) - 1).bit_length())
        slot = self.slot(code)
        order = np.argsort(slot, kind="stable")
        self.code, self.none = np.append(code[order], -1), len(code)
        self.n, *self.more = (np.append(x[order], 0).astype(np.float32) for x in (n, *more))
        self.begin = np.searchsorted(slot[order], np.arange((1 << self.bits) + 1)).astype(np.int32)

    def slot(self, code: np.ndarray) -> np.ndarray:
        return (code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, code: np.ndarray) -> np.ndarray:
        """Places, the last one (of count 0) for codes that aren't there."""
        slot, none = self.slot(code), len(self.code) - 1
        at, end = self.begin[slot], self.begin[slot + 1]
        at[at >= end] = none
        left = np.flatnonzero((self.code[at] != code) & (at < none))
        while len(left):
            here = at[left] + 1
            here[here >= end[left]] = none
            at[left] = here
            left = left[(self.code[here] != code[left]) & (here < none)]
        return at


class Memory:
    """How often ids follow the id before them, and how often ids, or ends of the word, follow two ids of a word.

    pairs and triples may be a part of all: then pairs have with them how many triples begin with them, and how many
    kinds of these, sums are the three of each id over all pairs (see ``followed``), and whole tells which table has all.
    """

    def __init__(self, pairs: Counts, triples: Counts, opens: np.ndarray, sums=None, whole: tuple[bool, bool] = (True, True)):
        self.pairs, self.triples, self.opens, self.whole = pairs, triples, opens, whole
        self.total, self.kinds, self.begun = (x.astype(np.float32) for x in (sums or followed(pairs.code[:-1], pairs.n[:-1], opens)))
        if pairs.more:
            self.total3, self.kinds3 = pairs.more
            return
        at = pairs.find(triples.code[:-1] // IDS)
        self.total3, self.kinds3 = (np.bincount(at, w, pairs.none + 1).astype(np.float32) for w in (triples.n[:-1], None))
        self.total3[-1] = self.kinds3[-1] = 0

    def places(self, ids: np.ndarray, first: np.ndarray):
        """Places of the pairs; which ids are inside a word, and the codes and places of their triples."""
        inner, code = triples_of(ids, first, self.opens)
        return self.pairs.find(first * IDS + ids), inner, code, self.triples.find(code)

    def mixed(self, p: np.ndarray, q: np.ndarray, ids: np.ndarray, first: np.ndarray, places=None) -> np.ndarray:
        """Probabilities of ids after ``first``, from the attention's (p), and its probability that a word begins (q)."""
        place, inner, _, triple = places or self.places(ids, first)
        p = self.after(p, first, self.pairs.n[place])
        before = place[inner - 1]
        p[inner] = self.inside(p[inner], q[inner], first[inner], self.opens[ids[inner]], self.triples.n[triple], self.total3[before], self.kinds3[before])
        return p

    def after(self, p: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
        return blended(n, self.total[first], self.kinds[first], p)

    def inside(self, p: np.ndarray, q: np.ndarray, own: np.ndarray, begins: np.ndarray, n: np.ndarray, total: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Probabilities inside a word, from those after one id (p); n, total and kinds are of the triple and the two ids before."""
        q = np.maximum(blended(self.begun[own], self.total[own], self.kinds[own], q), 1e-30)
        event = blended(n, total, kinds, np.where(begins, q, p))
        return np.where(begins, event * p / q, event)

    def waiting(self, ids: np.ndarray, first: np.ndarray, places) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of ids whose counts aren't all here, and the places and keys of what they ask for: codes of pairs, -1 less those of triples."""
        place, inner, code, triple = places
        known = self.kinds[first] > 0
        pair = np.flatnonzero((place == self.pairs.none) & known & (not self.whole[0]))
        lacks = (place[inner - 1] == self.pairs.none) & known[inner - 1] & (not self.whole[0])
        third = (triple == self.triples.none) & (lacks | (self.kinds3[place[inner - 1]] > 0)) & (not self.whole[1])
        at = np.concatenate([pair, inner[lacks], inner[third]])
        return np.unique(at), at, np.concatenate([first[pair] * IDS + ids[pair], code[lacks] // IDS, -1 - code[third]])

    def settled(self, p: np.ndarray, q: np.ndarray, code: np.ndarray, key: np.ndarray, c: np.ndarray, total: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """``mixed`` for single ids, of code (two before, one before, id), with the counts that they have met: key in order, and what goes with it."""
        two, ids = code // IDS, code % IDS
        first = two % IDS

        def met(of, counts, here):
            at = np.minimum(np.searchsorted(key, of), max(0, len(key) - 1))
            hit = key[at] == of if len(key) else np.zeros(len(of), bool)
            return [np.where(place < table.none, own[place], np.where(hit, x[at] if len(key) else 0, 0)).astype(np.float32) for place, table in [here] for own, x in counts]

        pair = first * IDS + ids
        p = self.after(p, first, met(pair, [(self.pairs.n, c)], (self.pairs.find(pair), self.pairs))[0])
        inner = np.flatnonzero(~self.opens[first])
        begins = self.opens[ids[inner]]
        triple = two[inner] * IDS + np.where(begins, END, ids[inner])
        n = met(-1 - triple, [(self.triples.n, c)], (self.triples.find(triple), self.triples))[0]
        both = met(two[inner], [(self.total3, total), (self.kinds3, kinds)], (self.pairs.find(two[inner]), self.pairs))
        p[inner] = self.inside(p[inner], q[inner], first[inner], begins, n, *both)
        return p


def followed(code: np.ndarray, n: np.ndarray, opens: np.ndarray) -> list[np.ndarray]:
    """Of each id as the first of pairs: their number, their kinds, and the number of those that begin a word."""
    begun = opens[code % IDS]
    return [np.bincount(code // IDS, n, IDS), np.bincount(code // IDS, None, IDS), np.bincount(code[begun] // IDS, n[begun], IDS)]


def blended(n: np.ndarray, total: np.ndarray, kinds: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Counts n out of total, with p for as much as there are different kinds."""
    return np.where(kinds > 0, (n + kinds * p) / np.maximum(1, total + kinds), p)


def triples_of(ids: np.ndarray, first: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ids after the second or a later id of a word, and codes of the two before and what follows; all that begin a word are one."""
    inner = np.flatnonzero(~opens[first])
    return inner, (first[inner - 1] * IDS + first[inner]) * IDS + np.where(opens[ids[inner]], END, ids[inner])


def tables(p: dict[str, np.ndarray], E: np.ndarray, kind: np.ndarray, count: np.ndarray, memory: Memory) -> dict:
    """The model's tables for scoring; count: how often each id occurs."""
    count = count + 0.02
    share = count / np.bincount(kind, count, CLASSES)[kind]
    sides = np.stack([np.ones(CLASSES), np.bincount(kind, share * memory.opens, CLASSES)], axis=1)  # all of a class, and what begins a word
    QKVR = (E @ p["W"]).astype(np.float32)
    out = {k: np.ascontiguousarray(a) for k, a in zip("QKVR", np.split(QKVR, 4, axis=1))} | {k: p[k].copy() for k in "Oob"}
    out["Q"] *= np.float32(DIM**-0.5)
    out["o"][np.bincount(kind, minlength=CLASSES) == 0] = -60
    return out | {"kind": kind.astype(np.int32), "share": np.log(share).astype(np.float32), "sides": sides.astype(np.float32), "memory": memory}


def trained(ids: np.ndarray, bounds: np.ndarray, opens: np.ndarray, epochs: int = 3) -> dict:
    """The tables of a model of these texts alone."""
    count, (pairs, triples) = np.bincount(ids, minlength=IDS), followers(ids, bounds, opens)
    seen, x = neighbours(count, *pairs)
    kind, E = classes(seen, x, count), vectors(seen, x, count)
    return tables(fitted(start(), E, kind, ids, bounds, epochs), E, kind, count, Memory(Counts(*pairs), Counts(*triples), opens))


def attended(model: dict, ids: np.ndarray, bounds: np.ndarray, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """The attention's natural log probability of each token, and the probability that a word begins there."""
    out, begins = np.zeros(len(ids), np.float32), np.zeros(len(ids), np.float32)
    bias, ones = model["b"][_BACK] + _MASK, np.ones((block, WINDOW, 1), np.float32)
    for a in range(0, len(bounds) - 1, 2048):
        some = bounds[a : a + 2049]
        source, goal, scored = windows(ids[some[0] : some[-1]], some - some[0])
        goal += some[0]
        whole = scored[:, 0]  # a text's first window; of the others, the last tokens alone are scored
        for own, q in ((np.flatnonzero(whole), 0), (np.flatnonzero(~whole), WINDOW - STRIDE)):
            for s in range(0, len(own), block):
                k = own[s : s + block]
                src, at, use = source[k], goal[k, q:], scored[k, q:]
                S = model["Q"][src[:, q:]] @ model["K"][src].transpose(0, 2, 1)
                S += bias[q:]
                np.exp(np.minimum(S, 60, out=S), out=S)
                V = S @ np.concatenate([model["V"][src], ones[: len(k)]], axis=2)
                Y = V[..., :DIM][use] / V[..., DIM:][use] + model["R"][src[:, q:][use]]
                L = Y @ model["O"]
                L += model["o"]
                np.clip(L, -60, 60, out=L)
                want = ids[at[use]]
                picked = L[np.arange(len(want)), model["kind"][want]]
                both = np.exp(L, out=L) @ model["sides"]
                out[at[use]] = picked - np.log(both[:, 0]) + model["share"][want]
                begins[at[use]] = both[:, 1] / both[:, 0]
    return out, begins


def scores(model: dict, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Natural log probability of each text."""
    return parts(model, ids, bounds)[0]


def parts(model: dict, ids: np.ndarray, bounds: np.ndarray):
    """Natural log probability of each text without the ids that wait for counts; these ids' texts, codes (see ``settled``),
    attention's probabilities and those that a word begins there; texts and keys of what they ask for."""
    memory = model["memory"]
    if len(bounds) < 2:
        return np.zeros(0), *[np.zeros(0, np.int64)] * 6
    p, q = attended(model, ids, bounds)
    p, first = np.exp(p), before(ids, bounds)
    places = memory.places(ids, first)
    log = np.log(memory.mixed(p, q, ids, first, places).astype(np.float64))
    open_, at, key = memory.waiting(ids, first, places)
    log[open_] = 0
    two = np.where(memory.opens[first[open_]], END, first[open_ - 1])
    text = lambda x: np.searchsorted(bounds, x, side="right") - 1
    return np.add.reduceat(log, bounds[:-1]), text(open_), (two * IDS + first[open_]) * IDS + ids[open_], p[open_], q[open_], text(at), key


# --- whole tables ---

CODED = "rid long, train boolean, ids binary, h binary, n binary"


def coded(docs: DataFrame, vocabulary) -> DataFrame:
    """doc_id, row (a number of its own), rid, train, the text's ids (2 bytes each), its distinct words' hashes and their counts."""

    def make(frames):
        coder = Subwords(vocabulary.value)
        for pdf in batches(frames, CHARS):
            ids, bounds, distinct, which, wb = sequences(pdf["text"].tolist(), coder)
            ids, names = ids.astype(np.uint16), distinct.view(np.int64)
            word, n, tb = tally(which, wb, len(distinct))
            h, n = names[word], n.astype(np.uint32)
            out = pdf[["doc_id", "rid", "train"]].copy()
            out["ids"] = [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            out["h"] = [h[a:b].tobytes() for a, b in zip(tb[:-1], tb[1:])]
            out["n"] = [n[a:b].tobytes() for a, b in zip(tb[:-1], tb[1:])]
            yield out

    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(CODED)])
    return docs.select("doc_id", "rid", "train", "text").mapInPandas(make, schema).withColumn("row", F.monotonically_increasing_id())


def unpacked(column, kind) -> tuple[np.ndarray, np.ndarray]:
    """A binary column's numbers one after another, and the n+1 bounds."""
    bounds = np.zeros(len(column) + 1, np.int64)
    np.cumsum([len(b) for b in column], out=bounds[1:])
    return np.frombuffer(b"".join(column), kind), bounds // np.dtype(kind).itemsize


def sized_batches(frames, limit: int):
    """Frames of codes put together or cut to about ``limit`` ids each."""
    kept, size = [], 0
    for pdf in frames:
        each = pdf["ids"].str.len().to_numpy() // 2
        part = (size + np.cumsum(each)) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(pdf)]
        for a, b in zip(cuts, cuts[1:]):
            if kept and size + each[a:b].sum() > limit:
                yield pd.concat(kept)
                kept, size = [], 0
            kept.append(pdf.iloc[a:b])
            size += each[a:b].sum()
    if kept:
        yield pd.concat(kept)


class Tally:
    """Counts by key, kept as they come and summed now and then."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, key: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((key, n))
        self.size += len(key)
        if self.size > TALLY and len(self.parts) > 1:
            self.parts = [self.summed()]
            self.size = len(self.parts[0][0])

    def summed(self) -> tuple[np.ndarray, np.ndarray]:
        key, n = (np.concatenate([x[k] for x in self.parts] or [np.zeros(0, np.int64)]) for k in (0, 1))
        order = np.argsort(key)
        key = key[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else order
        return key[new], np.add.reduceat(n[order], new) if len(new) else n


def counted(codes: DataFrame, opens: np.ndarray) -> DataFrame:
    """what (WORD by hash, ID, PAIR, TRIPLE by code), key, c: counts over the training rows; the end is a word, too."""

    def make(frames):
        tallies, ends = [Tally() for _ in range(4)], 0
        frame = lambda what, key, n: pd.DataFrame({"what": np.full(len(key), what, np.int32), "key": key, "n": n})
        for pdf in sized_batches(frames, 1 << 19):
            ids, bounds = unpacked(pdf["ids"], np.uint16)
            ids, ends = ids.astype(np.int64), ends + len(pdf)
            n = np.bincount(ids, minlength=IDS)
            tallies[ID].add(np.flatnonzero(n), n[n > 0])
            for what, found in zip((PAIR, TRIPLE), followers(ids, bounds, opens)):
                tallies[what].add(*found)
            which, names = pd.factorize(unpacked(pdf["h"], np.int64)[0])
            tallies[WORD].add(names, np.bincount(which, unpacked(pdf["n"], np.uint32)[0], len(names)).astype(np.int64))
            for what, tally_ in enumerate(tallies):
                if tally_.size > TALLY:  # that many different keys
                    yield frame(what, *tally_.summed())
                    tallies[what] = Tally()
        for what, tally_ in enumerate(tallies):
            yield frame(what, *tally_.summed())
        yield frame(WORD, END_WORD.reshape(1).view(np.int64)[: ends > 0], np.full(int(ends > 0), ends))

    rows = codes.where("train").select("ids", "h", "n").mapInPandas(make, "what int, key long, n long")
    return rows.groupBy("what", "key").agg(F.sum("n").alias("c"))


def most_frequent(counts: DataFrame, bound: int) -> tuple[np.ndarray, ...]:
    """Keys in order and counts, and what else there is by key, of all that occur 2**k times or more, for the least k that keeps them under the bound."""
    tails = counts.agg(*[F.count_if(F.col("c") >= 2**k).alias(str(k)) for k in range(48)]).first()
    k = next(k for k in range(48) if (tails[str(k)] or 0) <= bound)
    more = [c for c in counts.columns if c not in ("what", "key", "c")]
    found = [x.to_numpy() for x in counts.where(F.col("c") >= 2**k).select("key", "c", *more).toArrow().columns]
    order = np.argsort(found[0])
    return tuple(x[order] for x in found)


def contexts(counts: DataFrame) -> DataFrame:
    """key, c of all pairs, with total and kinds: how many triples begin with the pair, and how many different ones."""
    first = counts.where(F.col("what") == TRIPLE).groupBy(F.expr(f"key div {IDS}").alias("key")).agg(F.sum("c").alias("total"), F.count("*").alias("kinds"))
    return counts.where(F.col("what") == PAIR).select("key", "c").join(first, "key", "left").fillna(0, ["total", "kinds"])


def sums_of(pairs: DataFrame, opens: np.ndarray) -> list[np.ndarray]:
    """``followed`` over all pairs."""

    def make(frames):
        for pdf in frames:
            total, kinds, begun = followed(pdf["key"].to_numpy(), pdf["c"].to_numpy(), opens)
            at = np.flatnonzero(kinds)
            yield pd.DataFrame({"id": at, "total": total[at], "kinds": kinds[at], "begun": begun[at]})

    names = ["total", "kinds", "begun"]
    rows = pairs.select("key", "c").mapInPandas(make, "id long, total long, kinds long, begun long")
    found = rows.groupBy("id").agg(*[F.sum(x).alias(x) for x in names]).toArrow()
    out = [np.zeros(IDS) for _ in names]
    for x, name in zip(out, names):
        x[found["id"].to_numpy()] = found[name].to_numpy()
    return out


def averaged(codes: DataFrame, p: dict[str, np.ndarray], E: np.ndarray, kind: np.ndarray, shards: int) -> dict[str, np.ndarray]:
    """The parameters p trained further on all training rows: the mean change of the shards' copies."""
    sent = codes.sparkSession.sparkContext.broadcast((p, E, kind))
    names = sorted(p)

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        old, E, kind = sent.value
        ids, bounds = unpacked(pdf.sort_values("rid")["ids"], np.uint16)
        new = fitted(old, E, kind, ids.astype(np.int64), bounds, epochs=1, rate=RATE)
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "w": [len(ids)], "change": [np.concatenate([(new[k] - old[k]).ravel() for k in names]).astype(float).tolist()]})

    rows = codes.where("train").select("rid", "ids", F.pmod(F.xxhash64("rid"), F.lit(shards)).alias("shard"))
    rows = rows.groupBy("shard").applyInPandas(train, "shard long, w long, change array<double>")
    # sums of whole numbers, so that their order doesn't matter
    place = rows.select("w", F.posexplode("change").alias("at", "x")).select("w", "at", F.round(F.col("x") * 2**32).cast("decimal(20,0)").alias("x"))
    found = place.groupBy("at").agg((F.sum(F.col("x") * F.col("w").cast("decimal(18,0)")) / F.sum("w")).cast("double").alias("x")).orderBy("at").collect()
    out, at, change = {}, 0, np.array([r["x"] for r in found]) / 2**32
    for k in names:
        out[k] = (p[k] + (change[at : at + p[k].size].reshape(p[k].shape) if len(change) else 0)).astype(np.float32)
        at += p[k].size
    return out


def learned(codes: DataFrame, counts: DataFrame, pairs: DataFrame, opens: np.ndarray, words: int, fit: int) -> dict:
    """The model's tables from all training rows. pairs: of ``contexts``; words: how many words these have."""
    key, c = most_frequent(counts.where(F.col("what") == ID), IDS)
    count = np.zeros(IDS, np.int64)
    count[key] = c
    top = np.argsort(-count, kind="stable")[:FREQUENT].tolist()
    near = pairs.where((F.col("key") % IDS).isin(top) | F.expr(f"key div {IDS}").isin(top))  # at most 2 * FREQUENT an id
    seen, x = neighbours(count, *[x.to_numpy() for x in near.select("key", "c").toArrow().columns])
    kind, E = classes(seen, x, count), vectors(seen, x, count)
    triples = counts.where(F.col("what") == TRIPLE)
    hot = [most_frequent(x, KEPT) for x in (pairs, triples)]
    memory = Memory(*[Counts(*x) for x in hot], opens, sums_of(pairs, opens), tuple(len(x[0]) == all_.count() for x, all_ in zip(hot, (pairs, triples))))
    few = codes.where("train").select("rid", "ids").orderBy("rid", "ids").limit(fit).collect() if fit else []
    ids, bounds = unpacked([bytes(r["ids"]) for r in few], np.uint16)
    p = fitted(start(), E, kind, ids.astype(np.int64), bounds)
    return tables(averaged(codes, p, E, kind, words // SHARD_WORDS + 1), E, kind, count, memory)


def found(hot: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places in hot, -1 for others."""
    if not len(hot):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
    return np.where(hot[at] == h, at, -1)


def score(docs: DataFrame, fit: int = 400, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row."""
    with arrow_rows(docs.sparkSession, 1000):
        return _score(docs, fit, vocabulary)


def _score(docs: DataFrame, fit: int, vocabulary: str) -> DataFrame:
    context = docs.sparkSession.sparkContext
    with open(vocabulary, "rb") as f:
        ranks = f.read()
    opens, ranks = Subwords(ranks).opens, context.broadcast(ranks)
    held = id_bucket(F.col("doc_id"), 5) == 1
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rid"), (~held).alias("train"))
    codes = materialise(coded(docs, ranks), "lm-coded", dense=True)
    counts = materialise(counted(codes, opens), "lm-counts", by="what")
    words = counts.where(F.col("what") == WORD).select("key", "c")
    N, V = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    hot = context.broadcast(most_frequent(words, HOT))
    pairs = materialise(contexts(counts), "lm-pairs")
    model = context.broadcast(learned(codes, counts, pairs, opens, N, fit))

    def make(frames):
        names, c = hot.value
        value = np.append(np.log10((c + 0.5) / (N + 0.5 * (V + 1))), 0)
        for pdf in sized_batches(frames, 1 << 19):
            ids, bounds = unpacked(pdf["ids"], np.uint16)
            h, wb = unpacked(pdf["h"], np.int64)
            n = unpacked(pdf["n"], np.uint32)[0].astype(np.int64)
            at = found(names, h)
            rare = at < 0
            total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[wb])
            out = pdf[["doc_id", "row", "train"]].copy()
            out["n_tokens"] = total(n) + 1
            out["hot_known"] = total(np.where(rare, 0, n))
            own = n * value[at]
            out["hot_sum"] = [own[a:b].sum() for a, b in zip(wb[:-1], wb[1:])]
            out["score"], text, *waiting, asking, keys = parts(model.value, ids.astype(np.int64), bounds)
            cuts = np.searchsorted(text, np.arange(len(bounds)))
            for name, x in zip(("code", "p", "q"), waiting):
                out[name] = [x[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            order = np.lexsort((keys, asking))
            asking, keys = asking[order], keys[order]
            new = np.concatenate([[True], (asking[1:] != asking[:-1]) | (keys[1:] != keys[:-1])])[: len(keys)]
            asking, keys = asking[new], keys[new]
            cuts = np.searchsorted(asking, np.arange(len(bounds)))
            out["asks"] = [keys[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
            out["rare"] = [h[a:b][r] for a, b, r in ((a, b, rare[a:b]) for a, b in zip(wb[:-1], wb[1:]))]
            out["times"] = [n[a:b][r] for a, b, r in ((a, b, rare[a:b]) for a, b in zip(wb[:-1], wb[1:]))]
            yield out

    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("row long, train boolean, n_tokens long, hot_known long, hot_sum double, score double, code binary, p binary, q binary, asks array<long>, rare array<long>, times array<long>")])
    scored = materialise(codes.select("doc_id", "row", "train", "ids", "h", "n").mapInPandas(make, schema), "lm-scored")
    discard(codes)
    base = lambda c: F.log10((c + 0.5) / (N + 0.5 * (V + 1)))
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("key"), F.col("x.times").alias("n"))
    rare = rare.join(words, "key", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    rare = rare.groupBy("row").agg(F.sum(F.col("n") * base(F.col("c"))).alias("rare_sum"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"))
    rare = materialise(rare, "lm-rare")
    triples = counts.where(F.col("what") == TRIPLE).select((-1 - F.col("key")).alias("key"), "c", F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("kinds"))
    met = scored.select("row", F.explode("asks").alias("key")).join(pairs.unionByName(triples), "key")
    met = met.groupBy("row").agg(F.collect_list(F.struct("key", "c", "total", "kinds")).alias("met"))
    ends = words.where(F.col("key") == int(END_WORD)).agg(F.coalesce(F.max("c"), F.lit(0)).alias("ends")).first()["ends"]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    whole = scored.drop("rare", "times", "asks").join(rare, "row", "left").join(met, "row", "left")
    kept = [c for c in whole.columns if c not in ("row", "code", "p", "q", "met")]

    def settle(batches):
        memory = model.value["memory"]
        for batch in batches:
            code, bounds = unpacked(batch["code"].to_pylist(), np.int64)
            p, q = (unpacked(batch[x].to_pylist(), np.float32)[0] for x in "pq")
            key, c, total, kinds = (x.to_numpy() for x in batch["met"].flatten().flatten())
            key, at = np.unique(key, return_index=True)
            log = np.log(memory.settled(p, q, code, key, c[at], total[at], kinds[at]).astype(np.float64))
            text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            score = (batch["score"].to_numpy() + np.bincount(text, log, len(bounds) - 1)) / np.log(10)
            yield pa.RecordBatch.from_arrays([pa.array(score) if x == "score" else batch[x] for x in kept], kept)

    return whole.mapInArrow(settle, whole.select(*kept).schema).select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        (F.col("hot_known") + zero("rare_known") + int(ends > 0)).alias("n_known"),
        F.lit(int(N)).cast("long").alias("train_tokens"),
        (F.col("hot_sum") + zero("rare_sum") + base(F.lit(int(ends)))).alias("base_score"),
        "score",
    )
