"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 that depends on its code point only. The
vector of a letter trigram binds (multiplies) its letters' vectors, permuted (rotated) by
their place; a document's vector bundles (adds) the vectors of all its trigrams, and a
language's prototype bundles its training documents, each scaled to length 1. The
prediction is the prototype of highest cosine. Words are padded with a blank.

Prototypes are fitted on ``per_lang`` documents of each language at most, those of smallest
hash; this bound is a parameter. All documents are predicted, from whole texts.

Defined cases: text that is null or has no letter gives ``und`` with score 0, as does
anything if no language was learned; ties go to the language of lowest code points; null
ids are kept; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, id_bucket, mix64

DIM = 1024
UND = "und"


class Profiles:
    """Vectors of trigrams, made when needed; at most ``keep`` are kept."""

    def __init__(self, dim: int = DIM, keep: int = 40_000):
        self.dim, self.keep, self.letters = dim, keep, {}
        self.codes, self.rows = np.zeros(0, np.uint64), np.zeros((0, dim), np.float32)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            bits = mix64(np.arange(self.dim // 64, dtype=np.uint64) + np.uint64(code << 16) + np.uint64(1 << 62))
            self.letters[code] = np.unpackbits(bits.view(np.uint8)).astype(np.int8) * 2 - 1
        return self.letters[code]

    def of(self, codes: np.ndarray) -> np.ndarray:
        """Places in ``rows`` of sorted distinct trigram codes."""
        new = codes[~np.isin(codes, self.codes, assume_unique=True)]
        if len(new):
            if len(self.codes) + len(new) > self.keep:
                self.codes, self.rows, new = np.zeros(0, np.uint64), np.zeros((0, self.dim), np.float32), codes
            made = np.ones((len(new), self.dim), np.int8)
            for place in range(3):
                values, which = np.unique((new >> np.uint64(21 * place)) & np.uint64(0x1FFFFF), return_inverse=True)
                made *= np.stack([np.roll(self.letter(int(v)), place) for v in values])[which]
            codes_all = np.concatenate([self.codes, new])
            order = np.argsort(codes_all)
            self.codes, self.rows = codes_all[order], np.concatenate([self.rows, made.astype(np.float32)])[order]
        return np.searchsorted(self.codes, codes)

    def vectors(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """The texts' bundles, and which texts have a letter."""
        raw = [" " + (t or "").lower() + " " for t in texts]
        points = np.frombuffer("".join(raw).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(len(raw), dtype=np.uint64), [len(t) for t in raw])
        known = np.unique(points)
        alpha = known[[chr(p).isalpha() for p in known]] if len(known) else known
        at = np.searchsorted(alpha, points)
        is_letter = np.zeros(len(points), bool)
        if len(alpha):
            is_letter = alpha[np.minimum(at, len(alpha) - 1)] == points
        some = np.bincount(owner[is_letter].astype(np.int64), minlength=len(raw)) > 0
        keep = is_letter | np.concatenate([[True], is_letter[:-1] | (owner[1:] != owner[:-1])])  # one blank before each text and after each word
        letters, owner = np.where(is_letter, points, 32)[keep].astype(np.uint64), owner[keep]
        out = np.zeros((len(raw), self.dim), np.float32)
        if not len(alpha):
            return out, some
        same = (owner[2:] == owner[:-2]) & (letters[1:-1] != 32)
        code = (letters[:-2] | letters[1:-1] << np.uint64(21) | letters[2:] << np.uint64(42))[same]
        owner = owner[2:][same]
        distinct, which = np.unique(code, return_inverse=True)
        if len(distinct) > self.keep:  # too many to hold: in halves of the texts, or of one text's trigrams
            half = len(raw) // 2
            if half:
                a, b = self.vectors(texts[:half]), self.vectors(texts[half:])
                return np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
            for part in np.array_split(distinct, len(distinct) // self.keep + 1):
                lo, hi = np.searchsorted(distinct, part[[0, -1]])
                n = np.bincount(which[(which >= lo) & (which <= hi)] - lo, minlength=len(part)).astype(np.float32)
                out[0] += n @ self.rows[self.of(part)]
            return out, some
        place = self.of(distinct)
        pairs, n = np.unique(owner * np.uint64(len(distinct)) + which.astype(np.uint64), return_counts=True)
        who, what = (pairs // np.uint64(len(distinct))).astype(np.int64), (pairs % np.uint64(len(distinct))).astype(np.int64)
        ends = np.searchsorted(who, np.arange(len(raw) + 1))
        for d in range(len(raw)):
            a, b = ends[d], ends[d + 1]
            if b > a:
                out[d] = n[a:b].astype(np.float32) @ self.rows[place[what[a:b]]]
        return out, some


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def sample(docs: DataFrame, per_lang: int) -> DataFrame:
    """text and lang of the rows to learn from: null languages and the held-out bucket are left out.

    Rows are chosen by hashes, so that no text is shuffled but the chosen ones; equal rows count once.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_bucket(F.col("doc_id"), 4) != 2))
    rows = rows.select("lang", "text", F.xxhash64("doc_id", "text", "lang").alias("rid"))
    order = Window.partitionBy("lang").orderBy("rid")
    chosen = rows.select("lang", "rid").withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= per_lang).select("rid")
    # at most per_lang numbers a language
    return rows.join(F.broadcast(chosen), "rid", "left_semi").dropDuplicates(["rid"]).select("lang", "text")


def learn(docs: DataFrame, per_lang: int = 200) -> tuple[list[str], np.ndarray]:
    """Languages in code-point order and their prototypes; one short row a language reaches the driver."""

    def run(frames):
        profiles, sums = Profiles(), {}
        for pdf in batches(frames, 1 << 19):
            v, some = profiles.vectors(pdf["text"].tolist())
            v = unit(v)
            for lang in pdf["lang"].unique():
                sums[lang] = sums.get(lang, 0) + v[(pdf["lang"] == lang).to_numpy() & some].sum(axis=0, dtype=np.float64)
        if sums:
            yield pd.DataFrame({"lang": list(sums), "v": [x.tolist() for x in sums.values()]})

    parts = sample(docs, per_lang).mapInPandas(run, "lang string, v array<double>")
    total = parts.select("lang", F.posexplode("v")).groupBy("lang", "pos").agg(F.sum(F.round("col", 6)).alias("x"))
    rows = total.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v")).collect()
    rows = sorted(((r["lang"], [p["x"] for p in r["v"]]) for r in rows), key=lambda r: r[0])
    rows = [r for r in rows if any(r[1])]
    return [r[0] for r in rows], unit(np.array([r[1] for r in rows], np.float64)).astype(np.float32) if rows else np.zeros((0, DIM), np.float32)


def predict(docs: DataFrame, langs: list[str], protos: np.ndarray, keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """doc_id (or the columns ``keep``), and as ``names`` the language and its score (the cosine, 0 if negative)."""
    keep = keep or ["doc_id"]
    fields = [docs.schema[c] for c in keep]

    def run(frames):
        profiles = Profiles()
        for pdf in batches(frames, 1 << 19):
            v, some = profiles.vectors(pdf["text"].tolist())
            out = pdf[keep].copy()
            if langs:
                cos = unit(v) @ protos.T
                best = cos.argmax(axis=1)
                out[names[0]] = np.where(some, np.array(langs, object)[best], UND)
                out[names[1]] = np.where(some, np.clip(cos[np.arange(len(v)), best], 0, 1), 0).astype(np.float64)
            else:
                out[names[0]], out[names[1]] = UND, 0.0
            yield out

    from pyspark.sql import types as T

    schema = T.StructType([*fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInPandas(run, schema)


def identify(docs: DataFrame, per_lang: int = 200) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    langs, protos = learn(docs, per_lang)
    out = predict(docs, langs, protos)
    return out.select("doc_id", (id_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
