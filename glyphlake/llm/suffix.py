"""Suffix-array dedup: removes bytes that a repeated string of 200 bytes covers.

Suffixes are ordered only as far as 200 bytes, by passes over digits from the front (see
``repeats``); groups that are equal to that depth are exactly the repeated windows. All
places of a repeated window are removed, overlaps included, judged on the input.

Defined cases: null text counts as empty; texts under 200 bytes lose nothing; equal rows are
places of their own, so a row that stands twice loses all that windows cover; an empty
table gives no rows; other columns are ignored. A cut may split a character: the bytes are
exact, and ``kept_text`` drops the torn characters' bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, fresh
from .repeats import CHARS, Grain, covered, keyed, repeated

BYTES = Grain("bytes", 200, 64, (8, 1))


def removed(raw: bytes, spans, width: int) -> np.ndarray:
    """Marks the bytes that go."""
    lo = np.array([x["lo"] for x in spans], np.int64)
    return covered(len(raw), lo, lo + np.array([x["n"] for x in spans], np.int64) + width - 1)


def with_spans(docs: DataFrame, grain: Grain, spans: str = "__spans") -> DataFrame:
    """docs(doc_id, text, ...) with their repeated windows as the new column ``spans``; null where there are none."""
    key = fresh(docs, "rid")
    found = repeated(keyed(docs), grain).select(F.col("rid").alias(key), F.col("spans").alias(spans))
    return docs.withColumn(key, F.xxhash64("doc_id", "text")).join(found, key, "left").select(*docs.columns, spans)


def dedup(docs: DataFrame, grain: Grain = BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row."""

    def run(frames):
        for pdf in batches(frames, CHARS):
            rows = []
            for doc_id, text, spans in zip(pdf["doc_id"], pdf["text"], pdf["__spans"]):
                raw = (text or "").encode("utf-8", "surrogatepass")
                gone, kept, n = 0, raw, 0
                if spans is not None:
                    mark = removed(raw, spans, grain.width)
                    kept = np.frombuffer(raw, np.uint8)[~mark].tobytes()
                    gone, n = int(mark.sum()), int((np.diff(mark.astype(np.int8), prepend=0) == 1).sum())
                rows.append((len(raw), gone, n, hashlib.sha256(kept).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("n_bytes long, n_removed long, n_spans long, kept_sha256 string")])
    return with_spans(docs.select("doc_id", "text"), grain).select("doc_id", "text", "__spans").mapInPandas(run, schema)


def cleaned(docs: DataFrame, grain: Grain = BYTES) -> DataFrame:
    """All columns of docs, with repeated passages cut out of text; null text stays null."""
    columns, spans = docs.columns, fresh(docs, "spans")

    def run(frames):
        for pdf in batches(frames, CHARS):
            out = pdf.copy()
            out["text"] = [
                text if own is None or text is None else np.frombuffer(raw := text.encode("utf-8", "surrogatepass"), np.uint8)[~removed(raw, own, grain.width)].tobytes().decode("utf-8", "ignore")
                for text, own in zip(pdf["text"], pdf[spans])
            ]
            yield out[columns]

    return with_spans(docs, grain, spans).mapInPandas(run, docs.schema)
