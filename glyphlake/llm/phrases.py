"""Substring dedup with repeated-phrase automata: removes words that a repeated window of 35 words covers.

1. Recurring passages are confirmed by counting (see ``repeats``). Of each passage one place is
   kept, in the document of least rid that holds it, its owner; the passage's words there are a
   phrase. Passages of an owner that touch there, and stand in the same documents at the same
   distances, are one phrase: it occurs wherever they do.
2. Phrases are dealt out to shards by their owners, so that the phrases of one text stay together.
   A shard compiles its phrases, each once, to one Aho-Corasick automaton over word numbers.
3. Every document that shares a recurring passage streams, whole, through the automata of the
   shards that hold its passages' phrases. The matches are what is removed: the counting has told
   which phrases there are and which shards a document visits, not where they stand.

Every window of a phrase is repeated, so any occurrence of the phrase is to go; and each
repeated window lies in a passage whose phrase is in a shard that its document visits, so it is
found. Shards hold a bounded number of words; where more documents visit a shard than a task
takes, they come in chunks, each of which compiles the shard again.

Defined cases: null or empty text has no words; texts under 35 words lose nothing; equal rows
are places of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, discard, matched, materialise
from .repeats import CHARS, Grain, covered, keyed, places

WORDS = Grain("words", 35, 12)
SHARD = 1 << 19  # words of phrases in a shard, about
CHUNK = 1 << 22  # characters of documents that go through a shard at a time, about


def phrase_rows(owners: DataFrame, width: int) -> DataFrame:
    """owners(rid, shard, text, at array<struct<like,lo,n>>) to shard, phrase: the words at each place, with one blank between.

    Places that touch and are alike (stand in the same documents at the same distances) are one."""

    def make(frames):
        for pdf in batches(frames, CHARS):
            rows = []
            for shard, text, at in zip(pdf["shard"], pdf["text"], pdf["at"]):
                words = text.encode("utf-8", "surrogatepass").split()
                spans: list[list] = []
                for like, lo, end in sorted((x["like"], x["lo"], x["lo"] + x["n"] + width - 1) for x in at):
                    if spans and spans[-1][0] == like and lo <= spans[-1][2]:
                        spans[-1][2] = max(spans[-1][2], end)
                    else:
                        spans.append([like, lo, end])
                rows += [(shard, b" ".join(words[a:b])) for _, a, b in spans]
            yield pd.DataFrame(rows, columns=["shard", "phrase"])

    return owners.select("shard", "text", "at").mapInPandas(make, "shard long, phrase binary")


def compiled(phrases) -> tuple[dict[bytes, int], ahocorasick.Automaton]:
    """Numbers of the phrases' words, and an automaton over them whose matches give a phrase's length."""
    numbers: dict[bytes, int] = {}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for phrase in phrases:
        coded = tuple(numbers.setdefault(w, len(numbers) + 1) for w in phrase.split(b" "))
        automaton.add_word(coded, len(coded))
    automaton.make_automaton()
    return numbers, automaton


def located(words: list[bytes], numbers: dict[bytes, int], automaton) -> list[tuple[int, int]]:
    """First and last word of each maximal run that occurrences of phrases cover."""
    ends = list(automaton.iter(tuple(numbers.get(w, 0) for w in words)))
    if not ends:
        return []
    hi = np.array([e for e, _ in ends], np.int64) + 1
    mark = covered(len(words), hi - np.array([n for _, n in ends], np.int64), hi)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mark, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))


def occurrences(docs: DataFrame, grain: Grain, shard: int, chunk: int) -> tuple[DataFrame, list[DataFrame]]:
    """docs of ``keyed`` to rid and runs, array<struct<a,b>>: words a to b are in occurrences of phrases. Also the tables that it is read from."""
    found, written = places(docs, grain)
    found = materialise(found, "phrase-places")
    for table in written:
        discard(table)
    # sums over a passage's documents of a hash, and of the hash times the place: less the owner's place they tell which documents, at which distances
    name = F.pmod(F.xxhash64(F.lit(17), "rid"), F.lit(1 << 45)).cast("decimal(20,0)")
    kinds = found.groupBy("h", "whole").agg(F.count("*").alias("c"), F.min(F.struct("rid", "lo", "n")).alias("one"), F.sum(name).alias("s"), F.sum(name * F.col("lo").cast("decimal(12,0)")).alias("t"))
    like = F.xxhash64("c", "s", F.col("t") - F.col("s") * F.col("one.lo").cast("decimal(12,0)")).alias("like")
    kinds = materialise(kinds.select("h", "whole", "c", like, F.col("one.rid").alias("owner"), F.col("one.lo").alias("lo"), F.col("one.n").alias("n")), "phrase-kinds")
    shards = (kinds.agg(F.sum(F.col("n") + grain.width - 1)).first()[0] or 0) // shard + 1
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(shards)).alias("shard")
    visits = matched(found.select("rid", "h", "whole").distinct(), kinds.select("h", "whole", "owner", "c"), ["h", "whole"], "c")
    visits = visits.select("rid", of("owner")).distinct().groupBy("rid").agg(F.collect_list("shard").alias("shards"))
    at = kinds.groupBy(F.col("owner").alias("rid")).agg(F.collect_list(F.struct("like", "lo", "n")).alias("at"))
    own = visits.join(at, "rid", "left")
    met = materialise(docs.select("rid", "text").join(own, "rid"), "phrase-documents")
    discard(found)
    rows = phrase_rows(met.where("at is not null").select(of("rid"), "text", "at"), grain.width)
    guests = met.select("rid", "text", F.explode("shards").alias("shard"))
    load = guests.groupBy("shard").agg((F.sum(F.length("text")) / chunk + 1).cast("int").alias("chunks"))
    load = F.broadcast(materialise(load, "phrase-load")) if shards <= 1 << 16 else materialise(load, "phrase-load")
    guests = guests.join(load, "shard").select("shard", F.pmod(F.xxhash64("rid"), F.col("chunks")).cast("int").alias("chunk"), "rid", "text")
    rows = rows.distinct().join(load, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "phrase")

    def stream(phrases: pd.DataFrame, guests: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(phrases) and len(guests):
            numbers, automaton = compiled(phrases["phrase"])
            for rid, text in zip(guests["rid"], guests["text"]):
                runs = located(text.encode("utf-8", "surrogatepass").split(), numbers, automaton)
                if runs:
                    out.append((rid, [{"a": a, "b": b} for a, b in runs]))
        return pd.DataFrame(out, columns=["rid", "runs"])

    by = ["shard", "chunk"]
    runs = rows.groupBy(*by).cogroup(guests.groupBy(*by)).applyInPandas(stream, "rid long, runs array<struct<a:long,b:long>>")
    return runs.groupBy("rid").agg(F.array_distinct(F.flatten(F.collect_list("runs"))).alias("runs")), [kinds, met]


def dedup(docs: DataFrame, grain: Grain = WORDS, shard: int = SHARD, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row."""

    def run(frames):
        for pdf in batches(frames, CHARS):
            rows = []
            for text, runs in zip(pdf["text"], pdf["runs"]):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                kept = words
                if runs is not None:
                    mark = covered(len(words), np.array([x["a"] for x in runs]), np.array([x["b"] for x in runs]) + 1)
                    kept = [words[i] for i in np.flatnonzero(~mark)]
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256"])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    docs = keyed(docs)
    found, used = occurrences(docs, grain, shard, chunk)
    found = materialise(found, "phrase-runs")
    for table in used:
        discard(table)
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("n_words long, n_removed long, kept_sha256 string")])
    return docs.join(found, "rid", "left").select("doc_id", "text", "runs").mapInPandas(run, schema)
