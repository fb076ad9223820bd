"""N-gram Jaccard join: links documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

Jaccard distance is a metric. The join is exact (shingles are 64-bit hashes):

1. Documents of equal sets become one class, which its set's hash names.
2. A set of a shingles differs from a linked one by at most a/5 of its own or a/4 of the
   other's. So of the first L = 35 % of each set's shingles in hash order, at least
   ``least_common(a)`` are among the first of both (a test goes through the sizes). Sets with
   fewer shared shingles among their first L have no partner. By the same count, ordered from
   the rarest shingle on, linked sets share one of their first L - least_common(a) + 1. These
   shingles tie candidates together; the connected ones form cells.
3. A cell too large for one task is divided by pivots: each set goes to its nearest pivot's
   Voronoi region, if it is within RADIUS of it, and else to the region of the far (pivots of
   regions lie apart, so that a family has one). A set on
   a boundary is replicated to each region where the triangle inequality allows it a partner:
   pivot distances up to its own nearest plus twice the link distance, and RADIUS plus the
   link distance; it is also among the far from RADIUS less the link distance on. All pairs
   with a pivot are decided, so pivots leave, and a set linked with its region's pivot stays
   only if some set that isn't linked comes near enough. A region whose sets are all connected
   is done. The rest are divided again until they are small. Sets that are all at middle
   distances, as texts from one template are, would be in all regions: a cell whose regions
   together hold as many sets as it, or one of which holds over nine tenths, isn't divided so.
   It is tied anew, by the rarest shingles within it, this time of the whole sets, where linked
   ones share four fifths. What is still large and can't be divided then is joined in parts of
   bounded size: a set visits those parts whose sets share one of its rarest shingles.
4. In a small cell each set in turn is a pivot for those it isn't connected with yet, and
   the first pivot's distances give the windows in which partners can lie.

Links are never expanded to all pairs of a group: each step gives edges to pivots, and the
components of these edges are the components of all links.

Defined cases: null or blank text has no shingle and is alone; a text under five words is
one shingle; equal rows are linked; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, discard, fresh, matched, materialise, mix64, word_hashes
from .graph import components

N = 5
LINK = (80, 100)  # similarity, as a fraction
NEAR = 0.2  # its distance
RADIUS = 0.4
PIVOTS = 64
CELL_SETS, CELL_SHINGLES = 4096, 1 << 21
CHARS = 1 << 21


def shingles(texts) -> list[np.ndarray]:
    """Each text's distinct shingle hashes in order."""
    words, bounds, _, _ = word_hashes(texts, lower=True)
    odd = np.uint64(0x9E3779B97F4A7C15)
    grams = np.zeros(max(0, len(words) - N + 1), np.uint64)
    for k in range(N):
        grams = mix64(grams * odd + words[k : k + len(grams)])
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= N:
            out.append(np.unique(grams[a : b - N + 1]))
        else:
            h = np.full(1, b - a, np.uint64)
            for w in words[a:b]:
                h = mix64(h * odd + w)
            out.append(h[: int(b > a)])
    return out


def name(s: np.ndarray) -> int:
    """A set's hash."""
    return int(mix64(np.array([mix64(s ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def first(n: int) -> int:
    """How many of n shingles are looked at first."""
    return -(-35 * n // 100)


def least_common(n: int) -> int:
    """How many of the first shingles of both a set of n shingles has in common with any linked set, at least."""
    return min(first(n) - n // 5, first(n + n // 4) - n // 4)


def set_rows(docs: DataFrame) -> DataFrame:
    """doc_id, rid, sig (null for an empty set), n."""

    def make(frames):
        for pdf in batches(frames, CHARS):
            sets = shingles(pdf["text"])
            out = pdf[["doc_id", "rid"]].copy()
            out["sig"] = pd.array([name(s) if len(s) else None for s in sets], dtype="Int64")
            out["n"] = [len(s) for s in sets]
            yield out

    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("rid long, sig long, n long")])
    return docs.select("doc_id", "rid", "text").mapInPandas(make, schema)


def posting_rows(docs: DataFrame) -> DataFrame:
    """h, sig: the first shingles of every set."""

    def make(frames):
        for pdf in batches(frames, CHARS):
            sets = [s for s in shingles(pdf["text"]) if len(s)]
            if sets:
                count = [first(len(s)) for s in sets]
                h = np.concatenate([s[:k] for s, k in zip(sets, count)])
                yield pd.DataFrame({"h": h.view(np.int64), "sig": np.repeat(np.array([name(s) for s in sets], np.int64), count)})

    return docs.select("text").mapInPandas(make, "h long, sig long")


def whole_sets(docs: DataFrame) -> DataFrame:
    """cell, sig, n, shingles (8 bytes each) of docs(cell, sig, text)."""

    def make(frames):
        for pdf in batches(frames, CHARS):
            sets = shingles(pdf["text"])
            yield pd.DataFrame({"cell": pdf["cell"], "sig": pdf["sig"], "n": [len(s) for s in sets], "shingles": [s.tobytes() for s in sets]})

    return docs.select("cell", "sig", "text").mapInPandas(make, "cell long, sig long, n long, shingles binary")


def cells(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """sig and the cell it shares with all its possible partners."""
    postings = posting_rows(docs)
    shared = postings.groupBy("h").agg(F.count("*").alias("c"), F.min("sig").alias("a"), F.max("sig").alias("b")).where("a <> b")
    known = materialise(postings.join(shared.select("h", "c"), "h").groupBy("sig", "h").agg(F.first("c").alias("c")), "jaccard-shared")
    size = sets.where("sig is not null").groupBy("sig").agg(F.first("n").alias("n"))
    n = F.col("n")
    able = known.groupBy("sig").agg(F.count("*").alias("m")).join(size, "sig")
    able = able.withColumn("least", F.least(-F.floor(-35 * n / 100) - F.floor(n / 5), -F.floor(-35 * (n + F.floor(n / 4)) / 100) - F.floor(n / 4))).where("m >= least")
    able = able.select("sig", (F.col("m") - F.col("least") + 1).alias("keys"))  # shingles of one set only come first
    rank = F.row_number().over(Window.partitionBy("sig").orderBy("c", "h"))
    keys = materialise(known.join(able, "sig").withColumn("r", rank).where("r <= keys").select("h", "sig"), "jaccard-keys")
    discard(known)
    root = keys.groupBy("h").agg(F.min("sig").alias("v"), F.max("sig").alias("w")).where("v <> w").select("h", "v")
    edges = keys.join(root, "h").select(F.col("sig").alias("u"), "v").distinct()
    return components(edges).select(F.col("id").alias("sig"), F.col("label").alias("cell"))


def overlaps(index: np.ndarray, owner: np.ndarray, count: int, s: np.ndarray) -> np.ndarray:
    """How many of s each of ``count`` sets has; index: their sorted shingles, owner: whose they are."""
    lo, hi = np.searchsorted(index, s), np.searchsorted(index, s, side="right")
    out = np.zeros(count, np.int64)
    hit = hi > lo
    lo, n = lo[hit], (hi - lo)[hit]
    if len(lo):
        out += np.bincount(owner[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=count)
    return out


def indexed(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    all_ = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(all_, kind="stable")
    return all_[order], owner[order]


def local_links(sig: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges that connect exactly what the links among these sets connect."""
    count, size = len(sets), np.array([len(s) for s in sets])
    index, owner = indexed(sets)
    group, links, first_d = np.arange(count), [], None
    for p in range(count):
        rest = group != group[p]
        if first_d is not None:
            rest &= np.abs(first_d - first_d[p]) <= NEAR + 1e-9
        rest[:p] = False  # pairs with earlier pivots are decided
        if not rest.any():
            if (group == group[0]).all():
                break
            continue
        both = overlaps(index, owner, count, sets[p])
        union = size + size[p] - both
        if first_d is None:
            first_d = 1 - both / union
        for q in np.flatnonzero(rest & (LINK[1] * both >= LINK[0] * union)):
            if group[q] != group[p]:
                group[group == group[q]] = group[p]
                links.append((int(sig[p]), int(sig[q])))
    return links


def small_links(rows: DataFrame, bins: int) -> DataFrame:
    """Links inside small cells; cells are dealt out in bins so that a task gets many."""

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in pdf.groupby("cell"):
            out += local_links(g["sig"].to_numpy(), [np.frombuffer(b, np.uint64) for b in g["shingles"]])
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return rows.groupBy(F.pmod(F.xxhash64("cell"), F.lit(bins)).alias("bin")).applyInPandas(join, "u long, v long")


def grouped(d: np.ndarray) -> np.ndarray:
    """The first pivot that each pivot is connected with by links, from the pivots' distances."""
    first = np.arange(len(d))
    for _ in range(len(d)):
        least = np.where(d <= NEAR, first[None, :], len(d)).min(axis=1)
        if (least == first).all():
            break
        first = least
    return first


def apart(d: np.ndarray) -> list[int]:
    """Pivots in order, each only if it is far from all before it: one a family."""
    out: list[int] = []
    for j in range(len(d)):
        if (d[j, out] > RADIUS + NEAR).all():
            out.append(j)
    return out


def distances(sets: list[np.ndarray], pivots: list[np.ndarray]) -> np.ndarray:
    """Jaccard distances; those of linked pairs are exactly at or under NEAR, all others above."""
    index, size = indexed(pivots), np.array([len(s) for s in pivots])
    out = np.zeros((len(sets), len(pivots)))
    for k, s in enumerate(sets):
        both = overlaps(*index, len(pivots), s)
        union = size + len(s) - both
        d = 1 - both / union
        out[k] = np.where(LINK[1] * both >= LINK[0] * union, np.minimum(d, NEAR), np.maximum(d, np.nextafter(NEAR, 1)))
    return out


def divided(rows: DataFrame, turn: int, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links between large cells' sets and pivots, and which sets are in which regions. links: those known so far.

    A cell is dealt out in parts of bounded size, each beside all pivots of the cell.
    """
    parts = rows.groupBy("cell").agg((F.count("*") / CELL_SETS + F.sum("n") / CELL_SHINGLES + 1).cast("int").alias("parts"))
    order = Window.partitionBy("cell").orderBy(F.xxhash64("sig", F.lit(turn)), "sig")
    pivots = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= PIVOTS).join(parts, "cell")
    each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p_part")
    pivots = pivots.select(F.col("cell").alias("p_cell"), F.col("sig").alias("p_sig"), F.col("shingles").alias("p_shingles"), F.col("r").alias("p_r"), each)
    dealt = rows.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int")).drop("parts")

    def place(own: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        columns = ["cell", "sig", "region", "d", "linked", "pivot"]
        if not len(own):
            return pd.DataFrame([], columns=columns)
        pivots = pivots.sort_values("p_r")
        names = pivots["p_sig"].tolist()
        sets = [np.frombuffer(b, np.uint64) for b in pivots["p_shingles"]]
        between = distances(sets, sets)
        family, chosen = grouped(between), apart(between)
        d = distances([np.frombuffer(b, np.uint64) for b in own["shingles"]], sets)
        out = []
        for cell, sig, near in zip(own["cell"], own["sig"], d):
            for j in np.unique(family[near <= NEAR]):  # one link for each connected group of pivots
                out.append((cell, sig, -1, 0.0, True, names[np.flatnonzero((family == j) & (near <= NEAR))[0]]))
            if sig in names:  # all pairs of a pivot are decided
                j = names.index(sig)
                out.append((cell, sig, -1, 0.0, True, names[family[j]]))
                continue
            here = near[chosen]
            least = here.min()
            for k in np.flatnonzero(here <= min(least + 2 * NEAR, RADIUS + NEAR) + 1e-9):
                out.append((cell, sig, int(chosen[k]), float(here[k]), bool(here[k] <= NEAR), 0))
            if least > RADIUS - NEAR - 1e-9:
                out.append((cell, sig, PIVOTS, 2.0, False, 0))
        return pd.DataFrame(out, columns=columns)

    schema = "cell long, sig long, region int, d double, linked boolean, pivot long"
    placed = dealt.groupBy("cell", "part").cogroup(pivots.groupBy("p_cell", "p_part")).applyInPandas(place, schema)
    placed = materialise(placed, "jaccard-placed")
    more = placed.where("region = -1").select(F.col("sig").alias("u"), F.col("pivot").alias("v"))
    label = components(links.unionByName(more)).withColumnRenamed("id", "sig")
    inside = placed.where("region >= 0").join(label, "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    state = inside.groupBy("cell", "region").agg(F.min(F.when(~F.col("linked"), F.col("d"))).alias("least"), F.min("label").alias("a"), F.max("label").alias("b"))
    state = state.where("a <> b and least is not null").select("cell", "region", "least")  # sets that are connected need no more links
    stay = inside.join(state, ["cell", "region"]).where(~F.col("linked") | (F.col("d") >= F.col("least") - NEAR - 1e-9))
    return more, materialise(stay.select("cell", "sig", "region"), "jaccard-regions")


def explicit(rows: DataFrame) -> DataFrame:
    """cell, sig, n, h: every shingle of rows(cell, sig, n, shingles)."""

    def make(frames):
        for pdf in frames:
            for a in range(0, len(pdf), 256):
                own = pdf.iloc[a : a + 256]
                count = own["n"].to_numpy()
                yield pd.DataFrame({c: np.repeat(own[c].to_numpy(), count) for c in ("cell", "sig", "n")} | {"h": np.frombuffer(b"".join(own["shingles"]), np.int64)})

    return rows.select("cell", "sig", "n", "shingles").mapInPandas(make, "cell long, sig long, n long, h long")


def tied(rows: DataFrame) -> DataFrame:
    """cell, sig, h, r: each set's shingles, from its cell's rarest on, of which linked sets of the cell share one.

    A linked set shares n - n // 5 of a set's n shingles at least, so sets with fewer that
    stand in others of the cell are left out, and of m such the m - (n - n // 5) + 1 rarest do.
    """
    each = materialise(explicit(rows), "jaccard-explicit")
    shared = each.groupBy("cell", "h").agg(F.count("*").alias("c")).where("c > 1").withColumn("weight", F.col("c"))
    known = materialise(matched(each, materialise(shared, "jaccard-counts"), ["cell", "h"], "weight"), "jaccard-shared")
    discard(each)
    least = F.col("n") - F.floor(F.col("n") / 5)
    able = known.groupBy("cell", "sig", "n").agg(F.count("*").alias("m")).where(F.col("m") >= least)
    able = able.select("cell", "sig", (F.col("m") - least + 1).alias("keys"))
    rank = F.row_number().over(Window.partitionBy("cell", "sig").orderBy("c", "h"))
    return materialise(known.join(able, ["cell", "sig"]).withColumn("r", rank).where("r <= keys").select("cell", "sig", "h", "r"), "jaccard-ties")


def refined(rows: DataFrame) -> DataFrame:
    """rows with smaller cells: sets that ties connect. Sets without ties leave."""
    keys = tied(rows).select("cell", "sig", "h", F.xxhash64("cell", "sig").alias("node"))
    root = keys.groupBy("cell", "h").agg(F.min("node").alias("v"), F.max("node").alias("w"), F.count("*").alias("weight")).where("v <> w")
    edges = matched(keys, materialise(root.select("cell", "h", "v", "weight"), "jaccard-roots"), ["cell", "h"], "weight")
    label = components(edges.select(F.col("node").alias("u"), "v"))
    rows = rows.withColumn("id", F.xxhash64("cell", "sig")).join(label, "id")
    return rows.select(F.xxhash64("cell", "label").alias("cell"), "sig", "n", "shingles")


def joined(rows: DataFrame) -> DataFrame:
    """Edges that connect what links in these cells connect, however large they are.

    A cell is cut in parts of bounded size by each set's rarest tie. A set is compared with all
    of its part, and visits every later part that holds one of its ties.
    """
    keys = tied(rows)
    size = rows.groupBy("cell").agg((F.count("*") / CELL_SETS + F.sum("n") / CELL_SHINGLES + 1).cast("int").alias("parts"))
    home = keys.where("r = 1").join(size, "cell").select("cell", "sig", F.pmod(F.xxhash64("h"), F.col("parts")).cast("int").alias("part"))
    home = materialise(home, "jaccard-homes")
    placed = keys.join(home, ["cell", "sig"]).select("cell", "h", "sig", "part")
    held = placed.groupBy("cell", "h").agg(F.collect_set("part").alias("held"), F.count("*").alias("weight")).where("size(held) > 1")
    visits = matched(placed, materialise(held, "jaccard-held"), ["cell", "h"], "weight")
    visits = visits.select("cell", "sig", F.explode(F.filter("held", lambda p: p > F.col("part"))).alias("part")).distinct()
    visits = materialise(visits.join(rows, ["cell", "sig"]).select("cell", "part", "sig", "shingles", F.col("n")), "jaccard-visits")
    load = visits.groupBy("cell", "part").agg((F.count("*") / CELL_SETS + F.sum("n") / CELL_SHINGLES + 1).cast("int").alias("chunks"))
    hosts = home.join(rows, ["cell", "sig"]).join(load, ["cell", "part"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    hosts = hosts.select("cell", "part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "sig", "shingles")
    guests = visits.join(load, ["cell", "part"]).select("cell", "part", F.pmod(F.xxhash64("sig"), F.col("chunks")).cast("int").alias("chunk"), "sig", "shingles")

    def compare(hosts: pd.DataFrame, guests: pd.DataFrame) -> pd.DataFrame:
        if not len(hosts):
            return pd.DataFrame({"u": [], "v": []}, dtype="int64")
        sig, sets = hosts["sig"].to_numpy(), [np.frombuffer(b, np.uint64) for b in hosts["shingles"]]
        out = local_links(sig, sets)
        first = {}
        for u, v in out:  # groups as far as edges tell at once; finer ones only cost an edge
            first[v] = first.get(u, u)
        group = np.array([first.get(int(x), int(x)) for x in sig])
        index, size = indexed(sets), np.array([len(s) for s in sets])
        for name_, b in zip(guests["sig"].tolist(), guests["shingles"]):
            s = np.frombuffer(b, np.uint64)
            both = overlaps(*index, len(sets), s)
            near = np.flatnonzero(LINK[1] * both >= LINK[0] * (size + len(s) - both))
            out += [(name_, int(sig[near[k]])) for k in np.unique(group[near], return_index=True)[1]]
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    by = ["cell", "part", "chunk"]
    return hosts.groupBy(*by).cogroup(guests.groupBy(*by)).applyInPandas(compare, "u long, v long")


def all_links(rows: DataFrame, watch: list[int] | None = None) -> DataFrame:
    """Edges that connect what links connect, from cell rows.

    Each turn decides small cells, and divides large ones where that makes them smaller. A
    turn's rows are never more than those of the turn before; ``watch`` gets how many they are.
    """
    links, turn, rows = None, 0, rows.withColumn("tries", F.lit(0))
    large = (F.col("c") > 2) & ((F.col("c") > CELL_SETS) | (F.col("w") > CELL_SHINGLES))
    while True:
        rows = materialise(rows, "jaccard-cells")
        weight = rows.groupBy("cell").agg(F.count("*").alias("c"), F.sum("n").alias("w")).where("c > 1").withColumn("weight", F.col("c"))
        weight = materialise(weight, "jaccard-weights")
        zero = lambda x: F.coalesce(x, F.lit(0))
        sets, shingles_, any_large = weight.agg(zero(F.sum("c")), zero(F.sum("w")), zero(F.max(large.cast("int")))).first()
        if watch is not None:
            watch.append(rows.count())
        sized = matched(rows, weight, ["cell"], "weight")
        bins = int(sets // CELL_SETS + shingles_ // CELL_SHINGLES + 1) * 4
        more = materialise(small_links(sized.where(~large).select("cell", "sig", "shingles"), bins), "jaccard-links")
        links = more if links is None else links.unionByName(more)
        if not any_large:
            return links
        columns = ["cell", "sig", "n", "shingles"]
        big = materialise(sized.where(large), "jaccard-large")
        discard(rows)
        more, stay = divided(big.select(*columns), turn, links)
        links = links.unionByName(more)
        held = stay.groupBy("cell", "region").agg(F.count("*").alias("k")).groupBy("cell").agg(F.sum("k").alias("all"), F.max("k").alias("most"))
        held = held.join(weight.select("cell", "c"), "cell").where((F.col("all") >= F.col("c")) | (F.col("most") > 0.9 * F.col("c")))
        whole = materialise(held.select("cell"), "jaccard-whole")  # cells that regions don't divide
        rest = stay.join(whole, "cell", "left_anti").join(big.select(*columns), ["cell", "sig"])
        rows = rest.select(F.xxhash64("cell", "region", F.lit(turn)).alias("cell"), "sig", "n", "shingles", F.lit(0).alias("tries"))
        if whole.count():
            kept = big.join(whole, "cell", "left_semi")
            rows = rows.unionByName(refined(kept.where("tries = 0").select(*columns)).withColumn("tries", F.lit(1)))
            if kept.where("tries > 0").count():
                links = links.unionByName(materialise(joined(kept.where("tries > 0").select(*columns)), "jaccard-links"))
        turn += 1


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, rid for each row; rid is equal for equal rows."""
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rid"))
    sets = materialise(set_rows(docs), "jaccard-sets")
    cell = cells(docs, sets)
    one = sets.where("sig is not null").groupBy("sig").agg(F.min("rid").alias("rid"), F.min("doc_id").alias("least"))
    chosen = cell.join(one, "sig").select("cell", "sig", "rid")
    # equal rows give equal sets, so one of them is enough
    rows = whole_sets(docs.join(chosen, "rid")).dropDuplicates(["cell", "sig"])
    member = components(all_links(rows))
    named = one.join(member.withColumnRenamed("id", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    found = named.select("sig", "label").join(least, "label").select("sig", "component_id")
    return sets.join(found, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "rid")


def one_of_each(docs: DataFrame) -> DataFrame:
    """All columns of the document of least id of each group; rows that are equal in id and text count as one."""
    key = fresh(docs, "rid")
    kept = link(docs).where("component_id <=> doc_id or n_shingles = 0").select(F.col("rid").alias(key)).distinct()
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text")).join(kept, key, "left_semi")
    return keyed.dropDuplicates([key]).select(*docs.columns)
