"""What the fingerprint search sends from where hashes are compared, and to whom."""

import re

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from glyphlake import formats as K
from glyphlake.operators import fingerprint
from glyphlake.plans import catalog


def hashes(spark, rows, id):
    rows = [(i, None if h is None else [None if x is None else int(x) for x in h]) for i, h in enumerate(rows)]
    df = spark.createDataFrame(rows, f"{id} long, hash array<long>")
    return df if id == "query_id" else df.withColumn("reg_ord", F.col(id))


def drifted(rng, base, most):
    out = base.copy()
    for r in out:
        for bit in rng.choice(32 * base.shape[1], rng.integers(0, most), replace=False):
            r[bit // 32] ^= 1 << int(bit % 32)
    return out


def near(q, e, within):
    dist = np.bitwise_count(q[:, None] ^ e[None]).sum(axis=2, dtype=np.int64)
    return [[(int(dist[i, j]), int(j)) for j in np.lexsort((np.arange(len(e)), dist[i])) if dist[i, j] <= within] for i in range(len(q))]


def before_exchange(df):
    """The plan's nodes from the search up to the first exchange above it."""
    names = re.findall(r"^[ :+\-*()\d]*(\w+)", df._jdf.queryExecution().executedPlan().toString(), re.M)
    above = names[: names.index("MapInArrow")][::-1]
    return above[: above.index("Exchange")]


def test_a_meeting_sends_the_first_two_of_many_copies(spark):
    rng = np.random.default_rng(1)
    base = np.repeat(rng.integers(0, 2**32, (4, 2)), 100, axis=0)
    asked = drifted(rng, base, 9)
    q, e = hashes(spark, asked, "query_id"), hashes(spark, base, "key")
    assert fingerprint.pairs(q, e, 20, 64, most=2).count() == 2 * len(asked)
    got = {(r["query_id"], r["rank"]): (r["dist"], r["key"]) for r in fingerprint.candidates(q, e, 20, 64, most=2).collect()}
    assert got == {(i, k + 1): x for i, c in enumerate(near(asked, base, 20)) for k, x in enumerate(c[:2])}
    assert fingerprint.unambiguous(fingerprint.candidates(q, e, 20, 64, most=2)).count() == 0


def test_hashes_that_lack_words_meet_nothing(spark):
    whole, short = [1, 2], [1]
    q, e = hashes(spark, [whole, [None, None], None, short], "query_id"), hashes(spark, [whole, [None, None], None, short, [1, None]], "key")
    for method in ("nested", "index"):
        got = fingerprint.candidates(q, e, 12, 64, method, 8).select("query_id", "key", "dist").collect()
        assert sorted(map(tuple, got)) == [(0, 0, 0), (3, 3, 0)]


def test_all_sizes_of_lots_and_blocks_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**32, (300, 2))
    asked = drifted(rng, base, 15)
    q, e = hashes(spark, asked, "query_id"), hashes(spark, base, "key")
    want = {(i, j, d) for i, c in enumerate(near(asked, base, 14)) for d, j in c}
    for lot, block in ((1 << 11, 1 << 16), (100, 70)):
        monkeypatch.setattr(fingerprint, "MEET", lot)
        monkeypatch.setattr(fingerprint, "BLOCK", block)
        for method, bits in (("nested", 16), ("index", 8), ("index", 16)):
            got = fingerprint.candidates(q, e, 14, 64, method, bits)
            assert {(r["query_id"], r["key"], r["dist"]) for r in got.collect()} == want
        first = fingerprint.nearest(fingerprint.candidates(q, e, 14, 64, most=1))
        assert {(r["query_id"], r["dist"], r["key"]) for r in first.collect()} == {(i, *c[0]) for i, c in enumerate(near(asked, base, 14)) if c}


@pytest.mark.parametrize("cells", [1 << 10, 1 << 19])
def test_meetings_in_parts(monkeypatch, cells):
    monkeypatch.setattr(fingerprint, "CELLS", cells)
    rng = np.random.default_rng(3)
    base = np.concatenate([rng.integers(0, 2**32, (200, 3)), np.repeat(rng.integers(0, 2**32, (1, 3)), 50, axis=0)])
    asked = drifted(rng, base, 12)
    want = {(i, j, d) for i, c in enumerate(near(asked, base, 18)) for d, j in c}
    for found in (fingerprint.compared(asked.astype(np.uint64), base.astype(np.uint64), 18), fingerprint.probed(asked.astype(np.uint64), base.astype(np.uint64), 18, 8)):
        got = [x for lot in found for x in zip(*(a.tolist() for a in lot))]
        assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("name", ["fp_candidates", "fp_mih_candidates"])
def test_all_candidates_are_ranked_where_they_are_found(spark, name):
    """No pair is sent or sorted after the search, however many copies there are."""
    plan = catalog.queries()[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    names = re.findall(r"^[ :+\-*()\d]*(\w+)", plan, re.M)
    assert not {"Exchange", "Window", "Sort"} & set(names[: names.index("MapInArrow")])


@pytest.mark.parametrize("held", [1, 300, 1 << 21])
@pytest.mark.parametrize("whole", [0, 1 << 20])
def test_ranks_of_many_copies(spark, monkeypatch, held, whole):
    for name, value in (("HELD", held), ("WHOLE", whole), ("MEET", 60), ("BLOCK", 70)):
        monkeypatch.setattr(fingerprint, name, value)
    rng = np.random.default_rng(6)
    base = np.concatenate([rng.integers(0, 2**32, (100, 2)), np.repeat(rng.integers(0, 2**32, (2, 2)), 60, axis=0)])
    asked = drifted(rng, base, 9)
    q, e = hashes(spark, asked, "query_id"), hashes(spark, base, "key").withColumn("reg_ord", -F.col("key"))
    want = {(i, j, d, k + 1) for i, c in enumerate(near(asked, base, 12)) for k, (d, j) in enumerate(sorted(c, key=lambda x: (x[0], -x[1])))}
    for method in ("nested", "index"):
        got = fingerprint.candidates(q, e, 12, 64, method, 8).select("query_id", "key", "dist", "rank").collect()
        assert len(got) == len(want) and set(map(tuple, got)) == want


def test_queries_of_one_id_are_ranked_together(spark):
    rows = [(7, [1, 2]), (7, [1, 3]), (None, [1, 2]), (None, [1, 2]), (8, [1, 3])]
    q = spark.createDataFrame(rows, "query_id long, hash array<long>")
    e = hashes(spark, [[1, 2], [1, 2]], "key")
    got = sorted((r["query_id"] or 0, r["rank"], r["dist"]) for r in fingerprint.candidates(q, e, 12, 64).collect())
    assert got == [(0, 1, 0), (0, 2, 0), (0, 3, 0), (0, 4, 0), (7, 1, 0), (7, 2, 0), (7, 3, 1), (7, 4, 1), (8, 1, 1), (8, 2, 1)]


@pytest.mark.parametrize("name", ["fp_ambiguity_veto", "fp_top1", "t2_verified", "fp_mih_candidates", "fp_tight_single", "resolve_tiers"])
def test_queries_send_no_pairs_but_near_ones(spark, name):
    """No probe and no pair is a row of a plan before it is near; where many are near, they are summed up before they go."""
    plan = catalog.queries()[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and "bit_count" not in plan


def test_verified_sums_up_before_it_sends(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**32, (120, 2))
    asked = drifted(rng, base, 12)
    region = {(i, j): int(rng.integers(0, 70)) for i in range(len(asked)) for j in range(len(base)) if j % 3 == 0 and i % 4}
    told = spark.createDataFrame([(i, j, d) for (i, j), d in region.items()], "query_id long, key long, told int")
    found = fingerprint.pairs(hashes(spark, asked, "query_id"), hashes(spark, base, "key"), 21, 64)
    assert "HashAggregate" in before_exchange(fingerprint.verified(found, (F.abs(F.col("query_id") - F.col("key")) % 90).cast("int")))
    want = set()
    for i, c in enumerate(near(asked, base, 21)):
        have = sorted((region[i, j], j, d) for d, j in c if (i, j) in region)
        if have:
            if have[0][0] <= K.REGION and (len(have) == 1 or have[1][0] > have[0][0] + K.GAP):
                want.add((i, have[0][1], have[0][2], have[0][0]))
        elif len(c) == 1 and c[0][0] <= K.TIGHT:
            want.add((i, c[0][1], c[0][0], None))
    got = fingerprint.verified(found.join(told, ["query_id", "key"], "left"), F.col("told")).select("query_id", "key", "dist", "rdist").collect()
    assert set(map(tuple, got)) == want and any(r[3] is None for r in want) and any(r[3] is not None for r in want)
