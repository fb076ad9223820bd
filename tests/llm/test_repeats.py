"""How many rows the passes over repeated windows make."""

import collections

import numpy as np
from pyspark.sql import functions as F

from glyphlake.llm import common, repeats


def made(df):
    """Rows that the joins of a query make, by kind of join."""
    df.collect()
    out, open_ = collections.Counter(), [df._jdf.queryExecution().executedPlan()]
    while open_:
        node = open_.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            open_.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            open_.append(node.plan())
        elif "Join" in name:
            out[node.joinType().toString()] += node.metrics().apply("numOutputRows").value()
        children = node.children()
        open_ += [children.apply(i) for i in range(children.size())]
    return out


def suffixes(spark, n):
    """n rows: seven tenths alone in their bucket, the others by threes, and four buckets that grow with n."""
    key = F.when(F.expr("id % 100 = 0"), F.expr("-1 - id div 100 % 4")).when(F.expr("id % 10 < 7"), F.col("id")).otherwise(F.expr("1000000 + id div 10"))
    h = F.xxhash64(key)
    return spark.range(n).select(F.col("id").alias("rid"), F.lit(0).cast("long").alias("lo"), F.lit(1).alias("n"), F.lit(0).alias("off"), h.alias("h"), h.alias("whole"))


def test_joins_grow_as_the_input(spark, monkeypatch):
    """Also where the small input has fewer repeated buckets than are sent to all tasks, and the large one more."""
    monkeypatch.setattr(common, "HEAVY", 500)
    seen, real = [], repeats.matched

    def watched(rows, table, on, *more, **named):
        out = real(rows, table, on, *more, **named)
        if on == ["h"]:
            seen.append(made(out))
        return out

    monkeypatch.setattr(repeats, "matched", watched)
    for n in (2_000, 10_000):
        found = repeats.one_pass(suffixes(spark, n))[0].select("rid").collect()
        assert sorted(r["rid"] for r in found) == [i for i in range(n) if i % 10 >= 7 or i % 100 == 0]
    small, large = seen
    assert set(small) == set(large) and all(large[k] <= 6 * small[k] for k in large)
    assert all(x <= 0.4 * n for n, kinds in ((2_000, small), (10_000, large)) for x in kinds.values())


def test_no_possible_row_is_lost(spark, monkeypatch):
    """Whatever the number of words; without any key no row is left."""
    rows = spark.range(20_000).select("id", F.xxhash64("id").alias("h"))
    table = rows.where("id % 4 = 0").select("h")
    for words in (1, 50, common.WORDS):
        monkeypatch.setattr(common, "WORDS", words)
        left = np.array([r["id"] for r in common.possible(rows, table, "h").select("id").collect()])
        assert set(range(0, 20_000, 4)) <= set(left) and len(set(left)) == len(left)
    assert len(left) < 5_000 + 0.05 * 15_000
    assert common.possible(rows, table.where("h is null"), "h").count() == 0
