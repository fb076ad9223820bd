"""Connected components of edge tables, without bringing edges to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, matched, materialise


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) to id, label: the least id that each id is connected with. Ids without edges are left out.

    Alternates large stars (neighbours above a node move to its least neighbour) and small
    stars (those below do), until nothing changes. Nodes of the most edges meet these without a shuffle.
    """
    edges = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    while True:
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state or not seen[0]:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("label")).union(edges.select("v", "v").distinct()).groupBy("id").agg(F.min("label").alias("label"))
        state, old = seen, edges
        both = edges.union(edges.select("v", "u"))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")).select("u", F.least("u", "m").alias("m"), "c"), "stars")
        large = matched(both.where("v > u"), least, ["u"], "c").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large, "stars")
        lower = materialise(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")), "stars")
        small = matched(large, lower, ["u"], "c")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(lower.select("u", "m")).where("u <> v").distinct()
        edges = materialise(small, "edges")
        for done in (old, least, large, lower):
            discard(done)
