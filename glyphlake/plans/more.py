"""Queries on event time, layers' roots and runs, stripped carriers, block transforms, and operators that come with Spark."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import layers as L
from ..sources import containers as C
from ..streaming import event_time as E
from .base import query, table
from .carriers import _BOXED, rasters, written
from .layers import _OBJECTS, objects

# --- event time ---


def timed(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _plain(df):
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, max(value) AS top FROM events GROUP BY ALL")
def event_tumbling(spark, d):
    return _plain(E.windowed(timed(spark, d), "1 hour", "10 minutes", ["event_type"], [F.count("*").alias("n"), F.max("value").alias("top")]))


@query("""SELECT start, count(*) AS n, count(DISTINCT user_id) AS users FROM (
  SELECT user_id, unnest([time_bucket(INTERVAL 15 MINUTE, ts), time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE]) AS start FROM events) GROUP BY 1""")
def event_sliding(spark, d):
    """Half-hour windows, a new one each quarter."""
    each = E.windowed(timed(spark, d), "30 minutes", "10 minutes", ["user_id"], [F.count("*").alias("n")], "15 minutes")
    return _plain(each.groupBy("start").agg(F.sum("n").alias("n"), F.count("*").alias("users")))


@query("""WITH o AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM o)
SELECT min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS stop, user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, d):
    return _plain(E.sessions(timed(spark, d), "2 hours", "10 minutes", ["user_id"], [F.count("*").alias("n")]))


@query("""SELECT a.event_id AS first_id, b.event_id AS then_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 HOUR
WHERE a.event_type = 'signup' AND b.event_type = 'view'""")
def event_followed(spark, d):
    e = timed(spark, d)
    first = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("first_id"), "ts")
    then = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("then_id"), F.col("ts").alias("then_ts"))
    return E.followed(first, then, "user_id", "1 hour", "10 minutes").select("first_id", "then_id")


# --- layers ---


@query(f"WITH {_OBJECTS} SELECT image_id, count(*) FILTER (type = 'phone') AS phones, count(*) FILTER (type IN ('phone', 'email', 'url', 'address') AND coalesce(intent, 'actionable') = 'actionable') AS actionables FROM o GROUP BY 1")
def layer_tallies(spark, d):
    return L.tallies(objects(spark, d))


@query("""SELECT conv_id AS image_id, concat_ws(',', CASE WHEN conv_id % 5 = 0 THEN 'V-01' END, CASE WHEN conv_id % 3 = 0 OR conv_id % 4 = 1 THEN 'V-12' END) AS errors FROM conversations GROUP BY 1""")
def validate_roots(spark, d):
    """Layers without objects, without permissions, or with one permission missing."""
    i, yes = F.col("image_id"), F.lit(True)
    rows = L.assemble(objects(spark, d), ["id", "text"])
    text_layer = F.when(i % 5 != 0, F.col("textLayer"))
    given = F.struct(yes.alias("platformCanDisableSelection"), F.when(i % 4 != 1, yes).alias("platformCanDisableLinks"), yes.alias("platformCanDisableAll"))
    return rows.select("image_id", F.array_join(L.layer_errors(text_layer, F.when(i % 3 != 0, given)), ",").alias("errors"))


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, CASE turn % 6 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE 't' || turn END ORDER BY turn) AS k FROM conversations)
SELECT conv_id AS image_id, turn AS pos, concat_ws(',', CASE WHEN turn % 6 < 2 THEN 'V-02' END, CASE WHEN turn % 6 = 0 AND k > 1 THEN 'V-03' END, CASE WHEN turn % 4 = 0 THEN 'V-06' END, CASE WHEN turn % 4 = 1 THEN 'V-07' END,
  CASE WHEN turn % 4 = 1 THEN 'V-09' END, CASE WHEN turn % 3 = 0 THEN 'V-15' END, CASE WHEN turn % 5 IN (1, 2, 3) THEN 'V-18' END) AS errors FROM n""")
def validate_rare_rules(spark, d):
    """Blank ids, missing and far bounds, unknown alignments, and runs that are none, empty, out of range, without bounds or right."""
    t = F.col("turn")
    box = lambda x, w: F.struct(*[F.lit(float(v)).alias(k) for k, v in zip("xywh", (x, 10, w, 10))])
    run = lambda b: F.array(F.struct(b.alias("bounds"), F.lit("r").alias("text")))
    nothing = F.lit(None).cast(L.BOUNDS)
    empty = F.slice(run(box(0, 1)), 1, 0)
    style = F.struct(F.lit("#123456").alias("color"), F.lit("bold").alias("weight"), F.when(t % 3 == 0, "middle").otherwise("left").alias("align"))
    rows = table(spark, d, "conversations").select(
        F.col("conv_id").alias("image_id"),
        t.alias("pos"),
        F.when(t % 6 == 0, " ").when(t % 6 > 1, F.concat(F.lit("t"), t.cast("string"))).alias("id"),
        F.lit("x").alias("text"),
        F.lit("text").alias("type"),
        F.lit(True).alias("selectable"),
        F.when(t % 4 == 1, box(101, 5)).when(t % 4 > 1, box(5, 5)).alias("bounds"),
        F.when(t % 5 == 1, empty).when(t % 5 == 2, run(box(95, 10))).when(t % 5 == 3, run(nothing)).when(t % 5 == 4, run(box(5, 10))).alias("runs"),
        style.alias("style"),
    )
    return L.validated(rows).select("image_id", "pos", F.array_join("errors", ",").alias("errors"))


@query(f"""WITH {_OBJECTS}, e AS (SELECT image_id, pos, coalesce(nullif(id, ''), 'e' || (pos + 1)) AS id, coalesce(type, 'text') AS type, coalesce(intent, 'auto') AS intent, coalesce(prim, false) AS prim,
  x, y, 'Inter' AS font, CASE WHEN pos % 2 = 0 THEN 8.0 + pos % 9 ELSE 16.0 END::DOUBLE AS size, coalesce(weight, 'normal') AS weight, coalesce(color, '#FFFFFF') AS color, coalesce(selectable, true) AS selectable FROM o)
SELECT image_id, pos, id, type, intent, prim AS "primary", x, y, font, size, weight, color, selectable FROM e""")
def layer_import(spark, d):
    """An existing layer's objects as editable elements, with a default for each missing field."""
    rows = L.assemble(objects(spark, d), ["id", "text", "type", "intent", "primary", "selectable", "bounds", "style"])
    found = L.imported(rows)
    return found.select("image_id", "pos", "id", "type", "intent", "primary", "x", "y", "style.font", "style.size", "style.weight", "style.color", "selectable")


@query("SELECT conv_id AS image_id, turn AS pos, replace(replace(trim(text, ' \t\n\r'), '\r\n', '\n'), '\r', '\n') AS text FROM conversations WHERE turn % 3 <> 0 AND turn % 5 <> 0 AND trim(text, ' \t\n\r') <> ''")
def host_text_nodes(spark, d):
    """A design host's nodes: every third hidden, every fifth a shape."""
    t = F.col("turn")
    nodes = table(spark, d, "conversations").select(F.col("conv_id").alias("image_id"), t.alias("pos"), "text", (t % 3 != 0).alias("visible"), F.when(t % 5 == 0, "RECT").otherwise("TEXT").alias("kind"))
    return L.visible_text(nodes).select("image_id", "pos", "text")


# --- carriers ---


@query(f"""WITH {_BOXED} SELECT doc_id AS image_id, NOT (fmt = 'jpeg' AND long OR unread) AS held, false AS left_over, true AS same_parts FROM w""")
def container_stripped(spark, d):
    """A strip simulator: carriers lose their layer and keep all other parts."""
    rows = written(spark, d).select("image_id", "content", C.layer_json("content").isNotNull().alias("held")).withColumn("bare", C.stripped("content"))
    count = lambda c: F.size(F.filter(C.part_list(c), lambda p: ~C.is_layer(p)))
    return rows.select("image_id", "held", C.layer_json("bare").isNotNull().alias("left_over"), (count("content") >= count("bare")).alias("same_parts"))


@query(f"WITH {_BOXED} SELECT doc_id AS image_id, CASE WHEN fmt = 'jpeg' AND long OR unread THEN 1 ELSE 0 END AS code FROM w")
def container_inspect(spark, d):
    """Whether a carrier's layer can be shown: exit code 0, or 1 without one."""
    return C.inspected(written(spark, d)).select("image_id", "code")


@query("SELECT page_id, count(*) AS links, count(DISTINCT link) AS forms FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?:src|href)\\s*=\\s*[\"'']([^\"''>]+)[\"'']', 1)) AS link FROM pages) GROUP BY 1")
def page_links(spark, d):
    return C.links(table(spark, d, "pages"), ending="").groupBy("page_id").agg(F.count("*").alias("links"), F.countDistinct("link").alias("forms"))


# --- blocks ---


@query("""WITH g AS (SELECT vec_id // 64 AS image_id FROM embeddings GROUP BY 1 HAVING count(*) = 64),
v AS (SELECT vec_id // 64 AS image_id, vec_id % 64 AS r, unnest(embedding)::DOUBLE AS px, generate_subscripts(embedding, 1) - 1 AS c FROM embeddings WHERE vec_id // 64 IN (SELECT image_id FROM g))
SELECT image_id, round(sum(px) / 8, 4) AS dc, round(sum(px * px), 4) AS energy, true AS back FROM v WHERE r < 8 AND c < 8 GROUP BY 1""")
def blk_transform_pair(spark, d):
    """The whole 8 by 8 cosine transform of each raster's first block, and back: mean, energy, and whether it returns."""
    from ..operators.blocks import dct_pair

    px = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice("px", r * 64 + 1, 8)))
    found = rasters(spark, d).select("image_id", px.cast("array<double>").alias("block")).withColumn("pair", dct_pair("block"))
    energy = F.aggregate("pair.forward", F.lit(0.0), lambda s, x: s + x * x)
    back = F.forall(F.zip_with("block", "pair.back", lambda a, b: F.abs(a - b) < 1e-9), lambda ok: ok)
    return found.select("image_id", F.round(F.get("pair.forward", F.lit(0)), 4).alias("dc"), F.round(energy, 4).alias("energy"), back.alias("back"))


# --- inherited from Spark ---


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, grouping_id(l_returnflag, l_linestatus) AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def inherit_grouping_sets(spark, d):
    t = table(spark, d, "lineitem")
    a, b = t["l_returnflag"], t["l_linestatus"]
    return t.groupingSets([[a], [b], []], a, b).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))


@query("""SELECT o_orderkey, percent_rank() OVER w AS share, cume_dist() OVER w AS below, dense_rank() OVER w AS place,
count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW) AS near, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS days
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate)""")
def inherit_frames(spark, d):
    """A frame of groups is a frame by range over dense ranks."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate")
    o = table(spark, d, "orders").withColumn("place", F.dense_rank().over(w))
    near, days = Window.partitionBy("o_custkey").orderBy("o_orderkey").rangeBetween(-1000, 0), Window.partitionBy("o_custkey").orderBy("place").rangeBetween(-1, 0)
    return o.select("o_orderkey", F.percent_rank().over(w).alias("share"), F.cume_dist().over(w).alias("below"), "place", F.count("*").over(near).alias("near"), F.count("*").over(days).alias("days"))


@query("""(SELECT l_suppkey AS k, 'both' AS side FROM lineitem WHERE l_quantity > 45 INTERSECT ALL SELECT l_suppkey, 'both' FROM lineitem WHERE l_quantity < 4) UNION ALL
(SELECT l_suppkey, 'only' FROM lineitem WHERE l_quantity > 45 EXCEPT ALL SELECT l_suppkey, 'only' FROM lineitem WHERE l_quantity < 3)""")
def inherit_sets_all(spark, d):
    rows = lambda where: table(spark, d, "lineitem").where(where).select(F.col("l_suppkey").alias("k"))
    both, only = rows("l_quantity > 45").intersectAll(rows("l_quantity < 4")), rows("l_quantity > 45").exceptAll(rows("l_quantity < 3"))
    return both.withColumn("side", F.lit("both")).unionByName(only.withColumn("side", F.lit("only")))


@query("SELECT n_regionkey, count(*) AS keys, string_agg(n_name, ',' ORDER BY n_name) FILTER (n_nationkey >= 10) AS high, max(n_nationkey) * 2 AS top FROM nation GROUP BY 1")
def inherit_maps(spark, d):
    """A registry as one map a region: name to key."""
    m = table(spark, d, "nation").groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("m"))
    high = F.array_join(F.array_sort(F.map_keys(F.map_filter("m", lambda k, v: v >= 10))), ",")
    double = F.array_max(F.map_values(F.transform_values("m", lambda k, v: v * 2)))
    return m.select("n_regionkey", F.size("m").cast("long").alias("keys"), F.when(high != "", high).alias("high"), double.alias("top"))


@query("SELECT p_partkey, i::INTEGER AS pos, part FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS part, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS i FROM part)")
def inherit_udtf(spark, d):
    """A table function of the user's own, applied to each row."""

    @F.udtf(returnType="pos int, part string")
    class Parts:
        def eval(self, text: str):
            yield from enumerate((text or "").split(" "))

    spark.udtf.register("glyphlake_parts", Parts)
    table(spark, d, "part").createOrReplaceTempView("glyphlake_part")
    return spark.sql("SELECT p_partkey, pos, part FROM glyphlake_part, LATERAL glyphlake_parts(p_name)")


@query("SELECT p_brand, round(sqrt(avg(p_size * p_size)), 6) AS size FROM part GROUP BY 1")
def inherit_udaf(spark, d):
    """An aggregate function of the user's own: the root of the mean square."""
    @F.pandas_udf("double")
    def root_mean_square(v: pd.Series) -> float:
        return float((v.astype(float) ** 2).mean() ** 0.5)

    return table(spark, d, "part").groupBy("p_brand").agg(F.round(root_mean_square("p_size"), 6).alias("size"))
