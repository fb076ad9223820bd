"""Queries on text layers. A conversation stands for an image, its turns for the objects of its layer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import formats as K
from ..functions import text as T
from ..operators import layers as L
from .base import query, table

_TYPE = "CASE turn % 5 WHEN 0 THEN 'phone' WHEN 1 THEN 'url' WHEN 2 THEN 'text' WHEN 3 THEN 'banner' END"
_INTENT = "CASE turn % 4 WHEN 0 THEN 'readonly' WHEN 1 THEN 'actionable' WHEN 2 THEN 'later' END"
_TEXT = "CASE turn % 5 WHEN 0 THEN '+1 800 555 0' || (100 + conv_id % 900) WHEN 1 THEN 'https://h.example/' || conv_id || '/' || turn ELSE text END"
#: The layers' objects; bounds follow from turn and conversation
_OBJECTS = f"""o AS (SELECT conv_id AS image_id, turn AS pos, 't' || (turn % 7) AS id, {_TEXT} AS text, {_TYPE} AS type, {_INTENT} AS intent,
  turn % 6 = 4 AS prim, CASE WHEN turn % 8 <> 7 THEN turn % 3 <> 1 END AS selectable,
  ((conv_id * 7 + turn * 13) % 90)::DOUBLE AS x, ((conv_id + turn * 29) % 97)::DOUBLE AS y, (20 + (turn * 17) % 70)::DOUBLE AS w, (turn % 4)::DOUBLE AS h,
  CASE turn % 3 WHEN 0 THEN '#12345' || (turn % 10) WHEN 1 THEN 'red' END AS color, CASE turn % 4 WHEN 0 THEN 'bold' WHEN 1 THEN 'heavy' END AS weight FROM conversations)"""


def objects(spark, d: str) -> DataFrame:
    c, t, i = table(spark, d, "conversations"), F.col("turn"), F.col("conv_id")
    text = F.when(t % 5 == 0, F.concat(F.lit("+1 800 555 0"), (100 + i % 900).cast("string"))).when(t % 5 == 1, F.concat_ws("/", F.lit("https://h.example"), i.cast("string"), t.cast("string"))).otherwise(F.col("text"))
    d_ = lambda x: x.cast("double")
    bounds = F.struct(d_((i * 7 + t * 13) % 90).alias("x"), d_((i + t * 29) % 97).alias("y"), d_(20 + (t * 17) % 70).alias("w"), d_(t % 4).alias("h"))
    style = F.struct(
        F.lit(None).cast("string").alias("font"),
        F.when(t % 2 == 0, d_(8 + t % 9)).alias("size"),
        F.when(t % 4 == 0, "bold").when(t % 4 == 1, "heavy").alias("weight"),
        F.when(t % 3 == 0, F.concat(F.lit("#12345"), (t % 10).cast("string"))).when(t % 3 == 1, "red").alias("color"),
        F.lit(None).cast("string").alias("align"),
    )
    return c.select(
        i.alias("image_id"),
        t.alias("pos"),
        F.concat(F.lit("t"), (t % 7).cast("string")).alias("id"),
        text.alias("text"),
        F.when(t % 5 == 0, "phone").when(t % 5 == 1, "url").when(t % 5 == 2, "text").when(t % 5 == 3, "banner").alias("type"),
        F.when(t % 4 == 0, "readonly").when(t % 4 == 1, "actionable").when(t % 4 == 2, "later").alias("intent"),
        (t % 6 == 4).alias("primary"),
        F.when(t % 8 != 7, t % 3 != 1).alias("selectable"),
        bounds.alias("bounds"),
        F.lit(None).cast(f"array<struct<bounds:{L.BOUNDS},text:string>>").alias("runs"),
        style.alias("style"),
    )


FIELDS = ["id", "text", "type", "intent", "primary", "selectable", "bounds"]

_RULES = """CASE WHEN n > 1 THEN 'V-03' END, CASE WHEN text = '' THEN 'V-04' END, CASE WHEN type IS NULL THEN 'V-05' END,
  CASE WHEN sel AND (h <= 0 OR w > 100) THEN 'V-08' END, CASE WHEN sel AND x + w > 100 THEN 'V-09' END, CASE WHEN sel AND y + h > 100 THEN 'V-10' END,
  CASE WHEN selectable IS NULL THEN 'V-11' END, CASE WHEN NOT regexp_matches(color, '^#[0-9A-Fa-f]{6}$') THEN 'V-13' END, CASE WHEN weight NOT IN ('regular', 'medium', 'bold') THEN 'V-14' END"""
_ERRORS = f"""WITH {_OBJECTS}, n AS (SELECT *, row_number() OVER (PARTITION BY image_id, id ORDER BY pos) AS n, coalesce(selectable, false) AS sel FROM o),
e AS (SELECT image_id, pos, list_filter([{_RULES}], lambda x: x IS NOT NULL) AS errors FROM n)"""


@query(f"{_ERRORS} SELECT image_id, pos, array_to_string(errors, ',') AS errors FROM e")
def validate_errors(spark, d):
    return L.validated(objects(spark, d)).select("image_id", "pos", F.array_join("errors", ",").alias("errors"))


@query(f"{_ERRORS}, u AS (SELECT unnest(errors) AS code FROM e) SELECT code, count(*) AS objects FROM u GROUP BY 1")
def validate_counts(spark, d):
    return L.validated(objects(spark, d)).select(F.explode("errors").alias("code")).groupBy("code").agg(F.count("*").alias("objects"))


@query(f"WITH {_OBJECTS} SELECT image_id, id, count(*) AS n FROM o GROUP BY ALL HAVING count(*) > 1")
def validate_dup_ids(spark, d):
    return objects(spark, d).groupBy("image_id", "id").agg(F.count("*").alias("n")).where("n > 1")


@query(f"""WITH {_OBJECTS} SELECT image_id, pos, CASE WHEN type IN ('phone', 'url', 'email', 'address', 'text') THEN type ELSE 'text' END AS type,
CASE WHEN intent IN ('actionable', 'readonly', 'auto') THEN intent ELSE 'actionable' END AS intent FROM o""")
def enum_degrade(spark, d):
    return objects(spark, d).select("image_id", "pos", T.known_type(F.col("type")).alias("type"), T.known_intent(F.col("intent")).alias("intent"))


@query(f"WITH {_OBJECTS} SELECT image_id, pos, row_number() OVER (PARTITION BY image_id ORDER BY y, x, pos)::INTEGER AS ord FROM o")
def reading_order_strict(spark, d):
    o = objects(spark, d).select("*", "bounds.*")
    return L.strict_order(o).select("image_id", "pos", "ord")


_BANDS = f"""WITH {_OBJECTS}, s AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY image_id ORDER BY y, x, pos) > 1 THEN 1 ELSE 0 END AS step FROM o),
b AS (SELECT *, sum(step) OVER (PARTITION BY image_id ORDER BY y, x, pos ROWS UNBOUNDED PRECEDING)::INTEGER AS band FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY band, x, pos)::INTEGER AS ord FROM b)"""


@query(f"{_BANDS} SELECT image_id, pos, band, ord FROM r")
def reading_order_banded(spark, d):
    o = objects(spark, d).select("*", "bounds.*")
    return L.banded_order(o).select("image_id", "pos", F.col("band").cast("int").alias("band"), "ord")


@query(f"{_BANDS} SELECT image_id, pos, coalesce(type = 'phone' AND row_number() OVER (PARTITION BY image_id, type ORDER BY ord) = 1, false) AS prim FROM r")
def first_phone_primary(spark, d):
    o = L.banded_order(objects(spark, d).select("*", "bounds.*"))
    return L.first_phone(o).select("image_id", "pos", F.coalesce("primary", F.lit(False)).alias("prim"))


@query(f"{_BANDS} SELECT image_id, pos, 't' || ord AS new_id FROM r")
def assign_ids(spark, d):
    o = L.banded_order(objects(spark, d).select("*", "bounds.*"))
    return L.numbered(o).select("image_id", "pos", F.col("id").alias("new_id"))


@query(f"WITH {_OBJECTS} SELECT image_id, max(regexp_extract(id, '([0-9]+)', 1)::INTEGER) + 1 AS next_id FROM o GROUP BY 1")
def next_element_id(spark, d):
    return L.next_id(objects(spark, d))


@query(f"WITH {_OBJECTS} SELECT image_id, count(*) AS objects, count(*) FILTER (WHERE type = 'phone') AS phones, count(*) FILTER (WHERE prim) > 1 AS many_primary, string_agg(id || '=' || md5(text), ';' ORDER BY pos) AS layer FROM o GROUP BY 1")
def layer_assemble(spark, d):
    a = L.assemble(objects(spark, d), FIELDS)
    o = F.col("textLayer")
    return a.select(
        "image_id",
        F.size(o).cast("long").alias("objects"),
        F.size(F.filter(o, lambda x: x["type"] == "phone")).cast("long").alias("phones"),
        (F.size(L.warnings(o)) > 0).alias("many_primary"),
        F.array_join(F.transform(o, lambda x: F.concat(x["id"], F.lit("="), F.md5(x["text"]))), ";").alias("layer"),
    )


@query(f"WITH {_OBJECTS} SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY pos)::INTEGER - 1 AS pos, id, md5(text) AS text, type, x, h FROM o")
def layer_explode(spark, d):
    e = L.exploded(L.assemble(objects(spark, d), FIELDS))
    return e.select("image_id", "pos", "id", F.md5("text").alias("text"), "type", F.col("bounds.x").alias("x"), F.col("bounds.h").alias("h"))


@query(f"WITH {_OBJECTS} SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY pos)::INTEGER - 1 AS pos, id, md5(text) AS text, selectable, y FROM o")
def layer_json_roundtrip(spark, d):
    """Out to JSON and back by the full layer schema."""
    a = L.assemble(objects(spark, d), FIELDS)
    j = a.select("image_id", F.from_json(F.to_json(F.struct("textLayer")), L.LAYER).alias("l")).select("image_id", "l.textLayer")
    return L.exploded(j).select("image_id", "pos", "id", F.md5("text").alias("text"), "selectable", F.col("bounds.y").alias("y"))


@query(f"""WITH {_OBJECTS}, k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY CASE WHEN prim THEN 0 WHEN type IN ('phone', 'url') AND coalesce(intent, 'actionable') <> 'readonly' THEN 1 WHEN coalesce(selectable, true) THEN 2 ELSE 3 END, pos) AS n,
  CASE WHEN prim OR (type IN ('phone', 'url') AND coalesce(intent, 'actionable') <> 'readonly') OR coalesce(selectable, true) THEN 1 END AS ok FROM o)
SELECT image_id, CASE WHEN ok = 1 THEN x END AS x, CASE WHEN ok = 1 THEN y END AS y FROM k WHERE n = 1""")
def region_select(spark, d):
    b = L.region_bounds(F.col("textLayer"))
    return L.assemble(objects(spark, d), FIELDS).select("image_id", b["x"].alias("x"), b["y"].alias("y"))


@query(f"""WITH {_OBJECTS}, a AS (SELECT *, type IN ('phone', 'url') AND coalesce(intent, 'actionable') = 'actionable' AS acts FROM o),
c AS (SELECT image_id, text, row_number() OVER (PARTITION BY image_id ORDER BY CASE WHEN prim THEN 0 ELSE 1 END, pos) AS n FROM a WHERE prim OR acts),
f AS (SELECT image_id, arg_min(text, pos) AS other FROM a WHERE acts AND octet_length(encode(text)) <= 16 GROUP BY 1),
i AS (SELECT image_id, text, CASE WHEN image_id % 3 = 0 THEN 'conversation-number-' || image_id ELSE '{K.ID_PREFIX}' || image_id END AS cid FROM c WHERE n = 1),
w AS (SELECT image_id, CASE WHEN octet_length(encode(text)) <= 16 THEN text WHEN octet_length(encode(cid)) <= 16 THEN cid ELSE other END AS carried,
  CASE WHEN octet_length(encode(text)) <= 16 THEN 'direct' WHEN octet_length(encode(cid)) <= 16 THEN 'id' WHEN other IS NOT NULL THEN 'direct' END AS mode FROM i LEFT JOIN f USING (image_id))
SELECT o.image_id, any_value(carried) AS carried, any_value(mode) AS mode FROM (SELECT DISTINCT image_id FROM o) o LEFT JOIN w USING (image_id) GROUP BY 1""")
def t1_payload_select(spark, d):
    a = L.assemble(objects(spark, d), FIELDS)
    cid = F.when(F.col("image_id") % 3 == 0, F.concat(F.lit("conversation-number-"), "image_id")).otherwise(F.concat(F.lit(K.ID_PREFIX), "image_id"))
    p = L.payload_choice(F.col("textLayer"), cid)
    return a.select("image_id", p["text"].alias("carried"), p["mode"].alias("mode"))


@query(f"""{_BANDS}, g AS (SELECT *, CASE WHEN type IN ('phone', 'url', 'text') THEN type ELSE 'text' END AS kind, CASE WHEN pos % 2 = 0 THEN (8 + pos % 9)::DOUBLE END AS size FROM r WHERE coalesce(selectable, true)),
a AS (SELECT *, kind IN ('phone', 'url') AND coalesce(intent, 'actionable') <> 'readonly' AND image_id % 2 = 0 AS act FROM g)
SELECT image_id, ord, id || '-r0' AS "node", kind AS "type", md5(text) AS "label", x, y, w, h,
  CASE WHEN size IS NOT NULL THEN printf('%.3f%%', floor(size * 1.333::DOUBLE / 480 * 100 * 1000 + 0.5) / 1000) ELSE printf('%.4f%%', h) END AS font_size,
  CASE WHEN act THEN 'button' ELSE 'text' END AS "role", CASE WHEN act THEN CASE kind WHEN 'phone' THEN 'tel:' || regexp_replace(text, '[^+0-9]', '', 'g') ELSE text END END AS "action",
  CASE WHEN act THEN CASE kind WHEN 'phone' THEN 'Call' ELSE 'Open' END END AS "verb" FROM a""")
def render_plan(spark, d):
    """Odd images are stale, so nothing on them can be acted on."""
    o = L.banded_order(objects(spark, d).select("*", "bounds.x", "bounds.y")).withColumn("image_height", F.lit(480))
    return L.render_plan(o, stale=F.col("image_id") % 2 == 1).withColumn("label", F.md5("label"))


@query("SELECT p_partkey, CASE WHEN p_size % 10 > 0 THEN floor((p_partkey % 100) / 100.0::DOUBLE * 640 / (p_size % 10) * 10000 + 0.5) / 10000 END AS scale FROM part")
def box_fit(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", L.box_fit(F.col("p_partkey") % 100, F.lit(640), F.col("p_size") % 10).alias("scale"))


@query("""SELECT conv_id, turn, coalesce(CASE WHEN turn % 3 = 0 THEN 640 END, CASE WHEN conv_id % 2 = 0 THEN 800 END, max(turn * 10 + length(role)) OVER (PARTITION BY conv_id))::BIGINT AS extent,
(turn * 10 + length(role) / 2.0) BETWEEN 5 AND 40 AS on_board FROM conversations""")
def page_geometry(spark, d):
    c = table(spark, d, "conversations").withColumnRenamed("conv_id", "image_id").withColumn("left", F.col("turn") * 10).withColumn("width", F.length("role")).withColumn("top", F.lit(0)).withColumn("height", F.lit(0))
    c = c.withColumn("page_w", F.when(F.col("turn") % 3 == 0, 640).cast("long")).withColumn("default_w", F.when(F.col("image_id") % 2 == 0, 800).cast("long"))
    e = L.page_extent(c)
    on = L.in_artboard(c, 5, -1, 40, 1)
    return e.join(on.select("image_id", "turn", F.lit(True).alias("on_board")), ["image_id", "turn"], "left").select(F.col("image_id").alias("conv_id"), "turn", "extent", F.coalesce("on_board", F.lit(False)).alias("on_board"))


@query("""SELECT event_id, json_type(props, '$.k') = 'VARCHAR' AS text, false AS bool, event_id % 4 <> 0 AS known FROM events""")
def strict_types(spark, d):
    e = table(spark, d, "events").withColumn("v", F.try_parse_json("props"))
    text = F.schema_of_variant(F.try_variant_get("v", "$.k", "variant")) == "STRING"
    version = F.when(F.col("event_id") % 4 == 0, "1.0").otherwise("0.2")
    return e.select("event_id", text.alias("text"), L.strict_boolean(F.col("v"), "$.k").alias("bool"), L.known_version(version).alias("known"))


_WALK = """WITH RECURSIVE n AS (SELECT conv_id, turn, CASE WHEN turn > 0 THEN (turn - 1) // 2 END AS up FROM conversations),
t AS (SELECT conv_id, turn, 0 AS depth FROM n WHERE up IS NULL UNION ALL SELECT n.conv_id, n.turn, depth + 1 FROM n JOIN t ON n.conv_id = t.conv_id AND n.up = t.turn)
SELECT conv_id, turn, depth FROM t"""


@query(_WALK)
def layer_tree(spark, d):
    """A host's layer tree, turn n below turn (n-1)/2, walked with each node's depth."""
    n = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") > 0, F.floor((F.col("turn") - 1) / 2)).alias("up"))
    n.createOrReplaceTempView("layer_nodes")
    return spark.sql("""WITH RECURSIVE t AS (SELECT conv_id, turn, 0 AS depth FROM layer_nodes WHERE up IS NULL
      UNION ALL SELECT n.conv_id, n.turn, depth + 1 FROM layer_nodes n JOIN t ON n.conv_id = t.conv_id AND n.up = t.turn) SELECT conv_id, turn, depth FROM t""")
