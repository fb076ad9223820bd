"""Text layers as nested columns: assembling, ordering, validating, policy, payload choice and render plans.

An object row has image_id, pos (place in the layer) and the fields of OBJECT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import formats as K
from ..functions import numbers as N
from ..functions import text as T

BOUNDS = "struct<x:double,y:double,w:double,h:double>"
STYLE = "struct<font:string,size:double,weight:string,italic:boolean,color:string,align:string,letterSpacing:double,lineHeight:double,decoration:string>"
OBJECT = f"struct<id:string,text:string,type:string,intent:string,primary:boolean,selectable:boolean,label:string,bounds:{BOUNDS},runs:array<struct<bounds:{BOUNDS},text:string>>,style:{STYLE}>"
LAYER = f"{K.VERSION_FIELD} string, contentId string, pixelDigest string, binding struct<t0:boolean,t1:boolean,t2:boolean,payloadMode:string,canonicalWidth:int>, image struct<width:int,height:int>, permissions struct<platformCanDisableSelection:boolean,platformCanDisableLinks:boolean,platformCanDisableAll:boolean>, regionHash string, regionBounds {BOUNDS}, textLayer array<{OBJECT}>"

per_image = lambda: Window.partitionBy("image_id")


# --- building and taking apart ---


def assemble(objects: DataFrame, fields: list[str]) -> DataFrame:
    """One row for each image: textLayer, its objects in order."""
    rows = objects.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("pos", *fields))).alias("o"))
    return rows.select("image_id", F.transform("o", lambda o: F.struct(*[o[f].alias(f) for f in fields])).alias("textLayer"))


def exploded(layers: DataFrame) -> DataFrame:
    return layers.select("image_id", F.posexplode("textLayer").alias("pos", "o")).select("image_id", "pos", "o.*")


def in_percent(layer: Column, width: Column, height: Column) -> Column:
    """Bounds of all objects and of their runs as percentages."""
    runs = lambda o: F.transform(o["runs"], lambda r: r.withField("bounds", N.to_percent(r["bounds"], width, height)))
    return F.transform(layer, lambda o: o.withField("bounds", F.when(o["bounds"].isNotNull(), N.to_percent(o["bounds"], width, height))).withField("runs", runs(o)))


def nested_runs(run: Column) -> Column:
    """A run given flat (x, y, w, h, text) in the form that has bounds."""
    return F.struct(F.struct(*[run[k].cast("double").alias(k) for k in "xywh"]).alias("bounds"), run["text"].alias("text"))


def next_id(objects: DataFrame) -> DataFrame:
    """The number for an image's next object: one above the greatest in its ids."""
    return objects.groupBy("image_id").agg((F.coalesce(F.max(F.regexp_extract("id", r"(\d+)", 1).try_cast("int")), F.lit(0)) + 1).alias("next_id"))


def page_extent(elements: DataFrame) -> DataFrame:
    """elements(image_id, page_w, default_w, left, width) with the page's width: given, by default, or by extent."""
    extent = F.max(F.col("left") + F.col("width")).over(per_image())
    return elements.withColumn("extent", F.coalesce("page_w", "default_w", extent))


def in_artboard(rows: DataFrame, x0, y0, x1, y1) -> DataFrame:
    """Frames whose centre is on the board."""
    cx, cy = F.col("left") + F.col("width") / 2, F.col("top") + F.col("height") / 2
    return rows.where(cx.between(x0, x1) & cy.between(y0, y1))


def visible_text(nodes: DataFrame) -> DataFrame:
    """A host's visible text nodes that aren't blank, line ends made one kind."""
    nodes = nodes.withColumn("text", T.stripped(F.regexp_replace("text", "\r\n?", "\n")))
    return nodes.where("visible and kind = 'TEXT' and text <> ''")


def tallies(objects: DataFrame) -> DataFrame:
    """How many phones and how many actionable objects each layer has."""
    acts = _acts({k: F.col(k) for k in ("type", "intent")})
    return objects.groupBy("image_id").agg(F.count_if(F.col("type") == "phone").alias("phones"), F.count_if(acts).alias("actionables"))


def imported(layers: DataFrame) -> DataFrame:
    """layers(image_id, textLayer) to editable elements, with a default for each missing field."""
    o = exploded(layers)
    given = lambda c, other: F.when(F.coalesce(c, F.lit("")) != "", c).otherwise(other)
    s = F.col("style")
    style = F.struct(given(s["font"], "Inter").alias("font"), F.coalesce(s["size"], F.lit(16.0)).alias("size"), given(s["weight"], "normal").alias("weight"), given(s["color"], "#FFFFFF").alias("color"))
    return o.select(
        "image_id",
        "pos",
        given(F.col("id"), F.concat(F.lit("e"), (F.col("pos") + 1).cast("string"))).alias("id"),
        F.coalesce("text", F.lit("")).alias("text"),
        given(F.col("type"), "text").alias("type"),
        given(F.col("intent"), "auto").alias("intent"),
        F.coalesce("primary", F.lit(False)).alias("primary"),
        F.coalesce(F.col("bounds")["x"], F.lit(10.0)).alias("x"),
        F.coalesce(F.col("bounds")["y"], F.lit(10.0)).alias("y"),
        style.alias("style"),
        F.coalesce("selectable", F.lit(True)).alias("selectable"),
    )


# --- order ---


def strict_order(objects: DataFrame) -> DataFrame:
    return objects.withColumn("ord", F.row_number().over(per_image().orderBy("y", "x", "pos")))


def banded_order(objects: DataFrame, gap: float = 1.0) -> DataFrame:
    """Rows of text: a step down of more than ``gap`` opens a new band; within a band from left to right."""
    down = per_image().orderBy("y", "x", "pos")
    step = F.when(F.col("y") - F.lag("y").over(down) > gap, 1).otherwise(0)
    bands = objects.withColumn("_s", step).withColumn("band", F.sum("_s").over(down)).drop("_s")
    return bands.withColumn("ord", F.row_number().over(per_image().orderBy("band", "x", "pos")))


def first_phone(objects: DataFrame, order: str = "ord") -> DataFrame:
    """The first phone in order becomes primary."""
    n = F.row_number().over(Window.partitionBy("image_id", "type").orderBy(order))
    return objects.withColumn("primary", (F.col("type") == "phone") & (n == 1))


def numbered(objects: DataFrame, order: str = "ord") -> DataFrame:
    return objects.withColumn("id", F.concat(F.lit("t"), F.row_number().over(per_image().orderBy(order))))


# --- validation ---


def _out_of_range(b: Column) -> Column:
    side = lambda k: b[k].isNull()
    return side("x") | side("y") | side("w") | side("h") | (b["x"] < 0) | (b["y"] < 0) | (b["w"] <= 0) | (b["h"] <= 0) | (b["x"] + b["w"] > 100) | (b["y"] + b["h"] > 100)


def layer_errors(text_layer: Column, permissions: Column) -> Column:
    three = [permissions[k] for k in ("platformCanDisableSelection", "platformCanDisableLinks", "platformCanDisableAll")]
    missing = three[0].isNull() | three[1].isNull() | three[2].isNull()
    return F.array_compact(F.array(F.when(text_layer.isNull(), "V-01"), F.when(permissions.isNull() | missing, "V-12")))


def object_errors(o, duplicate: Column) -> Column:
    """Codes of all rules that an object breaks; ``o`` maps field names to columns."""
    b, chosen = o["bounds"], F.coalesce(o["selectable"], F.lit(False))
    inside = chosen & b.isNotNull()
    style = o["style"]
    wrong = lambda c: F.coalesce(c, F.lit(False))
    bad_run = F.exists(o["runs"], lambda r: r["bounds"].isNull() | _out_of_range(r["bounds"]))
    rules = [
        ("V-02", o["id"].isNull() | (T.stripped(o["id"]) == "")),
        ("V-03", (o["id"] != "") & duplicate),
        ("V-04", o["text"].isNull() | (o["text"] == "")),
        ("V-05", o["type"].isNull()),
        ("V-06", chosen & b.isNull()),
        ("V-07", inside & ((b["x"] < 0) | (b["x"] > 100) | (b["y"] < 0) | (b["y"] > 100))),
        ("V-08", inside & ((b["w"] <= 0) | (b["w"] > 100) | (b["h"] <= 0) | (b["h"] > 100))),
        ("V-09", inside & (b["x"] + b["w"] > 100)),
        ("V-10", inside & (b["y"] + b["h"] > 100)),
        ("V-11", o["selectable"].isNull()),
        ("V-13", (style["color"] != "") & ~style["color"].rlike("^#[0-9A-Fa-f]{6}$")),
        ("V-14", (style["weight"] != "") & ~style["weight"].isin(K.WEIGHTS)),
        ("V-15", (style["align"] != "") & ~style["align"].isin(K.ALIGNS)),
        ("V-18", o["runs"].isNotNull() & ((F.size(o["runs"]) == 0) | bad_run)),
    ]
    return F.array_compact(F.array(*[F.when(wrong(cond), code) for code, cond in rules]))


def validated(objects: DataFrame) -> DataFrame:
    """image_id, pos and the broken rules; an id counts as duplicate from its second place on."""
    again = F.row_number().over(Window.partitionBy("image_id", "id").orderBy("pos")) > 1
    rows = objects.withColumn("_again", again)
    return rows.select("image_id", "pos", object_errors({c: F.col(c) for c in objects.columns}, F.col("_again")).alias("errors"))


def strict_boolean(document: Column, path: str) -> Column:
    """Whether a VARIANT holds a real boolean there, not a number or text that reads like one."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get(document, path, "variant")) == "BOOLEAN", F.lit(False))


def known_version(version: Column) -> Column:
    """A reader of this format's major version takes it."""
    return F.coalesce(F.split(version, r"\.")[0] == K.VERSION.split(".")[0], F.lit(False))


# --- policy ---


def resolved_mode(permissions_all: Column, requested: Column) -> Column:
    return F.when((permissions_all == F.lit(False)) & requested.isin("raster_only", "blocked"), "button_only").otherwise(requested)


def _acts(o: Column) -> Column:
    return F.coalesce(o["type"].isin(K.ACTIONABLE), F.lit(False)) & (F.coalesce(o["intent"], F.lit("actionable")) == "actionable")


def _is_primary(o: Column) -> Column:
    return F.coalesce(o["primary"], F.lit(False))


def _first(layer: Column, test) -> Column:
    return F.try_element_at(F.filter(layer, test), F.lit(1))


def region_bounds(layer: Column) -> Column:
    """Bounds of the first primary, else the first that may be acted on, else the first that may be selected."""
    may = lambda o: F.coalesce(o["type"].isin(K.ACTIONABLE), F.lit(False)) & (F.coalesce(o["intent"], F.lit("actionable")) != "readonly")
    return F.coalesce(_first(layer, _is_primary), _first(layer, may), _first(layer, lambda o: F.coalesce(o["selectable"], F.lit(True))))["bounds"]


def payload_choice(layer: Column, content_id: Column) -> Column:
    """What the watermark carries: struct(text, mode), or null. Nothing is ever cut to fit.

    The first primary or else the first actionable field, if it fits; else the content id, if
    it fits; else the first other actionable field that does.
    """
    chosen = F.coalesce(_first(layer, _is_primary), _first(layer, _acts))
    other = _first(layer, lambda o: _acts(o) & T.fits(o["text"]))
    carry = lambda text, mode: F.struct(text.alias("text"), F.lit(mode).alias("mode"))
    usable = T.fits(content_id) & (content_id != "")
    return F.when(chosen.isNull(), None).when(T.fits(chosen["text"]), carry(chosen["text"], "direct")).when(usable, carry(content_id, "id")).when(other.isNotNull(), carry(other["text"], "direct"))


def payload_bytes(text: Column) -> Column:
    """16 bytes, padded with NUL."""
    return F.rpad(F.encode(text, "UTF-8"), F.lit(K.CAPACITY), F.lit(b"\x00"))


def checksum_payload(text: Column) -> Column:
    """Verify mode: V1 and the CRC-32 of the normalised field."""
    return F.concat(F.lit(b"V1"), F.unhex(F.lpad(F.hex(F.crc32(F.encode(text, "UTF-8"))), 8, "0")))


def binding(t1: Column, t2: Column, mode: Column) -> Column:
    return F.struct(F.lit(True).alias("t0"), t1.alias("t1"), t2.alias("t2"), F.when(t1, mode).alias("payloadMode"), F.when(t1, F.lit(K.WIDTH)).alias("canonicalWidth"))


def warnings(layer: Column) -> Column:
    return F.array_compact(F.array(F.when(F.size(F.filter(layer, _is_primary)) > 1, "multiple primary objects; the first counts")))


# --- rendering ---


def render_plan(objects: DataFrame, mode: str = "full", may_disable: Column | None = None, platform_disables: Column | None = None, stale: Column | None = None) -> DataFrame:
    """A row for each run to draw: ids, place, font size, role, action. Objects need ord, image_height and their fields."""
    rows = objects.where(F.coalesce("selectable", F.lit(True)))
    runs = F.when(F.size("runs") > 0, F.col("runs")).otherwise(F.array(F.struct(F.col("bounds"), F.col("text"))))
    rows = rows.select("*", F.posexplode(runs).alias("run_no", "run"))
    kind, b = T.known_type(F.col("type")), F.col("run.bounds")
    off = F.lit(False)
    act = T.action_enabled(kind, F.col("text"), F.col("intent"), off if may_disable is None else may_disable, off if platform_disables is None else platform_disables)
    act = act & F.lit(mode == "full") & ~(off if stale is None else stale)
    size = F.coalesce(N.font_percent(F.col("style.size"), F.col("image_height")), F.format_string("%.4f%%", b["h"]))
    return rows.select(
        "image_id",
        "ord",
        F.concat("id", F.lit("-r"), "run_no").alias("node"),
        kind.alias("type"),
        F.coalesce("run.text", "text").alias("label"),
        b["x"].alias("x"),
        b["y"].alias("y"),
        b["w"].alias("w"),
        b["h"].alias("h"),
        size.alias("font_size"),
        F.when(act, "button").otherwise("text").alias("role"),
        F.when(act, T.action_uri(kind, F.col("text"))).alias("action"),
        F.when(act, T.action_verb(kind)).alias("verb"),
    )


def box_fit(width_percent: Column, image_width: Column, natural: Column) -> Column:
    """Horizontal scale that makes text as wide as its box; null without a natural width."""
    return F.when(natural > 0, N.round_at(width_percent / 100 * image_width / natural, 4))
