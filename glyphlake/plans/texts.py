"""Queries on typed text fields: tokens of documents, urls of pages, turns of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import formats as K
from ..functions import numbers as N
from ..functions import text as T
from ..operators import layers as L
from ..operators import ocr
from .base import TOKENS, query, table, tokens

_TYPE = r"""CASE WHEN regexp_matches(token, '^[+()0-9][0-9\s\-().]{6,}$') AND length(regexp_replace(token, '[^0-9]', '', 'g')) >= 7 THEN 'phone'
  WHEN regexp_matches(token, '^(https?://|www\.)\S+$', 'i') THEN 'url' WHEN regexp_matches(token, '^\S+@\S+\.\S+$') THEN 'email' ELSE 'text' END"""
_SCHEME = r"lower(regexp_extract(token, '^([A-Za-z][A-Za-z0-9+.\-]*:)', 1))"
_SAFE = f"{_SCHEME} IN ('', 'https:', 'http:', 'tel:', 'mailto:', 'geo:')"
_URI = rf"""CASE type WHEN 'phone' THEN 'tel:' || regexp_replace(token, '[^+0-9]', '', 'g') WHEN 'email' THEN 'mailto:' || trim(token)
  WHEN 'url' THEN CASE WHEN {_SAFE} THEN regexp_replace(CASE WHEN regexp_matches(token, '^https?://', 'i') THEN token ELSE 'https://' || token END, '^http://', 'https://', 'i') END
  WHEN 'address' THEN 'https://maps.google.com/?q=' || replace(replace(replace(replace(replace(url_encode(token), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*') END"""
#: Tokens of documents and urls of pages
_FIELDS = TOKENS + f", f AS (SELECT 'd' || doc_id || '.' || pos AS id, token FROM tokens UNION ALL SELECT 'p' || page_id, url FROM pages), typed AS (SELECT id, token, {_TYPE} AS type FROM f)"


def fields(spark, d: str) -> DataFrame:
    """id, token, type."""
    t = tokens(table(spark, d, "documents")).select(F.concat(F.lit("d"), "doc_id", F.lit("."), "pos").alias("id"), "token")
    p = table(spark, d, "pages").select(F.concat(F.lit("p"), "page_id").alias("id"), F.col("url").alias("token"))
    maybe = F.col("token").rlike(r"[0-9@]|^(?i)(?:https?://|www\.)")  # all others are text
    return t.unionByName(p).withColumn("type", F.when(maybe, T.infer_type(F.col("token"))).otherwise("text"))


@query(f"WITH {_FIELDS} SELECT type, count(*) AS fields, count(DISTINCT token) AS forms FROM typed GROUP BY 1")
def infer_type_counts(spark, d):
    return fields(spark, d).groupBy("type").agg(F.count("*").alias("fields"), F.countDistinct("token").alias("forms"))


@query(f"WITH {_FIELDS} SELECT id, token, type FROM typed WHERE type <> 'text'")
def infer_type_tokens(spark, d):
    return fields(spark, d).where("type <> 'text'")


@query(f"""WITH {_FIELDS} SELECT id, CASE WHEN contains(token, '@') THEN 'email' WHEN regexp_matches(token, '^https?:', 'i') OR contains(token, '.') THEN 'url' ELSE 'phone' END AS direct,
  CASE WHEN regexp_matches(token, '^\\+?[0-9]{{8,}}$') THEN 'phone' WHEN regexp_matches(token, '^https?:', 'i') THEN 'url' ELSE 'text' END AS checked FROM typed WHERE type <> 'text'""")
def sniff_t1_type(spark, d):
    f = fields(spark, d).where("type <> 'text'")
    return f.select("id", T.sniff_value(F.col("token")).alias("direct"), T.sniff_verified(F.col("token")).alias("checked"))


@query(f"WITH {_FIELDS} SELECT id, type, {_URI} AS uri, CASE type WHEN 'phone' THEN 'Call' WHEN 'email' THEN 'Email' ELSE 'Open' END AS verb FROM typed WHERE type <> 'text'")
def action_uri(spark, d):
    f = fields(spark, d).where("type <> 'text'")
    return f.select("id", "type", T.action_uri(F.col("type"), F.col("token")).alias("uri"), T.action_verb(F.col("type")).alias("verb"))


@query(f"WITH q AS (SELECT conv_id, turn, text AS token, 'address' AS type FROM conversations) SELECT conv_id, turn, {_URI} AS uri FROM q")
def action_address(spark, d):
    """Every turn, however long."""
    return table(spark, d, "conversations").select("conv_id", "turn", T.action_uri(F.lit("address"), F.col("text")).alias("uri"))


@query(f"""WITH {_FIELDS}, i AS (SELECT *, CASE length(token) % 4 WHEN 0 THEN 'readonly' WHEN 1 THEN 'auto' WHEN 2 THEN 'actionable' END AS intent, length(token) % 3 = 0 AS may, length(token) % 2 = 0 AS off FROM typed WHERE type <> 'text' OR length(token) = 12)
SELECT id, type <> 'text' AND NOT (may AND off) AND coalesce(intent, 'actionable') <> 'readonly' AND ({_URI}) IS NOT NULL AS enabled FROM i""")
def action_enabled(spark, d):
    f = fields(spark, d).where("type <> 'text' or length(token) = 12")
    n = F.length("token")
    intent = F.when(n % 4 == 0, "readonly").when(n % 4 == 1, "auto").when(n % 4 == 2, "actionable")
    return f.select("id", T.action_enabled(F.col("type"), F.col("token"), intent, n % 3 == 0, n % 2 == 0).alias("enabled"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 AND req IN ('raster_only', 'blocked') THEN 'button_only' ELSE req END AS mode FROM (
SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'button_only' WHEN 2 THEN 'raster_only' ELSE 'blocked' END AS req FROM conversations)""")
def mode_resolve(spark, d):
    c, k = table(spark, d, "conversations"), F.col("conv_id") % 4
    asked = F.when(k == 0, "full").when(k == 1, "button_only").when(k == 2, "raster_only").otherwise("blocked")
    may = F.when(F.col("turn") % 3 == 0, False).when(F.col("turn") % 3 == 1, True)
    return c.select("conv_id", "turn", L.resolved_mode(may, asked).alias("mode"))


@query(f"WITH {_FIELDS} SELECT id, octet_length(encode(token)) <= 16 AS fits FROM typed WHERE type <> 'text'")
def t1_fits(spark, d):
    return fields(spark, d).where("type <> 'text'").select("id", T.fits(F.col("token")).alias("fits"))


@query(f"WITH {_FIELDS} SELECT id, regexp_replace(token, '[^+0-9]', '', 'g') AS phone FROM typed WHERE type = 'phone'")
def norm_phone(spark, d):
    return fields(spark, d).where("type = 'phone'").select("id", T.phone_form(F.col("token")).alias("phone"))


@query("SELECT doc_id, md5(trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g'))) AS form FROM documents")
def norm_generic(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.generic_form(F.col("text"))).alias("form"))


@query(r"""SELECT page_id, regexp_replace(lower(h) || substr(url, length(h) + 1), '/$', '') AS form FROM (SELECT page_id, url, regexp_extract(url, '^((?:[A-Za-z][A-Za-z0-9+.\-]*://)?[^/?#]*)', 1) AS h FROM pages)""")
def norm_url(spark, d):
    return table(spark, d, "pages").select("page_id", T.url_form(F.col("url")).alias("form"))


@query("SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_.\\-]+', '-', 'g') AS name, replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped, length(url) * 12 * 0.6::DOUBLE AS width FROM pages")
def text_helpers(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", T.file_name(u).alias("name"), T.xml_escaped(u).alias("escaped"), T.text_width(u, 12).alias("width"))


_CRC_BITS = "list_reduce(list_concat([xor(c, b << 8)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda p, q: CASE WHEN p & 32768 <> 0 THEN xor((p << 1) & 65535, 4129) ELSE (p << 1) & 65535 END)"


@query("""WITH RECURSIVE u AS (SELECT page_id, encode(url) AS raw FROM pages),
n AS (SELECT page_id, i, ('0x' || substr(hex(raw), 2 * i - 1, 2))::INTEGER AS b FROM (SELECT page_id, raw, unnest(range(1, octet_length(raw) + 1)) AS i FROM u)),
f AS (SELECT page_id, 0::BIGINT AS i, 65535 AS c, (SELECT max(i) FROM n WHERE n.page_id = u.page_id) AS last FROM u
UNION ALL SELECT f.page_id, f.i + 1, """ + _CRC_BITS + """, last FROM f JOIN n ON n.page_id = f.page_id AND n.i = f.i + 1)
SELECT page_id, c::INTEGER AS crc16 FROM f WHERE i = last""")
def crc16_text(spark, d):
    return table(spark, d, "pages").select("page_id", T.crc16(F.encode("url", "UTF-8")).alias("crc16"))


_CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda p, q: xor(p >> 1, 3988292384 * (p & 1)))), 4294967295)"""


@query(f"""WITH {_FIELDS}, h AS (SELECT id, hex(encode(token)) AS x FROM typed WHERE type <> 'text'), c AS (SELECT id, {_CRC32} AS c FROM h)
SELECT id, c AS crc32, '5631' || lpad(to_hex(c), 8, '0') AS payload FROM c""")
def crc32_text(spark, d):
    """Verify payloads of all typed fields."""
    f = fields(spark, d).where("type <> 'text'")
    return f.select("id", F.crc32(F.encode("token", "UTF-8")).alias("crc32"), F.hex(L.checksum_payload(F.col("token"))).alias("payload"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_valid(props) AS valid FROM events")
def events_props_json(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.try_parse_json("props").isNotNull().alias("valid"))


@query(f"SELECT event_id, '{K.ID_PREFIX}' || lower(to_base(epoch_us(ts) // 1000, 36)) AS content_id FROM events")
def content_ids(spark, d):
    return table(spark, d, "events").select("event_id", T.base36(F.unix_millis(F.col("ts").cast("timestamp"))).alias("content_id"))


# --- verify mode ---


def lines(spark, d: str) -> DataFrame:
    """A line of up to 12 words around each phone token."""
    docs = table(spark, d, "documents").select("doc_id", F.filter(F.split("text", r"[ \t\n\r]+"), lambda w: w != "").alias("w"))
    docs = docs.where(F.exists("w", lambda w: w.rlike(K.PHONE)))
    phone = lambda w, i: F.when(w.rlike(K.PHONE) & (T.infer_type(w) == "phone"), i)
    at = docs.select("doc_id", "w", F.explode(F.array_compact(F.transform("w", phone))).alias("at"))
    low = F.greatest(F.lit(0), F.col("at") - 3)
    words = F.slice("w", low + 1, F.col("at") + 4 - low)
    return at.select(F.concat("doc_id", F.lit("."), "at").alias("doc"), F.lit(0).alias("line"), F.get("w", F.col("at")).alias("phone"), words.alias("words"))


_LINES = TOKENS + f""", p AS (SELECT doc_id, pos AS pt, token AS phone FROM tokens WHERE ({_TYPE}) = 'phone'),
lines AS (SELECT t.doc_id || '.' || pt AS doc, phone, list(token ORDER BY pos) AS words FROM tokens t JOIN p ON t.doc_id = p.doc_id AND abs(pos - pt) <= 3 GROUP BY t.doc_id, pt, phone)"""


@query(f"""WITH {_LINES}, s AS (SELECT *, unnest(range(0, len(words))) AS start FROM lines), e AS (SELECT *, unnest(range(start + 1, len(words) + 1)) AS stop FROM s)
SELECT doc, start::INTEGER AS start, stop::INTEGER AS stop, array_to_string(words[start + 1:stop], ' ') AS span FROM e""")
def ocr_windows(spark, d):
    return ocr.word_windows(lines(spark, d)).select("doc", "start", "stop", "span")


@query(f"""WITH {_LINES} SELECT doc, min(regexp_replace(phone, '[^+0-9]', '', 'g')) AS exact FROM lines WHERE length(regexp_replace(phone, '[^0-9]', '', 'g')) >= 8 GROUP BY 1""")
def ocr_oracle_search(spark, d):
    """Misread lines (0 as O, 1 as l, 5 as S) and the phone's checksum give back the phone."""
    told = lines(spark, d).where(F.length(T.digits(F.col("phone"))) >= 8).withColumn("crc", F.crc32(F.encode(T.phone_form(F.col("phone")), "UTF-8")))
    read = told.withColumn("words", F.transform("words", lambda w: F.translate(w, "015", "OlS")))
    w = ocr.word_windows(read, 3).join(told.select("doc", "crc"), "doc")
    return ocr.search(w, F.col("crc")).select("doc", "exact")


@query(f"""WITH {_LINES}, w AS (SELECT doc, unnest(range(1, len(words) + 1)) AS i, words FROM lines),
y AS (SELECT doc, pos, len, coalesce(sum(len + 7) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x0 FROM (SELECT doc, i - 1 AS pos, 7 * length(words[i]) AS len FROM w)),
g AS (SELECT doc, min(x0) AS x0, max(x0 + len) AS x1, min(10 + pos) AS y0, max(22 + pos) AS y1 FROM y WHERE pos >= 1 AND pos < 3 GROUP BY 1)
SELECT doc, floor(100 * x0 / 640.0::DOUBLE * 100 + 0.5) / 100 AS x, floor(100 * y0 / 480.0::DOUBLE * 100 + 0.5) / 100 AS y, floor(100 * (x1 - x0) / 640.0::DOUBLE * 100 + 0.5) / 100 AS w, floor(100 * (y1 - y0) / 480.0::DOUBLE * 100 + 0.5) / 100 AS h FROM g""")
def word_box_union(spark, d):
    from pyspark.sql import Window

    w = lines(spark, d).select("doc", F.posexplode("words").alias("pos", "word")).withColumn("len", F.length("word") * 7)
    before = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("x0", F.coalesce(F.sum(F.col("len") + 7).over(before), F.lit(0))).withColumn("x1", F.col("x0") + F.col("len"))
    w = w.withColumn("y0", F.col("pos") + 10).withColumn("y1", F.col("pos") + 22).withColumn("start", F.lit(1)).withColumn("stop", F.lit(3))
    return ocr.joined_box(w, F.lit(640.0), F.lit(480.0)).select("doc", "x", "y", "w", "h")


# --- numbers ---

_PX = "({0} = floor({0}) AND {0} > 1)"


@query(f"""WITH b AS (SELECT p_partkey, (p_partkey % 90)::DOUBLE AS x, (p_partkey % 7) / 2.0::DOUBLE AS y, (p_size % 20 + 0.5)::DOUBLE AS w, 1.0::DOUBLE AS h FROM part),
k AS (SELECT *, {_PX.format("x")} OR {_PX.format("y")} OR {_PX.format("w")} OR {_PX.format("h")} AS px FROM b)
SELECT p_partkey, px AS pixels, CASE WHEN px THEN floor(100 * x / 640 * 10000 + 0.5) / 10000 ELSE x END AS x, CASE WHEN px THEN floor(100 * h / 480 * 10000 + 0.5) / 10000 ELSE h END AS h FROM k""")
def geom_to_pct(spark, d):
    b = F.struct((F.col("p_partkey") % 90).cast("double").alias("x"), ((F.col("p_partkey") % 7) / 2.0).alias("y"), (F.col("p_size") % 20 + 0.5).cast("double").alias("w"), F.lit(1.0).alias("h"))
    p = table(spark, d, "part").withColumn("b", b)
    pct = N.to_percent(F.col("b"), F.lit(640), F.lit(480))
    return p.select("p_partkey", N.is_pixels(F.col("b")).alias("pixels"), pct["x"].alias("x"), pct["h"].alias("h"))


@query("SELECT p_partkey, greatest(8, (floor((p_size * 10) / (p_partkey % 400 + 1.0::DOUBLE) * 1024 / 8 + 0.5) * 8)::INTEGER) AS height, floor(100 * (p_size - 3) / 57.0::DOUBLE * 100 + 0.5) / 100 AS share, printf('%.3f%%', floor(p_size * 1.333::DOUBLE / (p_partkey % 400 + 1) * 100 * 1000 + 0.5) / 1000) AS font FROM part")
def canonical_height(spark, d):
    w, size = F.col("p_partkey") % 400 + 1, F.col("p_size")
    return table(spark, d, "part").select("p_partkey", N.canonical_height(w, size * 10).alias("height"), N.share(size, 3, 57.0).alias("share"), N.font_percent(size, w).alias("font"))
