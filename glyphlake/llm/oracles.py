"""DuckDB SQL for what SQL can say of the operators: whole queries, or the columns that a query of its own picks."""

from __future__ import annotations

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def crc32(hexed: str) -> str:
    """Of bytes given as hexadecimal digits."""
    byte = f"list_transform(range(0, length({hexed}) // 2), lambda i: ('0x' || substr({hexed}, 2 * i + 1, 2))::BIGINT)"
    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, e: xor(d >> 1, 3988292384 * (d & 1)))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {byte}), lambda c, b: {step}), 4294967295)"


def islands(width: int) -> str:
    """Of hits(r, i): covered(r, a, b), the runs that windows of this width cover."""
    return f"""marked AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + {width} THEN 0 ELSE 1 END AS new FROM hits),
  run AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM marked),
  covered AS (SELECT r, min(i) AS a, max(i) + {width - 1} AS b FROM run GROUP BY r, k)"""


SUFFIX = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
  win AS (SELECT r, i, md5(substr(x, 2 * i - 1, 400)) AS s FROM (SELECT r, x, unnest(generate_series(1, length(x) // 2 - 199)) AS i FROM t)),
  twice AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
  hits AS (SELECT r, i FROM win SEMI JOIN twice USING (s)),
  {islands(200)},
  gone AS (SELECT r, sum(b - a + 1) AS n, count(*) AS k FROM covered GROUP BY r),
  edges AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) + 1 AS a, a - 1 AS b FROM covered
            UNION ALL SELECT r, max(b) + 1, NULL FROM covered GROUP BY r),
  kept AS (SELECT r, string_agg(CASE WHEN e.b IS NULL THEN substr(x, 2 * e.a - 1) ELSE substr(x, 2 * e.a - 1, 2 * (e.b - e.a + 1)) END, '' ORDER BY e.a) AS y FROM edges e JOIN t USING (r) GROUP BY r)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(k, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(y, x))) AS kept_sha256
FROM t LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)
"""

PHRASES = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
  win AS (SELECT r, i, md5(array_to_string(w[i : i + 34], ' ')) AS s FROM (SELECT r, w, unnest(generate_series(1, len(w) - 34)) AS i FROM t)),
  twice AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
  hits AS (SELECT r, i FROM win SEMI JOIN twice USING (s)),
  {islands(35)},
  gone AS (SELECT r, sum(b - a + 1) AS n FROM covered GROUP BY r),
  edges AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) + 1 AS a, a - 1 AS b FROM covered
            UNION ALL SELECT r, max(b) + 1, NULL FROM covered GROUP BY r),
  kept AS (SELECT r, array_to_string(flatten(list(CASE WHEN e.b IS NULL THEN w[e.a :] WHEN e.b < e.a THEN [] ELSE w[e.a : e.b] END ORDER BY e.a)), ' ') AS y FROM edges e JOIN t USING (r) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(y, array_to_string(w, ' '))) AS kept_sha256
FROM t LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)
"""

JACCARD = f"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format(LOWER)} AS w FROM documents),
  s AS (SELECT r, doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i : i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM t),
  e AS (SELECT r, len(g) AS n, unnest(g) AS h FROM s),
  links AS (SELECT a.r AS a, b.r AS b FROM e a JOIN e b USING (h) WHERE a.r <> b.r GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
  reach AS (SELECT r AS a, r AS b FROM s UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM s JOIN reach ON s.r = reach.a JOIN s o ON o.r = reach.b GROUP BY s.r, s.doc_id, len(s.g)
"""

MIXING_TARGETS = f"""
WITH t AS (SELECT doc_id, source, len({WORDS.format("coalesce(text, '')")}) AS size FROM documents),
  per AS (SELECT source, sum(size)::DOUBLE AS n, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1]::DOUBLE AS w FROM t GROUP BY source),
  tried AS (SELECT *, row_number() OVER sorted AS k, (1.5 * sum(n) OVER () - coalesce(sum(2 * n) OVER (sorted ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                   / sum(w) OVER (sorted ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM per WINDOW sorted AS (ORDER BY 2 * n / w, source IS NOT NULL, source)),
  level AS (SELECT arg_min(level, k) FILTER (level <= 2 * n / w) AS level FROM tried)
SELECT doc_id, size::BIGINT AS size, n::BIGINT AS source_size, round(least(2 * n, coalesce(level.level * w, 2 * n)), 4) AS target
FROM t JOIN per ON t.source IS NOT DISTINCT FROM per.source, level
"""

LM_BASE = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, {crc32("hex(encode(coalesce(doc_id::VARCHAR, '')))")} % 5 = 1 AS held, list_append({WORDS.format(LOWER)}, ' ') AS w FROM documents),
  e AS (SELECT r, held, unnest(w) AS h FROM t),
  c AS (SELECT h, count(*) AS c FROM e WHERE NOT held GROUP BY h),
  a AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM c),
  b AS (SELECT r, count(*) AS n_tokens, count(c) AS n_known, sum(log10((coalesce(c, 0) + 0.5) / (a.n + 0.5 * (a.v + 1)))) AS base FROM e LEFT JOIN c USING (h), a GROUP BY r)
SELECT doc_id, held AS held_out, n_tokens::BIGINT AS n_tokens, n_known::BIGINT AS n_known, a.n::BIGINT AS train_tokens, round(base, 4) AS base_score FROM t JOIN b USING (r), a
"""

MEDIA_PAYLOADS = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
  p AS (SELECT doc_id, n, x || repeat(' ', CASE WHEN n = 0 THEN 192 ELSE (192 - n % 192) % 192 END) AS y FROM t),
  z AS (SELECT doc_id, n, hex(encode(y)) AS y FROM p)
SELECT doc_id, n::BIGINT AS n_bytes, (length(y) // 2)::BIGINT AS payload_bytes, sha256(unhex(y)) AS payload_sha256, {crc32("right(y, 32)")}::BIGINT AS tail_crc32 FROM z
"""

SQL = {"op5_jaccard": JACCARD, "op8_suffix": SUFFIX, "op9_phrases": PHRASES, "mixing_targets": MIXING_TARGETS, "lm_base": LM_BASE, "media_payloads": MEDIA_PAYLOADS}
