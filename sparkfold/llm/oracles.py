"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_BLANKS = r"[\x20\x09-\x0D]"

OP6 = rf"""
WITH sizes AS (
  SELECT doc_id, coalesce('1' || source, '2') AS src, len({_WORDS})::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix'), 1, 15))::BIGINT AS key
  FROM documents
), s1 AS (
  SELECT row_number() OVER (ORDER BY src) - 1 AS sid, src, source_size FROM (SELECT src, sum(size)::BIGINT AS source_size FROM sizes GROUP BY src)
), s2 AS (
  SELECT *, [5, 2, 1][sid % 3 + 1]::BIGINT AS w, 2 * source_size AS cap FROM s1
), s3 AS (
  SELECT *, cap / w AS ratio, sum(source_size) OVER ()::DOUBLE * 3 / 2 AS total, sum(w) OVER () AS all_w,
         coalesce(sum(cap) OVER b, 0) AS cap_before, coalesce(sum(w) OVER b, 0) AS w_before
  FROM s2 WINDOW b AS (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), s4 AS (
  SELECT *, (total - cap_before::DOUBLE) / (all_w - w_before)::DOUBLE AS level FROM s3
), s5 AS (
  SELECT *, level * w > cap AS is_full FROM s4
), s6 AS (
  SELECT *, CASE WHEN is_full THEN cap::DOUBLE ELSE (SELECT level FROM s5 WHERE NOT is_full ORDER BY ratio, sid LIMIT 1) * w END AS target FROM s5
), s7 AS (
  SELECT *, greatest(1, least(64, source_size // 16))::BIGINT AS width FROM s6
), s8 AS (
  SELECT *, ceil(source_size / width)::BIGINT AS blocks FROM s7
), s9 AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(floor(target / source_size)::BIGINT * blocks
    + least(round((target - floor(target / source_size) * source_size) / width)::BIGINT, blocks), 2 * blocks) END AS n FROM s8
), placed AS (
  SELECT d.doc_id, d.size, s.source_size, s.target, s.sid, s.width, s.blocks, s.n,
         (sum(d.size) OVER (PARTITION BY s.sid ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size)::BIGINT AS start
  FROM sizes d JOIN s9 s USING (src)
)
SELECT doc_id, size, p.source_size, p.target,
       CASE WHEN size = 0 THEN 0 ELSE size * (n // blocks) + greatest(0, least(start + size, (n % blocks) * width) - start) END::BIGINT AS taken
FROM placed p
"""

OP8 = rf"""
WITH base AS (
  SELECT doc_id, source, {_WORDS} AS w, coalesce(text, '') AS t,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '{_BLANKS}', '', 'g') <> '') AS lines
  FROM documents
), grams AS (
  SELECT doc_id, i, w || ' ' || lead(w) OVER d || ' ' || lead(w, 2) OVER d || ' ' || lead(w, 3) OVER d || ' ' || lead(w, 4) OVER d AS g
  FROM (SELECT doc_id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM base) WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams WHERE g IS NOT NULL
), repeated AS (
  SELECT doc_id, count(DISTINCT i + o)::BIGINT AS n FROM windows, (SELECT unnest(range(5)) AS o) WHERE c > 1 GROUP BY doc_id
), counts AS (
  SELECT b.doc_id, source, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM base b LEFT JOIN repeated r USING (doc_id)
), ruled AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS r0, 100 * n_symbols > 30 * n_words AS r1,
         100 * n_dup_lines > 30 * n_lines AS r2, word_chars > 15 * n_words AS r3
  FROM counts
), hosts AS (
  SELECT source, r, count(*) AS n, sum(f::INT) AS f
  FROM (SELECT source, unnest([0, 1, 2, 3]) AS r, unnest([r0, r1, r2, r3]) AS f FROM ruled WHERE source IS NOT NULL) GROUP BY source, r
), means AS (
  SELECT r, sum(f) / sum(n) AS m, sum(n) AS docs FROM hosts GROUP BY r
), priors AS (
  SELECT r, m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1), 10000) ELSE 10000 END AS s
  FROM (SELECT r, m, sum(n * (f / n - m) ** 2) / docs AS v FROM hosts JOIN means USING (r) GROUP BY r, m, docs)
), rejected AS (
  SELECT DISTINCT source FROM hosts JOIN priors USING (r) WHERE (f + s * m) / (n + s) > 0.5
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, r0 AS base_failed,
       NOT r0 AND (source IS NULL OR source NOT IN (SELECT source FROM rejected)) AS kept
FROM ruled
"""


OP3 = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), links AS MATERIALIZED (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE list_inner_product(x.e, x.e) > 0 AND list_inner_product(y.e, y.e) > 0 AND list_cosine_similarity(x.e, y.e) >= 0.98
), reach AS (
  SELECT a AS node, b AS goal FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.goal
)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(c, v.vec_id)) AS component_id, v.vec_id = least(v.vec_id, coalesce(c, v.vec_id)) AS kept
FROM v LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id)
LEFT JOIN (SELECT node AS vec_id, min(goal) AS c FROM reach GROUP BY node) USING (vec_id)
"""

OP5 = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 75 * (na.n + nb.n - o)
), reach AS (
  SELECT a AS node, b AS goal FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.goal
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(c.c, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node AS doc_id, min(goal) AS c FROM reach GROUP BY node) c USING (doc_id)
"""


#: DuckDB's levenshtein counts bytes, so the other characters of a pair are exchanged for control characters first.
OP2 = r"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10)))))::INTEGER AS line_no FROM documents WHERE text IS NOT NULL
), lines AS MATERIALIZED (
  SELECT doc_id, line_no, trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x FROM raw
), classes AS MATERIALIZED (
  SELECT x, length(x) AS n, min({'d': doc_id, 'l': line_no}) AS rep FROM lines WHERE x <> '' GROUP BY x
), pairs AS MATERIALIZED (
  SELECT a.x AS a, b.x AS b, array_to_string(list_distinct(regexp_extract_all(a.x || b.x, '[^\x00-\x7F]')), '') AS wide
  FROM classes a JOIN classes b ON a.x < b.x AND b.n BETWEEN a.n - 2 AND a.n + 2 WHERE levenshtein(a.x, b.x) <= 8
), near AS MATERIALIZED (
  SELECT a, b FROM pairs, (SELECT array_to_string(list_transform([1, 2, 3, 4, 5, 6, 7, 8, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 27, 28, 29, 30, 31], lambda c: chr(c)), '') AS other)
  WHERE levenshtein(translate(a, wide, other), translate(b, wide, other)) <= 2
), ends AS (
  SELECT a, b FROM near UNION ALL SELECT b, a FROM near
), linked AS (
  SELECT a AS x, count(*) AS n_links, min(rep) AS first FROM ends JOIN classes ON x = b GROUP BY a
)
SELECT doc_id, line_no, rep.d AS rep_doc_id, rep.l AS rep_line_no, coalesce(n_links, 0)::BIGINT AS n_links,
       doc_id = rep.d AND line_no = rep.l AND (first IS NULL OR rep < first) AS kept
FROM lines JOIN classes USING (x) LEFT JOIN linked USING (x)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2, "op3_near_vectors": OP3, "op5_ngram_join": OP5, "op6_mix": OP6, "op8_quality": OP8}
