"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from siltstone.llm import handwritten, leaks, markup, neardup, packing, split, stuffing, vectorjoin
from siltstone.plans.tables import table


def p1_found(spark, d):
    return handwritten.found(table(spark, d, "files"), table(spark, d, "chunks"))


def p1_judged(spark, d):
    return handwritten.judged(table(spark, d, "files"), table(spark, d, "chunks"))


def p1_patterns(spark, d):
    return handwritten.patterns(table(spark, d, "files"), table(spark, d, "chunks"))


def p3_found(spark, d):
    return vectorjoin.pairs(table(spark, d, "vectors"))


def p3_neighbours(spark, d):
    return vectorjoin.neighbours(table(spark, d, "vectors"))


def p3_kept(spark, d):
    """How much of what is searched the codes leave to be compared exactly."""
    return vectorjoin.kept_share(table(spark, d, "vectors"))


def p4_found(spark, d):
    return neardup.pairs(table(spark, d, "chunks"))


def p4_groups(spark, d):
    return neardup.groups(table(spark, d, "chunks"))


def p4_visited(spark, d):
    return neardup.visited(table(spark, d, "chunks"))


def p5_found(spark, d):
    return split.forced_cuts(table(spark, d, "chunks"))


def p5_pieces(spark, d):
    return split.split(table(spark, d, "chunks"))


def p6_found(spark, d):
    return markup.chunk_kinds(table(spark, d, "files"), table(spark, d, "chunks"))


def p6_clean(spark, d):
    return markup.clean_chunks(table(spark, d, "files"), table(spark, d, "chunks"))


def p7_found(spark, d):
    return packing.oversized(table(spark, d, "documents"))


def p7_containers(spark, d):
    return packing.pack(table(spark, d, "documents"))


def p7_unused(spark, d):
    return packing.fill_report(packing.pack(table(spark, d, "documents")))


def p8_found(spark, d):
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark, d):
    return stuffing.found(table(spark, d, "documents"))


P5_SQL = r"""
WITH big AS (SELECT chunk_id, coalesce(start_line, 1) AS first, text FROM chunks WHERE length(text) > 800),
lines AS (
  SELECT chunk_id, first, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i,
         len(string_split(text, chr(10))) AS n FROM big),
placed AS (
  SELECT *, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) = '' AS blank,
         coalesce(sum(length(raw) + 1) OVER (PARTITION BY chunk_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
  FROM lines),
ended AS (SELECT *, a + length(raw) - CASE WHEN raw LIKE '%' || chr(13) AND i < n THEN 1 ELSE 0 END AS z FROM placed),
grouped AS (SELECT *, sum(CASE WHEN blank THEN 1 ELSE 0 END) OVER (PARTITION BY chunk_id ORDER BY i) AS g FROM ended),
blocks AS (
  SELECT chunk_id, any_value(first) + min(i) - 1 AS line_no, min(a) AS a, max(z) AS z
  FROM grouped WHERE NOT blank GROUP BY chunk_id, g),
pairs AS (SELECT *, lag(a) OVER w AS pa, lag(z) OVER w AS pz FROM blocks WINDOW w AS (PARTITION BY chunk_id ORDER BY a))
SELECT chunk_id, CAST(line_no AS BIGINT) AS line_no FROM pairs WHERE z - a <= 800 AND pz - pa <= 800 AND z - pa > 800
"""

P4_SQL = r"""
WITH words AS (SELECT chunk_id, file_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM chunks),
runs AS (
  SELECT DISTINCT chunk_id, file_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS run
  FROM (SELECT chunk_id, file_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM words WHERE len(w) >= 20)),
sizes AS (SELECT chunk_id, count(*) AS n FROM runs GROUP BY chunk_id),
common AS (SELECT a.chunk_id AS x, b.chunk_id AS y, count(*) AS n FROM runs a JOIN runs b ON a.run = b.run AND a.chunk_id < b.chunk_id AND a.file_id <> b.file_id GROUP BY ALL)
SELECT x AS chunk_id_a, y AS chunk_id_b FROM common c JOIN sizes p ON p.chunk_id = x JOIN sizes q ON q.chunk_id = y WHERE c.n / (p.n + q.n - c.n) >= 0.6
"""

P8_SQL = r"""
WITH own AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'e', item_id, text FROM eval_items),
words AS (SELECT kind, id, regexp_extract_all(lower(strip_accents(regexp_replace(text, '[\p{Cf}\p{Mn}\p{Me}\x{115F}\x{1160}\x{3164}\x{FFA0}]+', '', 'g'))), '[\p{L}\p{N}]+') AS w FROM own WHERE text <> ''),
toks AS (SELECT kind, id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM words),
grams AS MATERIALIZED (SELECT kind, id, string_agg(t, ' ') OVER twelve AS g, count(*) OVER twelve AS n FROM toks WINDOW twelve AS (PARTITION BY kind, id ORDER BY i ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING))
SELECT DISTINCT d.id AS doc_id, e.id AS item_id FROM grams d JOIN grams e ON d.g = e.g AND d.n = 12 AND e.n = 12 WHERE d.kind = 'd' AND e.kind = 'e'
"""

QUERIES = {"p1_found": p1_found, "p1_judged": p1_judged, "p1_patterns": p1_patterns, "p3_found": p3_found, "p3_neighbours": p3_neighbours, "p3_kept": p3_kept, "p4_found": p4_found, "p4_groups": p4_groups, "p4_visited": p4_visited, "p5_found": p5_found, "p5_pieces": p5_pieces, "p6_found": p6_found, "p6_clean": p6_clean, "p7_found": p7_found, "p7_containers": p7_containers, "p7_unused": p7_unused, "p8_found": p8_found, "p9_found": p9_found}
SQL = {"p4_found": P4_SQL, "p5_found": P5_SQL, "p8_found": P8_SQL}
