"""Registered queries of decontamination, mixing and token output."""

from __future__ import annotations

from docledger.llm import decontaminate, mixing, packing, tokens
from docledger.llm.common import table
from docledger.llm.registry import query

SPACES = r"[^\x20\x09-\x0D]+"

OP2_SQL = rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{SPACES}')) AS size,
         md5('17|' || coalesce(source, '') || '|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         md5(coalesce(text, '')) AS th
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sources
), by_level AS (
  SELECT *, 2.0 * source_size / weight AS level,
         sum(weight) OVER () - coalesce(sum(weight) OVER up, 0) AS weights,
         1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER up, 0) AS room
  FROM ranked
  WINDOW up AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), water AS (
  SELECT max(CAST(room AS DOUBLE) / weights) AS level FROM by_level WHERE CAST(room AS DOUBLE) / weights <= level
), targets AS (
  SELECT source, source_size,
         CASE WHEN weight * water.level < 2 * source_size THEN weight * water.level ELSE 2.0 * source_size END AS target
  FROM ranked, water
), placed AS (
  SELECT s.*, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS wanted,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id NULLS LAST, size, th
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST((CASE WHEN source_size > 0 THEN wanted // source_size ELSE 0 END) * size
         + greatest(0, least(size, (CASE WHEN source_size > 0 THEN wanted % source_size ELSE 0 END) - before)) AS BIGINT) AS taken
FROM placed
"""

OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, n, w[i:i + n - 1] AS words
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i
        FROM b WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT r, i, n, w[i:i + n - 1] AS words
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)
), found AS (
  SELECT p.r, p.i, p.n, x.item_id FROM places p JOIN windows x ON p.n = x.n AND p.words = x.words
), hits AS (
  SELECT r, count(DISTINCT i + k) AS n_hit
  FROM (SELECT DISTINCT r, i, unnest(range(0, n)) AS k FROM found) GROUP BY r
), items AS (
  SELECT r, count(DISTINCT item_id) AS n_items,
         string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM found GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""


@query("op2_mixing", OP2_SQL)
def op2(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op7_decontaminate", OP7_SQL)
def op7(spark, sf_dir):
    found = decontaminate.find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.report(found)


@query("op9_tokens")
def op9(spark, sf_dir):
    return tokens.tokenized(table(spark, sf_dir, "documents"), tokens.default_tokenizer())


@query("op12_packing")
def op12(spark, sf_dir):
    pieces = packing.pack(table(spark, sf_dir, "documents"), packing.default_tokenizer())
    return pieces.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
