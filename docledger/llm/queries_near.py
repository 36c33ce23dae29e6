"""Registered query of the n-gram Jaccard join."""

from __future__ import annotations

from docledger.llm import jaccard
from docledger.llm.common import table
from docledger.llm.registry import query

OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT DISTINCT r, array_to_string(words[i:i + 4], ' ') AS shingle
  FROM (SELECT r, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)
), sized AS (SELECT r, count(*) AS n FROM s GROUP BY r),
shared AS (
  SELECT a.r AS r1, b.r AS r2, count(*) AS o FROM s a JOIN s b ON a.shingle = b.shingle AND a.r <> b.r GROUP BY 1, 2
), links AS (
  SELECT r1, r2 FROM shared JOIN sized x ON x.r = r1 JOIN sized y ON y.r = r2 WHERE 100 * o >= 75 * (x.n + y.n - o)
), reach AS (
  SELECT r AS r1, r AS r2 FROM w UNION SELECT reach.r1, links.r2 FROM reach JOIN links ON reach.r2 = links.r1
), least AS (SELECT r1 AS r, min(doc_id) AS component_id FROM reach JOIN w ON w.r = r2 GROUP BY 1)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM w LEFT JOIN sized USING (r) JOIN least USING (r)
"""


@query("op3_jaccard", OP3_SQL)
def op3(spark, sf_dir):
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))
