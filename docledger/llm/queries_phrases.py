"""Registered query of collocations."""

from __future__ import annotations

from docledger.llm import collocations
from docledger.llm.common import table
from docledger.llm.registry import query

OP11_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)
), counts AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS f
  FROM (
    SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i
          FROM pieces, (VALUES (1), (2), (3), (4)) AS ks(k) WHERE len(w) >= k)
  ) GROUP BY ALL
), totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS MATERIALIZED (
  SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND f >= 30
), sides AS MATERIALIZED (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)
), cuts AS (
  SELECT s.lang, s.phrase, a, s.k, l.f AS l, r.f AS r,
         2000000 * CAST(a AS HUGEINT) // (CAST(l.f AS HUGEINT) + r.f) AS score
  FROM sides s JOIN counts l ON l.lang = s.lang AND l.phrase = first JOIN counts r ON r.lang = s.lang AND r.phrase = rest
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, array_to_string(w[i:i + len - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, w, a, len, unnest(range(1, size - len + 2)) AS i
        FROM candidates, (VALUES (2), (3)) AS ls(len) WHERE len < size)
  GROUP BY ALL
), ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < 80 * CAST(a AS HUGEINT)
)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@query("op11_collocations", OP11_SQL)
def op11(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))
