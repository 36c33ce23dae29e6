"""Registry of the driver queries and what their SQL has in common."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.operators.layouts import doc_columns, with_doc_columns
from docledger.operators.lookups import Doc
from docledger.plans.render import render

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query with the SQL that gives the same result on the tables."""

    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def amount(column: Column, name: str) -> Column:
    return column.cast("double").alias(name)


def text(column: Column, name: str) -> Column:
    return F.coalesce(column, F.lit("")).alias(name)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir, which all executors reach; where that is unset, as on a
    single machine, the session gets a folder of its own once."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = f"file://{tempfile.mkdtemp(prefix='docledger-')}"
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/docledger/{name}-{uuid.uuid4().hex}"


def staged(spark: SparkSession, sf_dir: str, *kinds: str) -> tuple[DataFrame, Doc]:
    """Rendered documents with their cleaned columns."""
    return with_doc_columns(render(spark, sf_dir, *kinds), every_layout=True), doc_columns()


def lookup(
    name: str, kinds: tuple[str, ...], value: Callable[[Doc], dict[str, Column]], sql: str
) -> None:
    """Register one lookup over rendered documents, by document key."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs, doc = staged(spark, sf_dir, *kinds)
        return docs.select("doc_key", *[c.alias(n) for n, c in value(doc).items()])

    query(name, facts_sql(sql))(run)


# What the rendered documents say, straight from the tables: r holds invoice lines,
# f documents of orders with lines, fe all orders.
FACTS = """
r AS (
  SELECT l_orderkey AS k, p_name || ' ' || p_type AS description,
    'PT-' || lpad(CAST(l_partkey % 10000 AS VARCHAR), 4, '0') AS sku,
    CAST(l_quantity AS BIGINT) AS qty, CAST(p_retailprice AS DECIMAL(18,2)) AS unit,
    CAST(round(l_tax * 100) AS BIGINT) AS rate, CAST(l_extendedprice AS DECIMAL(18,2)) AS total,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
      l_quantity, l_extendedprice, l_tax) - 1 AS idx
  FROM lineitem JOIN part ON l_partkey = p_partkey
),
s AS (
  SELECT k, count(*) AS n, sum(total) AS sub, round(sum(total * rate), 0) * 0.01 AS tax
  FROM r GROUP BY k
),
fe AS (
  SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS doc_key, o_custkey,
    upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' House '
      || translate(CAST(c_custkey AS VARCHAR), '0123456789', 'bcdfghjklm') AS buyer,
    'Atlas Goods ' || o_orderstatus AS seller, CAST(o_orderdate AS DATE) AS d,
    CAST(o_orderdate AS DATE) + 30 AS due, CAST(o_totalprice AS DECIMAL(18,2)) AS price,
    coalesce(n, 0) AS n, coalesce(sub, 0) AS sub, coalesce(tax, 0) AS tax,
    coalesce(sub, 0) + coalesce(tax, 0) AS gross,
    CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END * (o_orderkey % 50 + 1) AS adjustment,
    o_orderkey % 40 + 0.25 AS receipt_tax
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN s ON o_orderkey = k
),
f AS (SELECT * FROM fe WHERE n > 0)
"""


def facts_sql(sql: str) -> str:
    """SQL over the facts; it may go on with further named parts after a comma."""
    return f"WITH {FACTS}{sql}"


def by_kind(kinds: tuple[str, ...], **values: str) -> str:
    """CASE over the kinds that take turns by order key."""
    branches = " ".join(f"WHEN {i} THEN {values[kind]}" for i, kind in enumerate(kinds))
    return f"CASE k % {len(kinds)} {branches} END"


# Line table of documents.text, as the line cleaning defines it.
WHITE = (
    r"\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
    r"\x{205f}\x{3000}"
)
LINES_SQL = (
    r"""
pieces AS (
  SELECT doc_id, trim(regexp_replace(replace(piece, chr(0), '-'), '["""
    + WHITE
    + r"""]+', ' ', 'g')) AS line, pos
  FROM (
    SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS pos
    FROM (SELECT doc_id, string_split_regex(text,
      '\r\n|[\n\x0b\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS p FROM documents)
  )
),
lines AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS line_no, line
  FROM pieces
  WHERE line <> '' AND NOT starts_with(line, '--- page ')
    AND NOT starts_with(line, 'Synthetic test invoice') AND NOT starts_with(line, 'Page ')
)
"""
)
