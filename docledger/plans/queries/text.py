"""Lines, text functions and amounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from docledger.functions import keys as K
from docledger.functions import money as M
from docledger.functions import text as X
from docledger.functions.dates import to_iso_date
from docledger.operators.lines import assemble_pages, document_lines, is_scanned, page_lines
from docledger.operators.lookups import currency, document_type
from docledger.operators.tax import tax_category
from docledger.operators.ubl import UNKNOWN_CUSTOMER, UNKNOWN_SUPPLIER, party_name, ubl_type
from docledger.operators.layouts import doc_columns, with_doc_columns
from docledger.plans.queries.base import (
    FACTS,
    LINES_SQL,
    WHITE,
    amount,
    by_kind,
    facts_sql,
    lookup,
    query,
)
from docledger.plans.render import line_facts, order_facts, table

PAGE_SQL = """
SELECT conv_id, string_agg(chr(10) || '--- page ' || CAST(turn + 1 AS VARCHAR) || ' ---' || chr(10)
  || text, chr(10) ORDER BY turn) AS text
FROM conversations GROUP BY conv_id
"""


def _pages(spark, sf):
    return table(spark, sf, "conversations").withColumn("page_no", F.col("turn") + 1)


@query("assemble_pages", PAGE_SQL)
def _(spark, sf):
    return assemble_pages(_pages(spark, sf), "conv_id", "page_no", "text")


@query(
    "page_lines",
    rf"""WITH p AS ({PAGE_SQL}), documents AS (SELECT conv_id AS doc_id, text FROM p), {LINES_SQL}
    SELECT doc_id AS conv_id, line_no, line FROM lines""",
)
def _(spark, sf):
    return page_lines(_pages(spark, sf), "conv_id", "page_no", "text")


@query(
    "normalize_line",
    rf"""SELECT doc_id, trim(regexp_replace(replace(text, chr(0), '-'), '[{WHITE}]+', ' ', 'g'))
    AS line FROM documents""",
)
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", X.normalize_line(F.col("text")).alias("line")
    )


@query("clean_lines", f"WITH {LINES_SQL} SELECT doc_id, line_no, line FROM lines")
def _(spark, sf):
    lines = document_lines(table(spark, sf, "documents"), "doc_id")
    return lines.withColumn("line_no", F.col("line_no").cast("bigint"))


@query("casefold", "SELECT doc_id, replace(lower(text), 'ß', 'ss') AS folded FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", X.casefold(F.col("text")).alias("folded")
    )


# ---- amounts in text: one printed line per invoice line ----


def _priced(spark, sf):
    """Invoice lines with a text that prints their numbers in several forms."""
    lines = line_facts(spark, sf)
    s = lambda c: F.col(c).cast("string")
    printed = F.concat(
        F.lit("Lot"),
        s("l_partkey"),
        F.lit(" qty "),
        s("qty"),
        F.lit(" at US$"),
        F.format_number("unit", 2),
        F.lit(" less "),
        s("rate"),
        F.lit(" % total ("),
        s("total"),
        F.lit(") EUR, 7d, (5"),
    )
    return lines.withColumn("printed", printed)


_KEYS = "k, l_linenumber, l_partkey, l_suppkey"
PRICED_SQL = """
WITH p AS (
  SELECT l_orderkey AS k, l_linenumber, l_partkey, l_suppkey,
    CAST(l_quantity AS BIGINT) AS qty, CAST(p_retailprice AS DECIMAL(18,2)) AS unit,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS total
  FROM lineitem JOIN part ON l_partkey = p_partkey
)
"""


@query(
    "money_tokens",
    PRICED_SQL
    + f"""SELECT {_KEYS}, CAST(qty AS VARCHAR) || '|US$' || format('{{:,.2f}}', CAST(unit AS DOUBLE))
    || '|(' || CAST(total AS VARCHAR) || ') EUR|(5' AS tokens FROM p""",
)
def _(spark, sf):
    tokens = F.transform(M.money_tokens(F.col("printed")), lambda t: F.trim(t))
    return _priced(spark, sf).select(
        *_KEYS.split(", "), F.array_join(tokens, "|").alias("tokens")
    )


@query(
    "decimal_values",
    PRICED_SQL
    + f"""SELECT {_KEYS}, CAST(qty AS DOUBLE) AS v1, CAST(unit AS DOUBLE) AS v2,
    CAST(-total AS DOUBLE) AS v3, CAST(3 AS BIGINT) AS n FROM p""",
)
def _(spark, sf):
    found = _priced(spark, sf).withColumn("v", M.decimal_values(F.col("printed")))
    return found.select(
        *_KEYS.split(", "),
        *[amount(F.get("v", F.lit(i)), f"v{i + 1}") for i in range(3)],
        F.size("v").cast("bigint").alias("n"),
    )


@query(
    "last_decimal",
    PRICED_SQL
    + f"""SELECT {_KEYS}, CAST(-total AS DOUBLE) AS last_decimal, true AS contains_amount,
    '(5' AS last_amount FROM p""",
)
def _(spark, sf):
    line = F.col("printed")
    return _priced(spark, sf).select(
        *_KEYS.split(", "),
        amount(M.last_decimal(line), "last_decimal"),
        M.contains_amount(line).alias("contains_amount"),
        F.trim(M.last_token(line)).alias("last_amount"),
    )


_FORMS = ("{}", "US$ {}", "{} eur", "({})", "-€{}", "({}", "none", "£{}%")


@query(
    "parse_decimal",
    PRICED_SQL
    + f"""SELECT {_KEYS}, CASE total % 8 WHEN 3 THEN '-' || CAST(total AS VARCHAR)
      WHEN 4 THEN '-' || CAST(total AS VARCHAR) WHEN 5 THEN 'error' WHEN 6 THEN 'error'
      ELSE CAST(total AS VARCHAR) END AS value FROM (SELECT * REPLACE (total AS total) FROM p)"""
    .replace("total % 8", "CAST(floor(total) AS BIGINT) % 8"),
)
def _(spark, sf):
    printed = F.format_number("total", 2)
    form = F.lit(None).cast("string")
    for i, shape in enumerate(_FORMS):
        before, _, after = shape.partition("{}")
        value = F.concat(F.lit(before), printed, F.lit(after)) if "{}" in shape else F.lit(shape)
        form = F.when(F.floor("total") % 8 == i, value).otherwise(form)
    value = M.parse_decimal(form).cast("decimal(18,2)").cast("string")
    return line_facts(spark, sf).select(
        *_KEYS.split(", "), F.coalesce(value, F.lit("error")).alias("value")
    )


@query(
    "is_quantity",
    """SELECT l_orderkey AS k, l_linenumber, l_partkey, l_suppkey,
    l_linenumber % 4 < 2 AS is_quantity FROM lineitem JOIN part ON l_partkey = p_partkey""",
)
def _(spark, sf):
    qty, turn = F.col("qty").cast("string"), F.col("l_linenumber") % 4
    printed = (
        F.when(turn == 0, qty)
        .when(turn == 1, F.concat(qty, F.lit(".50")))
        .when(turn == 2, F.concat(F.lit("$"), qty))
        .otherwise(F.concat(qty, F.lit(" pcs")))
    )
    return line_facts(spark, sf).select(
        *_KEYS.split(", "), M.is_quantity(printed).alias("is_quantity")
    )


# ---- labels in one line ----


def _labelled(spark, sf):
    return order_facts(spark, sf).withColumn(
        "line", F.concat(F.lit("Kunde / CUSTOMER #: "), "buyer", F.lit(" -"))
    )


@query(
    "english_side",
    f"WITH {FACTS} SELECT k, 'CUSTOMER #: ' || buyer || ' -' AS english, '/' AS cut FROM fe",
)
def _(spark, sf):
    return _labelled(spark, sf).select(
        "k", X.english_side(F.col("line")).alias("english"), F.lit("/").alias("cut")
    )


@query(
    "value_after_label",
    f"""WITH {FACTS} SELECT k, buyer AS value, '' AS absent, true AS has_customer,
    false AS has_vendor FROM fe""",
)
def _(spark, sf):
    line, low = F.col("line"), X.casefold(F.col("line"))
    return _labelled(spark, sf).select(
        "k",
        X.value_after_label(line, low, "Customer").alias("value"),
        X.value_after_label(line, low, "Vendor").alias("absent"),
        X.has_label(low, "Customer").alias("has_customer"),
        X.has_label(low, "Vendor").alias("has_vendor"),
    )


@query(
    "line_has_label",
    rf"""WITH {LINES_SQL} SELECT doc_id, line_no, contains(replace(lower(line), 'ß', 'ss'), 'the')
    AS has_label FROM lines""",
)
def _(spark, sf):
    return document_lines(table(spark, sf, "documents"), "doc_id").select(
        "doc_id",
        F.col("line_no").cast("bigint").alias("line_no"),
        X.has_label(X.casefold(F.col("line")), "The").alias("has_label"),
    )


@query(
    "is_separator",
    """SELECT o_orderkey AS k, o_orderkey % 3 = 0 AS is_separator, o_orderkey % 3 = 1 AS label_only
    FROM orders""",
)
def _(spark, sf):
    turn = F.col("k") % 3
    line = F.when(turn == 0, ": #-/").when(turn == 1, "BUYER").otherwise(F.col("buyer"))
    return order_facts(spark, sf).select(
        "k",
        X.is_separator(line).alias("is_separator"),
        X.is_label_only(line).alias("label_only"),
    )


@query(
    "looks_like_metadata",
    rf"""WITH {LINES_SQL} SELECT doc_id, line_no, regexp_matches(lower(line),
      'invoice|receipt|date|address|code|vat|pvm|total|amount|price|tax|page')
      OR contains(line, '@') OR regexp_matches(line, '[0-9]') AS metadata FROM lines""",
)
def _(spark, sf):
    # Any digit stands for an amount here: the amount pattern needs look-around, which
    # the checking engine lacks; the amount queries cover it.
    line = F.col("line")
    return document_lines(table(spark, sf, "documents"), "doc_id").select(
        "doc_id",
        F.col("line_no").cast("bigint").alias("line_no"),
        X.looks_like_metadata(X.casefold(line), line.rlike("[0-9]")).alias("metadata"),
    )


_ALL = ("eu", "us", "compact", "receipt")
lookup(
    "infer_currency",
    _ALL,
    lambda doc: {"currency": currency(doc)},
    "SELECT doc_key, "
    + by_kind(_ALL, eu="'EUR'", us="'USD'", compact="'EUR'", receipt="'USD'")
    + " AS currency FROM f",
)
lookup(
    "document_type",
    _ALL,
    lambda doc: {"document_type": document_type(doc)},
    "SELECT doc_key, "
    + by_kind(_ALL, eu="'invoice'", us="'invoice'", compact="'invoice'", receipt="'receipt'")
    + " AS document_type FROM f",
)



@query(
    "text_currency_and_type",
    rf"""WITH {LINES_SQL}, body AS (
      SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS body,
        string_agg(line, chr(10) ORDER BY line_no) FILTER (line_no < 5) AS head FROM lines GROUP BY doc_id)
    SELECT doc_id, CASE WHEN regexp_matches(body, '€|EUR') THEN 'EUR' WHEN regexp_matches(body, '\$|USD') THEN 'USD'
      WHEN regexp_matches(body, '£|GBP') THEN 'GBP' ELSE '' END AS currency,
      CASE WHEN contains(lower(head), 'receipt') THEN 'receipt' ELSE 'invoice' END AS document_type
    FROM documents LEFT JOIN body USING (doc_id)""",
)
def _(spark, sf):
    """Currency and type of texts that this package did not print."""
    docs, doc = with_doc_columns(table(spark, sf, "documents"), "text"), doc_columns()
    return docs.select("doc_id", currency(doc).alias("currency"), document_type(doc).alias("document_type"))


# ---- dates and numbers ----

_DATE_FORMATS = (
    "yyyy-M-d",
    "yyyy/MM/dd",
    "MMMM d, yyyy",
    "MMM dd, yyyy",
    "d MMMM yyyy",
    "dd MMM yyyy",
    "d-MMM-yyyy",
    "dd-MMMM-yyyy",
    "dd/MM/yyyy",
    "EEEE d MMMM",
)


@query(
    "to_iso_date",
    facts_sql(
        """SELECT k, CASE k % 10 WHEN 8 THEN strftime(d, '%d/%m/%Y')
        WHEN 9 THEN strftime(d, '%A %-d %B') ELSE strftime(d, '%Y-%m-%d') END AS iso FROM fe"""
    ),
)
def _(spark, sf):
    raw = F.lit(None).cast("string")
    for i, pattern in enumerate(_DATE_FORMATS):
        raw = F.when(F.col("k") % 10 == i, F.date_format("d", pattern)).otherwise(raw)
    return order_facts(spark, sf).withColumn("raw", raw).select(
        "k", to_iso_date(F.col("raw")).alias("iso")
    )


@query(
    "money_text",
    """SELECT l_orderkey AS k, l_linenumber, l_partkey, l_suppkey, CAST(CAST(round(
      CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))), 2)
      AS DECIMAL(18,2)) AS VARCHAR) AS net FROM lineitem""",
)
def _(spark, sf):
    net = F.col("l_extendedprice").cast("decimal(18,2)") * (
        1 - F.col("l_discount").cast("decimal(4,2)")
    )
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("k"),
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        M.money_text(net).alias("net"),
    )


@query(
    "plain_number",
    """SELECT l_orderkey AS k, l_linenumber, l_partkey, l_suppkey,
      CAST(CAST(l_quantity AS BIGINT) * 10 AS VARCHAR) AS quantity,
      rtrim(rtrim(CAST(CAST(l_discount AS DECIMAL(4,2)) AS VARCHAR), '0'), '.') AS percent
      FROM lineitem""",
)
def _(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("k"),
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        M.plain_number(F.col("l_quantity").cast("decimal(18,4)") * 10).alias("quantity"),
        M.plain_number(F.col("l_discount").cast("decimal(9,4)")).alias("percent"),
    )


@query(
    "tax_category",
    """SELECT l_orderkey AS k, l_linenumber, l_partkey, l_suppkey,
      CASE WHEN round(l_tax * 100) - 4 > 0 THEN 'S' ELSE 'Z' END AS category FROM lineitem""",
)
def _(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("k"),
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        tax_category(F.round(F.col("l_tax") * 100) - 4).alias("category"),
    )


@query(
    "ubl_type",
    """SELECT o_orderkey AS k,
      CASE o_orderstatus WHEN 'F' THEN 'CreditNote' ELSE 'Invoice' END AS root,
      CASE o_orderstatus WHEN 'F' THEN '381' ELSE '380' END AS type_code,
      CASE o_orderstatus WHEN 'F' THEN 'CreditNoteLine' ELSE 'InvoiceLine' END AS line,
      CASE o_orderstatus WHEN 'F' THEN 'CreditedQuantity' ELSE 'InvoicedQuantity' END AS quantity
      FROM orders""",
)
def _(spark, sf):
    status = F.col("o_orderstatus")
    kind = F.when(status == "F", "credit_note").when(status == "O", "receipt").otherwise("invoice")
    return (
        table(spark, sf, "orders")
        .select(F.col("o_orderkey").alias("k"), ubl_type(kind).alias("type"))
        .select("k", "type.*")
    )


@query(
    "party_name",
    facts_sql(
        """SELECT k, CASE WHEN k % 3 = 0 THEN 'Unknown supplier' ELSE seller END AS seller,
        CASE WHEN k % 3 = 1 THEN 'Unknown customer' ELSE buyer END AS buyer FROM fe"""
    ),
)
def _(spark, sf):
    turn = F.col("k") % 3
    return order_facts(spark, sf).select(
        "k",
        party_name(F.when(turn != 0, F.col("seller")), UNKNOWN_SUPPLIER).alias("seller"),
        party_name(F.when(turn == 1, "").otherwise(F.col("buyer")), UNKNOWN_CUSTOMER).alias(
            "buyer"
        ),
    )


# ---- object keys ----

# (key shape, output key, safe key); {} is the order key
_KEY_SHAPES = (
    ("{}.pdf", "{}.xml", "{}.pdf"),
    ("in/{}.tar.gz", "in/{}.tar.xml", "in/{}.tar.gz"),
    ("a//./{}.PDF", "a/{}.xml", "a/{}.PDF"),
    ("plain{}", "plain{}.xml", "plain{}"),
    ("dir.v1/{}", "dir.v1/{}.xml", "dir.v1/{}"),
    (".hidden{}", ".hidden{}.xml", ".hidden{}"),
    ("x{}.", "x{}..xml", "x{}."),
    ("/../up/{}.pdf", "/../up/{}.xml", "up/{}.pdf"),
    ("../.", "../..xml", "invoice.pdf"),
)


def _shaped(index: int) -> str:
    branches = []
    for i, shapes in enumerate(_KEY_SHAPES):
        before, mark, after = shapes[index].partition("{}")
        middle = " || CAST(k AS VARCHAR) || " if mark else " || "
        branches.append(f"WHEN {i} THEN '{before}'{middle}'{after}'")
    return f"CASE k % {len(_KEY_SHAPES)} {' '.join(branches)} END"


def _keyed(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"),
        F.expr(_shaped(0).replace("k ", "o_orderkey ").replace("AS VARCHAR", "AS STRING")).alias(
            "key"
        ),
    )


_K = "WITH o AS (SELECT o_orderkey AS k FROM orders) "


@query("output_key", _K + f"SELECT k, {_shaped(1)} AS output_key FROM o")
def _(spark, sf):
    return _keyed(spark, sf).select("k", K.output_key(F.col("key")).alias("output_key"))


@query("safe_key", _K + f"SELECT k, {_shaped(2)} AS safe_key FROM o")
def _(spark, sf):
    return _keyed(spark, sf).select("k", K.safe_key(F.col("key")).alias("safe_key"))


@query(
    "error_keys",
    _K + f"""SELECT k, 'failed/' || {_shaped(2)} AS error_key,
    'failed/' || {_shaped(2)} || '.error.json' AS report_key FROM o""",
)
def _(spark, sf):
    return _keyed(spark, sf).select(
        "k",
        K.error_key(F.col("key")).alias("error_key"),
        K.error_report_key(F.col("key")).alias("report_key"),
    )


@query(
    "error_report",
    """SELECT event_id, '{"input_bucket":"inv-input","input_object_key":"doc-' || user_id
    || '.pdf","error_type":"parse_error","message":"No \\"' || event_type
    || '\\"","policy":"Input object is left in place. A copy is archived in the error bucket'
    || ' when available."}' AS report FROM events""",
)
def _(spark, sf):
    key = F.concat(F.lit("doc-"), F.col("user_id").cast("string"), F.lit(".pdf"))
    message = F.concat(F.lit('No "'), "event_type", F.lit('"'))
    return table(spark, sf, "events").select(
        "event_id",
        K.error_report(F.lit(K.INPUT_BUCKET), key, F.lit("parse_error"), message).alias("report"),
    )


@query(
    "scanned_flag",
    "SELECT doc_id, length(trim(text)) < 200 AS scanned FROM documents",
)
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", is_scanned(F.col("text"), 200).alias("scanned")
    )
