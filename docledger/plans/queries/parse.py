"""Label lookups, layouts and line items over rendered documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from docledger.functions.binding import position_of
from docledger.operators import items as I
from docledger.operators import lookups as L
from docledger.operators.jobs import classify_outcome
from docledger.plans.pipeline import invoice_headers, invoice_lines, parse_documents
from docledger.plans.queries.base import amount, by_kind, facts_sql, lookup, query, staged, text
from docledger.plans.render import ALL, FIXED, GENERIC, render

# ---- lookups ----

lookup(
    "value_after",
    ("eu",),
    lambda doc: {
        "number": L.value_after(doc, "Invoice no."),
        "absent": F.coalesce(L.value_after(doc, "No such label"), F.lit("missing")),
    },
    "SELECT doc_key, 'INV-' || doc_key AS number, 'missing' AS absent FROM f",
)
lookup(
    "amount_for_prefix",
    ("sku", "credit"),
    lambda doc: {
        "grand_total": F.coalesce(
            L.amount_for_prefix(doc, "Grand total"), L.amount_for_prefix(doc, "Total credit")
        ).cast("double")
    },
    """SELECT doc_key, CAST(CASE k % 2 WHEN 0 THEN gross ELSE -gross END AS DOUBLE) AS grand_total
    FROM f""",
)
lookup(
    "amount_after",
    ("eu",),
    lambda doc: {"total_due": L.amount_after(doc, "Total due").cast("double")},
    "SELECT doc_key, CAST(gross AS DOUBLE) AS total_due FROM f",
)
lookup(
    "inline_value",
    ("compact", "receipt"),
    lambda doc: {"number": L.inline_value(doc, L.NUMBER_LABELS)},
    "SELECT doc_key, CASE k % 2 WHEN 0 THEN 'INV-' ELSE '' END || doc_key AS number FROM f",
)
lookup(
    "section_value",
    ("bilingual", "stacked"),
    lambda doc: {
        "supplier": F.coalesce(L.section_value(doc, L.SELLER_LABELS), F.lit("")),
        "customer": L.section_value(doc, L.BUYER_LABELS),
    },
    """SELECT doc_key, CASE k % 2 WHEN 0 THEN seller ELSE '' END AS supplier,
    buyer AS customer FROM f""",
)
lookup(
    "inline_amount",
    ("receipt",),
    lambda doc: {
        "exam_price": L.inline_amount(doc, L.EXAM_PRICE_LABELS).cast("double"),
        "adjustment": L.inline_amount(doc, L.ADJUSTMENT_LABELS).cast("double"),
    },
    """SELECT doc_key, CAST(price AS DOUBLE) AS exam_price,
    CAST(adjustment AS DOUBLE) AS adjustment FROM f""",
)
lookup(
    "total",
    GENERIC,
    lambda doc: {"total": L.total(doc).cast("double")},
    "SELECT doc_key, CAST("
    + by_kind(GENERIC, compact="gross", stacked="sub", receipt="price", bilingual="gross")
    + " AS DOUBLE) AS total FROM f",
)
lookup(
    "subtotal_explicit",
    GENERIC,
    lambda doc: {"subtotal": F.coalesce(L.subtotal_explicit(doc).cast("double"), F.lit(-1.0))},
    "SELECT doc_key, CAST("
    + by_kind(GENERIC, compact="sub", stacked="-1", receipt="-1", bilingual="sub")
    + " AS DOUBLE) AS subtotal FROM f",
)
lookup(
    "nearest_previous_amount",
    ("stacked",),
    lambda doc: {
        "above_total": L.nearest_previous_amount(
            doc, position_of(doc.low, "total") - 1
        ).cast("double"),
        "above_quantity": F.coalesce(
            L.nearest_previous_amount(doc, position_of(doc.low, "quantity") - 1).cast("double"),
            F.lit(-1.0),
        ),
    },
    """SELECT doc_key, CAST(sub AS DOUBLE) AS above_total,
    CAST(sub AS DOUBLE) AS above_quantity FROM f""",
)
lookup(
    "last_amount_in_doc",
    GENERIC,
    lambda doc: {"amount": L.last_amount_in_doc(doc).cast("double")},
    "SELECT doc_key, CAST("
    + by_kind(GENERIC, compact="gross", stacked="sub", receipt="price", bilingual="gross")
    + " AS DOUBLE) AS amount FROM f",
)
SUBTOTAL = by_kind(
    GENERIC, compact="sub", stacked="sub", receipt="price + adjustment", bilingual="sub"
)
TAX = by_kind(GENERIC, compact="tax", stacked="0", receipt="receipt_tax", bilingual="tax")
TOTAL = by_kind(GENERIC, compact="gross", stacked="sub", receipt="price", bilingual="gross")
NUMBER = by_kind(
    GENERIC,
    compact="'INV-' || doc_key",
    stacked="doc_key",
    receipt="doc_key",
    bilingual="'HB-' || strftime(d, '%y') || '-' || lpad(doc_key, 9, '0')",
)
DATE = by_kind(
    GENERIC,
    compact="strftime(d, '%B %-d, %Y')",
    stacked="strftime(d, '%b %-d %Y')",
    receipt="strftime(d, '%-d %B %Y')",
    bilingual="strftime(d, '%Y-%m-%d')",
)
DUE = by_kind(
    GENERIC,
    compact="strftime(due, '%B %-d, %Y')",
    stacked="''",
    receipt="strftime(due, '%-d %B %Y')",
    bilingual="''",
)
lookup(
    "subtotal",
    GENERIC,
    lambda doc: {"subtotal": L.subtotal(doc, L.total(doc), L.tax(doc)).cast("double")},
    f"SELECT doc_key, CAST({SUBTOTAL} AS DOUBLE) AS subtotal FROM f",
)
lookup(
    "tax",
    GENERIC,
    lambda doc: {"tax": L.tax(doc).cast("double")},
    f"SELECT doc_key, CAST({TAX} AS DOUBLE) AS tax FROM f",
)
lookup(
    "tax_rate",
    GENERIC,
    lambda doc: {"rate": L.tax_rate(doc).cast("double")},
    "SELECT doc_key, CASE k % 4 WHEN 3 THEN 21.0::DOUBLE ELSE 0.0::DOUBLE END AS rate FROM f",
)
lookup(
    "document_number",
    GENERIC,
    lambda doc: {"number": L.document_number(doc)},
    f"SELECT doc_key, {NUMBER} AS number FROM f",
)
lookup(
    "document_date",
    GENERIC,
    lambda doc: {"date": L.document_date(doc)},
    f"SELECT doc_key, {DATE} AS date FROM f",
)
lookup(
    "due_date",
    GENERIC,
    lambda doc: {"due_date": L.due_date(doc)},
    f"SELECT doc_key, {DUE} AS due_date FROM f",
)
lookup(
    "seller",
    GENERIC,
    lambda doc: {"seller": L.seller(doc)},
    "SELECT doc_key, seller FROM f",
)
lookup(
    "buyer",
    GENERIC,
    lambda doc: {"buyer": L.buyer(doc)},
    "SELECT doc_key, buyer FROM f",
)
lookup(
    "first_index",
    ("stacked", "compact"),
    lambda doc: {"line_no": (L.first_index(doc, L.BILL_TO_LABELS) - 1).cast("bigint")},
    "SELECT doc_key, CAST(CASE k % 2 WHEN 0 THEN 3 ELSE 6 END AS BIGINT) AS line_no FROM f",
)
lookup(
    "description",
    GENERIC,
    lambda doc: {"description": F.coalesce(L.description(doc), F.lit(""))},
    "SELECT doc_key, "
    + by_kind(GENERIC, compact="''", stacked="'Item'", receipt="''", bilingual="'Berth service'")
    + " AS description FROM f",
)
lookup(
    "party_tax_ids",
    ("eu", "us"),
    lambda doc: {
        "seller_vat": F.coalesce(L.first_vat(doc), F.lit("")),
        "buyer_vat": F.coalesce(L.buyer_vat(doc), F.lit("")),
        "tax_id": F.coalesce(L.tax_id(doc), F.lit("")),
    },
    """SELECT doc_key, CASE k % 2 WHEN 0 THEN 'LT100000000' ELSE '' END AS seller_vat,
    CASE k % 2 WHEN 0 THEN 'C' || o_custkey ELSE '' END AS buyer_vat,
    CASE k % 2 WHEN 1 THEN '12-' || doc_key ELSE '' END AS tax_id FROM f""",
)

# ---- layouts ----


@query(
    "route_layout",
    facts_sql(
        "SELECT doc_key, "
        + by_kind(ALL, **{kind: f"'{kind if kind in FIXED else 'generic'}'" for kind in ALL})
        + " AS layout FROM f"
    ),
)
def _(spark, sf):
    return staged(spark, sf, *ALL)[0].select("doc_key", "layout")


def _headers(parsed):
    return invoice_headers(parsed, "doc_key").select(
        "doc_key",
        "document_type",
        "number",
        "date",
        "due_date",
        "currency",
        F.col("seller.name").alias("seller"),
        text(F.col("seller.vat"), "seller_vat"),
        text(F.col("seller.tax_id"), "seller_tax_id"),
        F.col("buyer.name").alias("buyer"),
        text(F.col("buyer.vat"), "buyer_vat"),
        amount(F.col("subtotal"), "subtotal"),
        amount(F.col("tax"), "tax"),
        amount(F.col("total"), "total"),
    )


def _header_query(name: str, kinds: tuple[str, ...], **columns: str) -> None:
    defaults = {
        "document_type": "'invoice'",
        "due_date": "''",
        "currency": "'EUR'",
        "seller_vat": "''",
        "seller_tax_id": "''",
        "buyer": "buyer",
        "buyer_vat": "''",
    } | columns
    numbers = {"subtotal", "tax", "total"}
    select = ", ".join(
        f"CAST({sql} AS DOUBLE) AS {column}" if column in numbers else f"{sql} AS {column}"
        for column, sql in defaults.items()
    )

    @query(name, facts_sql(f"SELECT doc_key, {select} FROM f"))
    def _(spark, sf):
        return _headers(parse_documents(render(spark, sf, *kinds)))


_header_query(
    "header_sku",
    ("sku",),
    number="'INV-' || doc_key",
    date="strftime(d, '%Y-%m-%d')",
    due_date="strftime(due, '%Y-%m-%d')",
    seller="'Global Components Test BV'",
    seller_vat="'NL000000000B01'",
    buyer="'Example Manufacturing GmbH'",
    buyer_vat="'DE000000000'",
    subtotal="sub",
    tax="tax",
    total="gross",
)
_header_query(
    "header_credit",
    ("credit",),
    document_type="'credit_note'",
    number="'CN-' || doc_key",
    date="strftime(d, '%d-%b-%Y')",
    seller="'Blue River Software LTD'",
    seller_vat="'LT100000000'",
    subtotal="-sub",
    tax="-tax",
    total="-gross",
)
_header_query(
    "header_eu",
    ("eu",),
    number="'INV-' || doc_key",
    date="strftime(d, '%Y-%m-%d')",
    due_date="strftime(due, '%Y-%m-%d')",
    seller="'Blue River Software LTD'",
    seller_vat="'LT100000000'",
    buyer_vat="'C' || o_custkey",
    subtotal="sub",
    tax="tax",
    total="gross",
)
_header_query(
    "header_us",
    ("us",),
    number="'INV-' || doc_key",
    date="strftime(d, '%b %-d, %Y')",
    due_date="strftime(due, '%b %-d, %Y')",
    currency="'USD'",
    seller="'North Star Office Supplies'",
    seller_tax_id="'12-' || doc_key",
    subtotal="sub",
    tax="tax",
    total="gross",
)
_header_query(
    "header_generic",
    GENERIC,
    document_type=by_kind(
        GENERIC, compact="'invoice'", stacked="'invoice'", receipt="'receipt'", bilingual="'invoice'"
    ),
    number=NUMBER,
    date=DATE,
    due_date=DUE,
    currency=by_kind(
        GENERIC, compact="'EUR'", stacked="'USD'", receipt="'USD'", bilingual="'EUR'"
    ),
    seller="seller",
    subtotal=SUBTOTAL,
    tax=TAX,
    total=TOTAL,
)

# ---- line items ----

_ROW = """doc_key, CAST(idx AS BIGINT) AS line_idx, {sku} AS sku, {description} AS description,
  CAST(qty AS DOUBLE) AS quantity, CAST(unit AS DOUBLE) AS unit_price,
  CAST({rate} AS DOUBLE) AS vat_rate, CAST({total} AS DOUBLE) AS line_total"""


def _row_sql(sku="''", description="description", rate="rate", total="total", where="true"):
    row = _ROW.format(sku=sku, description=description, rate=rate, total=total)
    return f"SELECT {row} FROM f JOIN r USING (k) WHERE {where}"


def row_columns(lines):
    return lines.select(
        "doc_key",
        F.col("line_idx").cast("bigint").alias("line_idx"),
        text(F.col("sku"), "sku"),
        "description",
        *[
            amount(F.col(name), name)
            for name in ("quantity", "unit_price", "vat_rate", "line_total")
        ],
    )


def _row_query(name: str, kinds: tuple[str, ...], rows, sql: str) -> None:
    """Rows as one item builder gives them, without the rest of the document."""

    @query(name, facts_sql(sql))
    def _(spark, sf):
        docs, doc = staged(spark, sf, *kinds)
        built = docs.select("doc_key", F.posexplode(rows(doc)).alias("line_idx", "row"))
        return row_columns(built.select("doc_key", "line_idx", "row.*"))


_IN_STOCK = "description || ' - in stock'"
_COMPACT = f"CASE WHEN idx % 2 = 0 THEN description ELSE {_IN_STOCK} END"
_LABELED = """SELECT doc_key, 0::BIGINT AS line_idx, '' AS sku,
  'Practical Assessment' AS description,
  1.0::DOUBLE AS quantity, CAST(price AS DOUBLE) AS unit_price, 0.0::DOUBLE AS vat_rate,
  CAST(price AS DOUBLE) AS line_total FROM f WHERE {where}
  UNION ALL SELECT doc_key, 1, '', CASE WHEN adjustment < 0 THEN 'Promotion Amount'
  ELSE 'Adjustment' END, 1.0, CAST(adjustment AS DOUBLE), 0.0, CAST(adjustment AS DOUBLE)
  FROM f WHERE {where}"""
_FALLBACK = """SELECT doc_key, 0::BIGINT AS line_idx, '' AS sku, 'Berth service' AS description,
  1.0::DOUBLE AS quantity, CAST(sub AS DOUBLE) AS unit_price, 21.0::DOUBLE AS vat_rate,
  CAST(sub AS DOUBLE) AS line_total FROM f WHERE {where}"""

_row_query(
    "stride_table",
    ("eu",),
    lambda doc: I.stride_table(doc, "Line total", "Subtotal", 5)["rows"],
    _row_sql(),
)
_row_query(
    "stride_table_fixed_rate",
    ("us",),
    lambda doc: I.stride_table(doc, "Amount", "Subtotal", 4)["rows"],
    _row_sql(rate="8"),
)
_row_query("sku_rows", ("sku",), lambda doc: I.sku_rows(doc)["rows"], _row_sql(sku="sku"))
_row_query(
    "credit_rows", ("credit",), lambda doc: I.credit_rows(doc)["rows"], _row_sql(total="-total")
)
_row_query("compact_table", ("compact",), I.compact_table, _row_sql(description=_COMPACT))
_row_query(
    "stacked_table", ("stacked",), I.stacked_table, _row_sql(description=_IN_STOCK, rate="0")
)
_row_query(
    "labeled_amount_rows", ("receipt",), I.labeled_amount_rows, _LABELED.format(where="true")
)
_row_query(
    "fallback_row",
    ("bilingual",),
    lambda doc: I.fallback_row(doc, L.subtotal_explicit(doc), L.tax_rate(doc)),
    _FALLBACK.format(where="true"),
)


@query(
    "generic_rows",
    facts_sql(
        " UNION ALL ".join(
            [
                _row_sql(description=_COMPACT, where="k % 4 = 0"),
                _row_sql(description=_IN_STOCK, rate="0", where="k % 4 = 1"),
                _LABELED.format(where="k % 4 = 2"),
                _FALLBACK.format(where="k % 4 = 3"),
            ]
        )
    ),
)
def _(spark, sf):
    return row_columns(invoice_lines(parse_documents(render(spark, sf, *GENERIC)), "doc_key"))


@query(
    "fixed_rows",
    facts_sql(
        " UNION ALL ".join(
            [
                _row_sql(where="k % 4 = 0"),
                _row_sql(rate="8", where="k % 4 = 1"),
                _row_sql(sku="sku", where="k % 4 = 2"),
                _row_sql(total="-total", where="k % 4 = 3"),
            ]
        )
    ),
)
def _(spark, sf):
    return row_columns(invoice_lines(parse_documents(render(spark, sf, *FIXED)), "doc_key"))


_EMPTY = by_kind(
    FIXED,
    eu="'No invoice table lines found'",
    us="'No invoice table lines found'",
    sku="'No SKU invoice lines found'",
    credit="'No credit note lines found'",
)


@query(
    "fail_if_empty",
    facts_sql(
        f"""SELECT doc_key, n > 0 AS parsed, CASE WHEN n > 0 THEN '' ELSE 'parse_error' END
        AS error_type, CASE WHEN n > 0 THEN '' ELSE {_EMPTY} END AS error_message FROM fe"""
    ),
)
def _(spark, sf):
    return parse_documents(render(spark, sf, *FIXED, with_empty=True)).select(
        "doc_key",
        F.col("invoice").isNotNull().alias("parsed"),
        text(F.col("error_type"), "error_type"),
        text(F.col("error_message"), "error_message"),
    )


BREAKAGES = (
    ("nothing", "nothing"),
    ("Bill To", "Ship To"),
    ("Total due", "Total payable"),
    ("Line total", "Line sum"),
    ("Subtotal\n", "Subtotal\n("),
    ("\n€", "\n(€"),
)


def broken_documents(spark, sf):
    """EU documents, five in six of them damaged in one way."""
    docs = render(spark, sf, "eu")
    damaged = F.col("text")
    for i, (before, after) in enumerate(BREAKAGES):
        damaged = F.when(
            F.col("k") % 6 == i, F.replace("text", F.lit(before), F.lit(after))
        ).otherwise(damaged)
    return docs.withColumn("text", damaged)


ERROR_SQL = """
CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN '''Bill To'' is not in list'
  WHEN 2 THEN 'Missing amount after ''Total due''' WHEN 3 THEN 'Missing table boundary'
  WHEN 4 THEN 'Missing amount after ''Subtotal'''
  ELSE 'Could not parse decimal value ''(€' || CAST(unit AS VARCHAR) || '''' END
"""
STATUS_SQL = "CASE k % 6 WHEN 0 THEN 'SUCCESS' WHEN 1 THEN 'ERROR' ELSE 'PARSE_ERROR' END"
TYPE_SQL = "CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN 'processing_error' ELSE 'parse_error' END"


@query(
    "classify_outcome",
    facts_sql(
        f"""SELECT doc_key, {STATUS_SQL} AS status, {TYPE_SQL} AS error_type,
        {ERROR_SQL} AS error_message FROM f JOIN r USING (k) WHERE idx = 0"""
    ),
)
def _(spark, sf):
    return parse_documents(broken_documents(spark, sf)).select(
        "doc_key",
        classify_outcome(F.col("error_type")).alias("status"),
        text(F.col("error_type"), "error_type"),
        text(F.col("error_message"), "error_message"),
    )
