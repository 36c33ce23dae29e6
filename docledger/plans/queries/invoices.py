"""VAT breakdown, totals, nesting and UBL XML."""

from __future__ import annotations

from pyspark.sql import functions as F

from docledger.operators import tax as T
from docledger.operators.extensions import broken_rules, needs_review
from docledger.operators.ubl import EN16931, PEPPOL_PROFILE, XRECHNUNG, to_ubl_xml
from docledger.plans.pipeline import (
    invoice_headers,
    invoice_lines,
    parse_documents,
    with_xml,
)
from docledger.plans.queries.base import amount, by_kind, facts_sql, query, text
from docledger.plans.queries.parse import (
    _COMPACT,
    _FALLBACK,
    _IN_STOCK,
    _LABELED,
    _row_sql,
    row_columns,
)
from docledger.plans.render import ALL, FIXED, GENERIC, line_facts, order_facts, render, table
from docledger.sources.ubl_xml import read_invoices

_BREAKDOWN = """CAST(taxable AS DOUBLE) AS taxable_amount,
  CAST(tax AS DOUBLE) AS tax_amount, CASE WHEN rate > 0 THEN 'S' ELSE 'Z' END AS category"""


def _tax_lines(spark, sf):
    """lineitem as invoice lines, in narrow decimals."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("k"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("line_total"),
        F.round(F.col("l_tax") * 100).cast("decimal(9,4)").alias("vat_rate"),
    )


def _breakdown(df, doc):
    return df.select(
        doc,
        F.col("vat_rate").cast("bigint").alias("rate"),
        amount(F.col("taxable_amount"), "taxable_amount"),
        amount(F.col("tax_amount"), "tax_amount"),
        "category",
    )


_LINE_SQL = """l AS (SELECT l_orderkey AS k, CAST(l_extendedprice AS DECIMAL(18,2)) AS total,
  CAST(round(l_tax * 100) AS BIGINT) AS rate FROM lineitem)"""


@query(
    "tax_breakdown",
    f"""WITH {_LINE_SQL} SELECT k, rate, {_BREAKDOWN} FROM (SELECT k, rate, sum(total) AS taxable,
    round(sum(total * rate), 0) * 0.01 AS tax FROM l GROUP BY k, rate)""",
)
def _(spark, sf):
    return _breakdown(T.tax_breakdown(_tax_lines(spark, sf), "k"), "k")


# Rows of all layouts as (doc_key, rate, total): what the parser should have found.
_ALL_ROWS = f"""a AS (
  SELECT doc_key, {by_kind(
    ALL, eu="rate", us="8", sku="rate", credit="rate", compact="rate", stacked="0",
    receipt="NULL", bilingual="NULL")} AS rate,
    CASE WHEN k % 8 = 3 THEN -total ELSE total END AS total
  FROM f JOIN r USING (k) WHERE k % 8 < 6
  UNION ALL SELECT doc_key, 0, price FROM f WHERE k % 8 = 6
  UNION ALL SELECT doc_key, 0, adjustment FROM f WHERE k % 8 = 6
  UNION ALL SELECT doc_key, 21, sub FROM f WHERE k % 8 = 7
)"""


@query(
    "parsed_tax_breakdown",
    facts_sql(
        f""", {_ALL_ROWS} SELECT doc_key, CAST(rate AS BIGINT) AS rate, {_BREAKDOWN}
    FROM (SELECT doc_key, rate, sum(total) AS taxable,
      round(sum(total * rate), 0) * 0.01 AS tax FROM a GROUP BY doc_key, rate)"""
    ),
)
def _(spark, sf):
    lines = invoice_lines(parse_documents(render(spark, sf, *ALL)), "doc_key")
    return _breakdown(T.tax_breakdown(lines, "doc_key"), "doc_key")


def _declared(spark, sf):
    """Orders declaring no tax, a wrong tax, or none of both, with totals that may not add up."""
    zero = F.lit(0).cast("decimal(18,2)")
    return order_facts(spark, sf).select(
        "k",
        F.when(F.col("k") % 2 == 0, zero)
        .otherwise((F.col("price") * F.lit("0.10").cast("decimal(3,2)")).cast("decimal(18,2)"))
        .alias("tax"),
        F.col("price").alias("subtotal"),
        F.when(F.col("k") % 3 == 0, F.col("price"))
        .otherwise(F.col("price") + 1)
        .cast("decimal(18,2)")
        .alias("total"),
    )


_DECLARED_SQL = f"""WITH {_LINE_SQL}, t AS (
  SELECT k, round(sum(total * rate), 0) * 0.01 AS line_tax FROM l GROUP BY k
), o AS (
  SELECT o_orderkey AS k, CAST(o_totalprice AS DECIMAL(18,2)) AS price,
    CASE WHEN o_orderkey % 2 = 0 THEN 0
      ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 0.10 AS DECIMAL(18,2)) END AS tax
  FROM orders
), j AS (SELECT o.*, coalesce(line_tax, 0) AS line_tax FROM o LEFT JOIN t USING (k))"""


@query(
    "document_tax",
    _DECLARED_SQL
    + " SELECT k, CAST(CASE WHEN tax <> 0 THEN tax ELSE line_tax END AS DOUBLE) AS tax_amount FROM j",
)
def _(spark, sf):
    taxes = T.document_tax(_declared(spark, sf), _tax_lines(spark, sf), "k", "tax")
    return taxes.select("k", amount(F.col("tax_amount"), "tax_amount"))


@query(
    "declared_balance",
    _DECLARED_SQL
    + """ SELECT k, tax = line_tax AS tax_matches,
    price + tax = CASE WHEN k % 3 = 0 THEN price ELSE price + 1 END AS total_matches FROM j""",
)
def _(spark, sf):
    return T.declared_balance(_declared(spark, sf), _tax_lines(spark, sf), "k")


@query(
    "monetary_totals",
    facts_sql(
        """SELECT doc_key, CAST(sub AS DOUBLE) AS line_extension_amount,
        CAST(sub AS DOUBLE) AS tax_exclusive_amount, CAST(gross AS DOUBLE) AS tax_inclusive_amount,
        CAST(gross AS DOUBLE) AS payable_amount FROM f"""
    ),
)
def _(spark, sf):
    totals = parse_documents(render(spark, sf, "eu")).select(
        "doc_key", F.inline(F.array(T.monetary_totals(F.col("invoice"))))
    )
    return totals.select("doc_key", *[amount(F.col(c), c) for c in totals.columns[1:]])


_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax"]


@query(
    "number_lines",
    facts_sql(
        "SELECT k, idx + 1 AS line_id, description, CAST(total AS DOUBLE) AS line_total FROM r"
    ),
)
def _(spark, sf):
    numbered = T.number_lines(line_facts(spark, sf), "k", _ORDER)
    return numbered.select(
        "k",
        F.col("line_id").cast("bigint").alias("line_id"),
        "description",
        amount(F.col("total"), "line_total"),
    )


@query(
    "line_count",
    "SELECT l_orderkey AS k, count(*) AS line_count FROM lineitem GROUP BY l_orderkey",
)
def _(spark, sf):
    return T.line_count(_tax_lines(spark, sf), "k")


@query(
    "nest_invoice",
    facts_sql(
        """SELECT k, buyer, n, x.names FROM fe LEFT JOIN (SELECT k, string_agg(description, '|'
        ORDER BY idx) AS names FROM r GROUP BY k) x USING (k) WHERE n > 0
        UNION ALL SELECT k, buyer, 0, '' FROM fe WHERE n = 0"""
    ),
)
def _(spark, sf):
    lines = T.number_lines(line_facts(spark, sf), "k", _ORDER).select(
        "k", F.col("line_id").alias("line_idx"), "description", "qty", "unit", "total"
    )
    nested = T.nest_invoice(order_facts(spark, sf).select("k", "buyer"), lines, "k")
    return nested.select(
        "k",
        "buyer",
        F.coalesce(F.size("lines"), F.lit(0)).cast("bigint").alias("n"),
        text(F.array_join("lines.description", "|"), "names"),
    )


# ---- XML ----

_AMT = "'<cbc:{0} currencyID=\"EUR\">' || CAST({1} AS DECIMAL(18,2)) || '</cbc:{0}>'"
_CATEGORY = """'{p}<cac:{tag}>{p}  <cbc:ID>' || CASE WHEN rate > 0 THEN 'S' ELSE 'Z' END
  || '</cbc:ID>{p}  <cbc:Percent>' || rate || '</cbc:Percent>{p}  <cac:TaxScheme>{p}    '
  || '<cbc:ID>VAT</cbc:ID>{p}  </cac:TaxScheme>{p}</cac:{tag}>'"""


def _category(tag, pad):
    return _CATEGORY.replace("{p}", "\n" + " " * pad).replace("{tag}", tag)


def _party_sql(role, name, vat):
    return f"""'
  <cac:{role}>
    <cac:Party>
      <cac:PartyName>
        <cbc:Name>' || {name} || '</cbc:Name>
      </cac:PartyName>
      <cac:PartyTaxScheme>
        <cbc:CompanyID>' || {vat} || '</cbc:CompanyID>
        <cac:TaxScheme>
          <cbc:ID>VAT</cbc:ID>
        </cac:TaxScheme>
      </cac:PartyTaxScheme>
      <cac:PartyLegalEntity>
        <cbc:RegistrationName>' || {name} || '</cbc:RegistrationName>
      </cac:PartyLegalEntity>
    </cac:Party>
  </cac:{role}>'"""


def _monetary(*tags):
    return " || ".join(
        "'\n    ' || " + _AMT.format(tag, "sub" if i < 2 else "gross") for i, tag in enumerate(tags)
    )


XML_SQL = f"""
, g AS (
  SELECT k, string_agg('
    <cac:TaxSubtotal>
      ' || {_AMT.format("TaxableAmount", "taxable")} || '
      ' || {_AMT.format("TaxAmount", "rate_tax")} || {_category("TaxCategory", 6)} || '
    </cac:TaxSubtotal>', '' ORDER BY rate) AS subtotals
  FROM (SELECT k, rate, sum(total) AS taxable, round(sum(total * rate), 0) * 0.01 AS rate_tax
    FROM r GROUP BY k, rate) GROUP BY k
), x AS (
  SELECT k, string_agg('
  <cac:InvoiceLine>
    <cbc:ID>' || (idx + 1) || '</cbc:ID>
    <cbc:InvoicedQuantity unitCode="C62">' || qty || '</cbc:InvoicedQuantity>
    ' || {_AMT.format("LineExtensionAmount", "total")} || '
    <cac:Item>
      <cbc:Description>' || description || '</cbc:Description>
      <cbc:Name>' || description || '</cbc:Name>' || {_category("ClassifiedTaxCategory", 6)} || '
    </cac:Item>
    <cac:Price>
      ' || {_AMT.format("PriceAmount", "unit")} || '
    </cac:Price>
  </cac:InvoiceLine>', '' ORDER BY idx) AS invoice_lines FROM r GROUP BY k
)
SELECT doc_key, '<?xml version=''1.0'' encoding=''utf-8''?>
<Invoice xmlns="urn:oasis:names:specification:ubl:schema:xsd:Invoice-2"'
 || ' xmlns:cac="urn:oasis:names:specification:ubl:schema:xsd:CommonAggregateComponents-2"'
 || ' xmlns:cbc="urn:oasis:names:specification:ubl:schema:xsd:CommonBasicComponents-2">
  <cbc:CustomizationID>urn:cen.eu:en16931:2017</cbc:CustomizationID>
  <cbc:ID>INV-' || doc_key || '</cbc:ID>
  <cbc:IssueDate>' || strftime(d, '%Y-%m-%d') || '</cbc:IssueDate>
  <cbc:DueDate>' || strftime(due, '%Y-%m-%d') || '</cbc:DueDate>
  <cbc:InvoiceTypeCode>380</cbc:InvoiceTypeCode>
  <cbc:DocumentCurrencyCode>EUR</cbc:DocumentCurrencyCode>'
 || {_party_sql("AccountingSupplierParty", "'Blue River Software LTD'", "'LT100000000'")}
 || {_party_sql("AccountingCustomerParty", "buyer", "'C' || o_custkey")} || '
  <cac:TaxTotal>
    ' || {_AMT.format("TaxAmount", "tax")} || subtotals || '
  </cac:TaxTotal>
  <cac:LegalMonetaryTotal>' || {_monetary("LineExtensionAmount", "TaxExclusiveAmount",
    "TaxInclusiveAmount", "PayableAmount")} || '
  </cac:LegalMonetaryTotal>' || invoice_lines || '
</Invoice>' AS xml FROM f JOIN g USING (k) JOIN x USING (k)"""


@query("ubl_xml", facts_sql(XML_SQL))
def _(spark, sf):
    return with_xml(parse_documents(render(spark, sf, "eu"))).select("doc_key", "xml")


_ALL_LINES = " UNION ALL ".join(
    [
        _row_sql(where="k % 8 = 0"),
        _row_sql(rate="8", where="k % 8 = 1"),
        _row_sql(sku="sku", where="k % 8 = 2"),
        _row_sql(total="-total", where="k % 8 = 3"),
        _row_sql(description=_COMPACT, where="k % 8 = 4"),
        _row_sql(description=_IN_STOCK, rate="0", where="k % 8 = 5"),
        _LABELED.format(where="k % 8 = 6"),
        _FALLBACK.format(where="k % 8 = 7"),
    ]
)


@query("ubl_roundtrip", facts_sql(_ALL_LINES))
def _(spark, sf):
    xml = with_xml(parse_documents(render(spark, sf, *ALL))).select("doc_key", "xml")
    back = read_invoices(xml, "xml")
    return row_columns(invoice_lines(back, "doc_key"))


@query(
    "ubl_roundtrip_headers",
    facts_sql(
        f"""SELECT doc_key, {by_kind(
            FIXED, eu="'invoice'", us="'invoice'", sku="'invoice'", credit="'credit_note'")}
          AS document_type,
          CASE WHEN k % 4 = 3 THEN 'CN-' ELSE 'INV-' END || doc_key AS number,
          strftime(d, '%Y-%m-%d') AS date,
          CASE WHEN k % 4 = 3 THEN '' ELSE strftime(due, '%Y-%m-%d') END AS due_date,
          CASE WHEN k % 4 = 1 THEN 'USD' ELSE 'EUR' END AS currency,
          CASE WHEN k % 4 = 2 THEN 'Example Manufacturing GmbH' ELSE buyer END AS buyer,
          CASE WHEN k % 4 = 1 THEN '12-' || doc_key ELSE '' END AS seller_tax_id,
          CAST(CASE WHEN k % 4 = 3 THEN -gross ELSE gross END AS DOUBLE) AS total FROM f"""
    ),
)
def _(spark, sf):
    xml = with_xml(parse_documents(render(spark, sf, *FIXED))).select("doc_key", "xml")
    back = read_invoices(xml, "xml")
    return invoice_headers(back, "doc_key").select(
        "doc_key",
        "document_type",
        "number",
        "date",
        "due_date",
        "currency",
        F.col("buyer.name").alias("buyer"),
        text(F.col("seller.tax_id"), "seller_tax_id"),
        amount(F.col("total"), "total"),
    )


@query(
    "ubl_profiles",
    facts_sql(
        f"""SELECT doc_key, '{EN16931}' AS peppol_customization,
        '{PEPPOL_PROFILE}' AS peppol_profile, '{XRECHNUNG}' AS xrechnung_customization FROM f"""
    ),
)
def _(spark, sf):
    parsed = parse_documents(render(spark, sf, "eu"))
    invoice = F.col("invoice")
    tag = lambda c, name: F.regexp_extract(c, f"<cbc:{name}>([^<]*)<", 1)
    return parsed.select(
        "doc_key",
        to_ubl_xml(invoice, profile=PEPPOL_PROFILE).alias("peppol"),
        to_ubl_xml(invoice, customization=XRECHNUNG).alias("xrechnung"),
    ).select(
        "doc_key",
        tag(F.col("peppol"), "CustomizationID").alias("peppol_customization"),
        tag(F.col("peppol"), "ProfileID").alias("peppol_profile"),
        tag(F.col("xrechnung"), "CustomizationID").alias("xrechnung_customization"),
    )


# ---- review and rules ----


@query(
    "needs_review",
    facts_sql(
        """SELECT doc_key, CASE WHEN k % 8 < 4 THEN 'unbalanced' WHEN k % 8 = 6 AND
          price + adjustment + receipt_tax <> price THEN 'generic_layout|unbalanced'
          ELSE 'generic_layout' END AS reasons FROM f WHERE k % 8 > 3"""
    ),
)
def _(spark, sf):
    return needs_review(parse_documents(render(spark, sf, *ALL))).select(
        "doc_key", F.array_join("review_reasons", "|").alias("reasons")
    )


@query(
    "broken_rules",
    facts_sql(
        """SELECT doc_key, 'issue-date-iso' AS rule FROM f WHERE k % 4 <> 3
        UNION ALL SELECT doc_key, 'totals-add-up' FROM f
          WHERE k % 4 = 2 AND adjustment + receipt_tax <> 0"""
    ),
)
def _(spark, sf):
    return broken_rules(parse_documents(render(spark, sf, *GENERIC)), "doc_key")
