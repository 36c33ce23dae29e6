"""Layout routing and the header template of each layout."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.functions.binding import first_match, let, position_of
from docledger.functions.text import casefold, clean_line_array
from docledger.operators import items as I
from docledger.operators import lookups as L
from docledger.operators.lookups import Doc
from docledger.schemas import AMOUNT

# ---- fixed values: layout markers and parties of the fixed layouts ----
CREDIT_MARK = "CREDIT NOTE"
SKU_MARK = "GLOBAL COMPONENTS TEST INVOICE"
EU_MARK = "BLUE RIVER SOFTWARE LTD"
US_MARK = "North Star Office Supplies"
SKU_SELLER = ("Global Components Test BV", "NL000000000B01")
SKU_BUYER = ("Example Manufacturing GmbH", "DE000000000")
CREDIT_SELLER = ("Blue River Software LTD", "LT100000000")
EU_SELLER = "Blue River Software LTD"
SKU_HEADER_LINE = r"(?md)^Invoice (?=[^\n]*- Date )(?:- Date |[^\n]* - Date )[^\n]*"
SKU_HEADER = (
    r"Invoice\s+(.+?)\s+- Date\s+(\d{4}-\d{2}-\d{2})\s+- Due\s+(\d{4}-\d{2}-\d{2})"
)
# -----------------------------------------------------------------------

PARSE = "parse_error"
PROCESSING = "processing_error"

Check = tuple[Column, str, Column]  # (fails, error type, message)


def _party(name: Column, vat: Column | None = None, tax_id: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        name.alias("name"),
        (none if vat is None else vat).alias("vat"),
        (none if tax_id is None else tax_id).alias("tax_id"),
    )


def _invoice(
    document_type, number, date, due_date, currency, seller, buyer, rows, subtotal, tax, total
) -> Column:
    return F.struct(
        document_type.alias("document_type"),
        number.alias("number"),
        date.alias("date"),
        due_date.alias("due_date"),
        currency.alias("currency"),
        seller.alias("seller"),
        buyer.alias("buyer"),
        I.finished(rows).alias("lines"),
        F.struct(
            subtotal.cast(AMOUNT).alias("subtotal"),
            tax.cast(AMOUNT).alias("tax"),
            total.cast(AMOUNT).alias("total"),
        ).alias("totals"),
    )


def _outcome(invoice: Column, checks: list[Check]) -> Column:
    """struct<invoice, error_type, error_message>; the first failing check wins."""
    none = F.lit(None).cast("string")
    error = F.coalesce(
        *[
            F.when(
                fails, F.struct(F.lit(kind).alias("error_type"), text.alias("error_message"))
            )
            for fails, kind, text in checks
        ]
    )
    return let(
        F.coalesce(error, F.struct(none.alias("error_type"), none.alias("error_message"))),
        lambda e: F.struct(
            F.when(e["error_type"].isNull(), invoice).alias("invoice"),
            e["error_type"].alias("error_type"),
            e["error_message"].alias("error_message"),
        ),
    )


def _missing_value(value: Column, label: str) -> Check:
    return value.isNull(), PARSE, F.lit(f"Missing value after '{label}'")


def _missing_amount_after(value: Column, label: str) -> Check:
    return value.isNull(), PARSE, F.lit(f"Missing amount after '{label}'")


def _bad_prefix_amount(amount: Column, doc: Doc, prefix: str) -> Check:
    text = L.text_for_prefix(doc, prefix)
    message = F.when(text.isNull(), F.lit(f"Missing amount for '{prefix}'")).otherwise(
        I.unreadable(text)
    )
    return amount.isNull(), PARSE, message


def _rows_error(table: Column) -> Check:
    return table["error"].isNotNull(), PARSE, table["error"]


def _bound(build: Callable[[Column], Column], **fields: Column) -> Column:
    """Work out header fields once; both the invoice and its checks use them."""
    return let(F.struct(*[column.alias(name) for name, column in fields.items()]), build)


def sku_header_line(doc: Doc) -> Column:
    return first_match(doc.body, SKU_HEADER_LINE)


def header_sku(doc: Doc) -> Column:
    amounts = {"subtotal": "Subtotal", "tax": "VAT", "total": "Grand total"}

    def build(v: Column) -> Column:
        group = lambda k: F.regexp_extract(v["line"], SKU_HEADER, k)
        invoice = _invoice(
            F.lit("invoice"),
            group(1),
            group(2),
            group(3),
            F.lit("EUR"),
            _party(F.lit(SKU_SELLER[0]), F.lit(SKU_SELLER[1])),
            _party(F.lit(SKU_BUYER[0]), F.lit(SKU_BUYER[1])),
            v["table"]["rows"],
            *[v[name] for name in amounts],
        )
        return _outcome(
            invoice,
            [
                (v["line"].isNull(), PARSE, F.lit("Missing global components invoice header")),
                (
                    ~v["line"].rlike(SKU_HEADER),
                    PARSE,
                    F.lit("Could not parse global components invoice header"),
                ),
                _rows_error(v["table"]),
                *[_bad_prefix_amount(v[name], doc, label) for name, label in amounts.items()],
            ],
        )

    return _bound(
        build,
        line=sku_header_line(doc),
        table=I.sku_rows(doc),
        **{name: L.amount_for_prefix(doc, label) for name, label in amounts.items()},
    )


def header_credit(doc: Doc) -> Column:
    amounts = {"subtotal": "Subtotal credit", "tax": "VAT credit", "total": "Total credit"}
    values = {"number": "Credit note no.", "date": "Date", "customer": "Customer"}

    def build(v: Column) -> Column:
        invoice = _invoice(
            F.lit("credit_note"),
            v["number"],
            v["date"],
            F.lit(""),
            F.lit("EUR"),
            _party(F.lit(CREDIT_SELLER[0]), F.lit(CREDIT_SELLER[1])),
            _party(v["customer"]),
            v["table"]["rows"],
            *[v[name] for name in amounts],
        )
        return _outcome(
            invoice,
            [
                *[_missing_value(v[name], label) for name, label in values.items()],
                _rows_error(v["table"]),
                *[_bad_prefix_amount(v[name], doc, label) for name, label in amounts.items()],
            ],
        )

    return _bound(
        build,
        table=I.credit_rows(doc),
        **{name: L.value_after(doc, label) for name, label in values.items()},
        **{name: L.amount_for_prefix(doc, label) for name, label in amounts.items()},
    )


def _bill_to_checks(doc: Doc, at: Column) -> tuple[Check, Check]:
    """A missing buyer block is a processing error, unlike other missing labels."""
    return (
        (at.isNull(), PROCESSING, F.lit("'Bill To' is not in list")),
        (at >= F.size(doc.lines), PROCESSING, F.lit("list index out of range")),
    )


def header_eu(doc: Doc) -> Column:
    values = {
        "number": "Invoice no.",
        "date": "Invoice date",
        "due": "Due date",
        "currency": "Currency",
    }
    amounts = {"subtotal": "Subtotal", "tax": "VAT", "total": "Total due"}

    def build(v: Column) -> Column:
        no_buyer, no_buyer_name = _bill_to_checks(doc, v["bill_to"])
        invoice = _invoice(
            F.lit("invoice"),
            *[v[name] for name in values],
            _party(F.lit(EU_SELLER), L.first_vat(doc)),
            _party(F.get(doc.lines, v["bill_to"]), L.buyer_vat(doc)),
            v["table"]["rows"],
            *[v[name] for name in amounts],
        )
        return _outcome(
            invoice,
            [
                no_buyer,
                *[_missing_value(v[name], label) for name, label in values.items()],
                no_buyer_name,
                _rows_error(v["table"]),
                *[_missing_amount_after(v[name], label) for name, label in amounts.items()],
            ],
        )

    return _bound(
        build,
        bill_to=position_of(doc.lines, "Bill To"),
        table=I.stride_table(doc, "Line total", "Subtotal", 5),
        **{name: L.value_after(doc, label) for name, label in values.items()},
        **{name: L.amount_after(doc, label) for name, label in amounts.items()},
    )


def header_us(doc: Doc) -> Column:
    values = {"number": "Invoice #", "date": "Date", "due": "Due"}
    amounts = {"subtotal": "Subtotal", "tax": "Sales tax", "total": "Balance due"}

    def build(v: Column) -> Column:
        no_buyer, no_buyer_name = _bill_to_checks(doc, v["bill_to"])
        invoice = _invoice(
            F.lit("invoice"),
            *[v[name] for name in values],
            F.lit("USD"),
            _party(F.lit(US_MARK), None, L.tax_id(doc)),
            _party(F.get(doc.lines, v["bill_to"])),
            v["table"]["rows"],
            *[v[name] for name in amounts],
        )
        return _outcome(
            invoice,
            [
                no_buyer,
                *[_missing_value(v[name], label) for name, label in values.items()],
                no_buyer_name,
                _rows_error(v["table"]),
                *[_missing_amount_after(v[name], label) for name, label in amounts.items()],
            ],
        )

    return _bound(
        build,
        bill_to=position_of(doc.lines, "Bill To"),
        table=I.stride_table(doc, "Amount", "Subtotal", 4),
        **{name: L.value_after(doc, label) for name, label in values.items()},
        **{name: L.amount_after(doc, label) for name, label in amounts.items()},
    )


def header_generic(doc: Doc) -> Column:
    money = let(
        F.struct(L.total(doc).alias("total"), L.tax(doc).alias("tax")),
        lambda v: F.struct(
            v["total"].alias("total"),
            v["tax"].alias("tax"),
            L.subtotal(doc, v["total"], v["tax"]).alias("subtotal"),
        ),
    )

    def build(v: Column) -> Column:
        m, rows = v["money"], v["rows"]
        invoice = _invoice(
            L.document_type(doc),
            L.document_number(doc),
            L.document_date(doc),
            L.due_date(doc),
            L.currency(doc),
            _party(L.seller(doc)),
            _party(L.buyer(doc)),
            rows,
            m["subtotal"],
            m["tax"],
            m["total"],
        )
        row_error = I.first_row_error(rows)
        return _outcome(
            invoice,
            [
                (m["total"].isNull(), PARSE, F.lit("No monetary amounts found")),
                (row_error.isNotNull(), PARSE, row_error),
            ],
        )

    return let(
        money,
        lambda m: let(
            F.struct(
                m.alias("money"),
                F.when(
                    m["total"].isNotNull(), I.generic_rows(doc, m["subtotal"], L.tax_rate(doc))
                ).alias("rows"),
            ),
            build,
        ),
    )


class Layout(NamedTuple):
    name: str
    mark: str | None  # case-sensitive text that selects the layout
    build: Callable[[Doc], Column]


# In matching order; the last one takes what is left.
LAYOUTS = (
    Layout("credit", CREDIT_MARK, header_credit),
    Layout("sku", SKU_MARK, header_sku),
    Layout("eu", EU_MARK, header_eu),
    Layout("us", US_MARK, header_us),
    Layout("generic", None, header_generic),
)


def route_layout(body: Column) -> Column:
    """Name of the first layout whose mark occurs in the cleaned text."""
    name = F.lit(None).cast("string")
    for layout in reversed(LAYOUTS):
        if layout.mark is None:
            name = F.lit(layout.name)
        else:
            name = F.when(body.contains(layout.mark), layout.name).otherwise(name)
    return name


DOC_COLUMNS = ("_lines", "_body", "_folded", "_low", "_amounts")


def doc_columns() -> Doc:
    return Doc(*[F.col(c) for c in DOC_COLUMNS])


def with_doc_columns(docs: DataFrame, text: str = "text", every_layout: bool = False) -> DataFrame:
    """Add the cleaned forms of each document and its ``layout``.

    Folded lines and amounts are only worked out for the generic layout, the one that
    searches, unless ``every_layout`` asks for them.
    """
    generic = F.lit(True) if every_layout else F.col("layout") == "generic"
    d = doc_columns()
    empty = F.array().cast("array<string>")
    return (
        docs.withColumn("_lines", clean_line_array(F.coalesce(F.col(text), F.lit(""))))
        .withColumn("_body", F.array_join(d.lines, "\n"))
        .withColumn("layout", route_layout(d.body))
        .withColumn("_folded", F.when(generic, casefold(d.body)))
        .withColumns(
            {
                "_low": F.when(generic & (d.body != ""), F.split(d.folded, "\n")).otherwise(empty),
                "_amounts": F.when(generic, L.line_amounts(d.lines)),
            }
        )
    )
