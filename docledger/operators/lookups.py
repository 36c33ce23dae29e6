"""Label lookups inside one document.

A document arrives as one row, so every lookup is an expression over that row: no
shuffle, and the first hit ends the search. ``contains`` on the whole folded text
guards each label, so lines are only visited for labels that occur at all.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from docledger.functions import money as M
from docledger.functions import text as X
from docledger.functions.binding import (
    blank_to_null,
    first_match,
    first_present,
    last_present,
    let,
    position_of,
)
from docledger.schemas import AMOUNT

# ---- fixed values: labels, in priority order ----
TOTAL_LABELS = (
    "Amount due",
    "Balance due",
    "Total due",
    "Transaction Amount",
    "Amount paid",
    "Total incl. VAT",
    "Total incl VAT",
    "Total including VAT",
    "Total incl. tax",
    "Total including tax",
    "Grand total",
    "Total",
)
SUBTOTAL_LABELS = (
    "Subtotal",
    "Total excl. VAT",
    "Total excl VAT",
    "Total excluding VAT",
    "Total excluding tax",
    "Total excl. tax",
    "Net amount",
)
NUMBER_LABELS = (
    "Official Receipt / Tax Invoice #",
    "Receipt #",
    "Receipt number",
    "Invoice number",
    "Invoice no.",
    "Invoice no",
    "Invoice #",
    "Invoice ID",
)
TRANSACTION_LABELS = ("Transaction Confirmation #",)
DATE_LABELS = ("Transaction Date", "Date of issue", "Invoice date", "Date issued", "Date")
DUE_LABELS = ("Date due", "Due date", "Payment due", "Scheduled Date", "Due")
SELLER_LABELS = ("Supplier", "Seller", "Vendor", "Merchant")
SPONSOR_LABELS = ("Prepared on Behalf of your Test Sponsor",)
BUYER_LABELS = ("Customer", "Buyer", "Client", "Bill to", "Billed to")
COMPANY_LABELS = ("Company Name",)
CANDIDATE_LABELS = ("Candidate Name",)
BILL_TO_LABELS = ("Bill to", "Billed to", "Customer")
EXAM_NAME_LABELS = ("Exam Name",)
EXAM_PRICE_LABELS = ("Exam Price",)
ADJUSTMENT_LABELS = ("Promotion Amount", "Discount", "Adjustment")
NOT_A_SELLER_PREFIXES = (
    "invoice",
    "official receipt",
    "receipt",
    "date",
    "due",
    "amount",
    "pay ",
    "page ",
)
TAX_WORDS = ("vat", "pvm", "sales tax", "tax")
NOT_TAX_WORDS = ("total incl", "including", "amount due")
DESCRIPTION_WORDS = ("service", "product", "item", "description", "paslauga")
RATE = r"(\d+(?:\.\d+)?)\s*%"
NUMBER_AFTER_WORD = (
    r"(?iu)(?:invoice|receipt|faktūra|faktura)\s*(?:#|no\.?|number|:)?\s*"
    r"([A-Z0-9][A-Z0-9_.-]*\d[A-Z0-9_.-]*)"
)
CODED_NUMBER = r"\b[A-Z]{2,}[-_]\d{2,}[-_]\d{3,}\b"
ISO_DATE = r"\b\d{4}-\d{2}-\d{2}\b"
NUMERIC_DATE = r"\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b"
MONTH_DATE = (
    r"(?i)\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4}\b"
)
HEAD_LINES = 20
# -------------------------------------------------


class Doc(NamedTuple):
    """Columns that describe one cleaned document."""

    lines: Column  # ordered lines
    body: Column  # lines joined by newline
    folded: Column  # body for case-insensitive tests
    low: Column  # folded, as lines
    amounts: Column  # last readable amount of each line


def line_amounts(lines: Column) -> Column:
    return F.transform(lines, M.last_decimal)


def plain_line(doc: Doc, i: Column) -> Column:
    """Line ``i`` (0-based) where it is neither separator nor metadata, else NULL."""
    line = F.get(doc.lines, i)
    skip = X.is_separator(line) | X.looks_like_metadata(
        F.get(doc.low, i), F.get(doc.amounts, i).isNotNull()
    )
    return F.when(~skip, line)


# ---- exact labels (fixed layouts) ----


def value_after(doc: Doc, label: str) -> Column:
    """Line that follows the first line equal to the label."""
    return F.get(doc.lines, position_of(doc.lines, label))


def amount_after(doc: Doc, label: str) -> Column:
    return M.parse_decimal(value_after(doc, label))


def text_for_prefix(doc: Doc, prefix: str) -> Column:
    """Rest of the first line that starts with ``prefix:``; NULL when there is none."""
    mark = f"\n{prefix}:"

    def rest(body: Column) -> Column:
        # Searches in the bytes; a pattern would try every character for the start of a line.
        own = F.substr(body, F.instr(body, mark) + F.lit(len(mark)))
        return F.when(body.contains(mark), F.substring_index(own, "\n", 1))

    return let(F.concat(F.lit("\n"), doc.body), rest)


def amount_for_prefix(doc: Doc, prefix: str) -> Column:
    return M.parse_decimal(text_for_prefix(doc, prefix))


def first_vat(doc: Doc) -> Column:
    return F.trim(text_for_prefix(doc, "VAT"))


def tax_id(doc: Doc) -> Column:
    return F.trim(text_for_prefix(doc, "Tax ID"))


def buyer_vat(doc: Doc) -> Column:
    """First ``VAT:`` line at or after "Bill To"."""
    start = position_of(doc.lines, "Bill To")
    tail = F.array_join(F.slice(doc.lines, start, F.size(doc.lines)), "\n")
    return F.trim(text_for_prefix(doc._replace(body=tail), "VAT"))


# ---- free labels (generic layout) ----


def _by_label(doc: Doc, labels: Sequence[str], find: Callable[[str], Column]) -> Column:
    """First label, in label order, for which ``find`` yields a value."""
    found = [F.when(X.has_label(doc.folded, label), find(label)) for label in labels]
    return F.coalesce(*found)


def inline_value(doc: Doc, labels: Sequence[str]) -> Column:
    """Value beside or below a label that starts a line; label order decides, then lines.

    A line equal to the label takes the next line unless that is only separators; a
    longer line takes its own rest.
    """

    def find(label: str) -> Column:
        pattern = (
            rf"(?imd)^\Q{label}\E"
            r"(?:\n([^\n]*[^ :#\-/\n][^\n]*)|([^\n]*[^ :\-#\n][^\n]*))"
        )
        below = blank_to_null(F.regexp_extract(doc.body, pattern, 1))
        beside = F.btrim(F.regexp_extract(doc.body, pattern, 2), F.lit(" :-#"))
        return F.coalesce(below, blank_to_null(beside))

    return _by_label(doc, labels, find)


def section_value(doc: Doc, labels: Sequence[str]) -> Column:
    """Value at the first line holding any label; line order decides, then labels.

    The rest of the line counts if it is a real value, else the first plain line
    among the next four.
    """

    def at(low_line: Column, i: Column) -> Column:
        def value(below: Column) -> Column:
            found = []
            for label in labels:
                beside = X.value_after_label(F.get(doc.lines, i), low_line, label)
                usable = F.coalesce(F.when(~X.is_label_only(beside), beside), below)
                found.append(F.when(X.has_label(low_line, label), usable))
            return F.coalesce(*found)

        below = F.coalesce(*[plain_line(doc, i + ahead) for ahead in range(1, 5)])
        return F.when(X.contains_any(low_line, low_labels), let(below, value))

    low_labels = [label.lower() for label in labels]
    return F.when(X.contains_any(doc.folded, low_labels), first_present(F.transform(doc.low, at)))


def inline_amount(doc: Doc, labels: Sequence[str]) -> Column:
    """Last amount of the first line that has the label and an amount."""

    def find(label: str) -> Column:
        return first_present(
            F.transform(
                doc.low, lambda x, i: F.when(X.has_label(x, label), F.get(doc.amounts, i))
            )
        )

    return _by_label(doc, labels, find)


def nearest_previous_amount(doc: Doc, i: Column) -> Column:
    """Closest amount among the eight lines above line ``i``."""
    start = F.greatest(i - 7, F.lit(1))
    return last_present(F.slice(doc.amounts, start, F.least(i, F.lit(8))))


def last_amount_in_doc(doc: Doc) -> Column:
    return last_present(doc.amounts)


def labelled_total(doc: Doc, labels: Sequence[str], nearby: bool) -> Column:
    """Amount for the first label that has one, lines searched bottom-up."""

    def find(label: str) -> Column:
        def at(low_line: Column, i: Column) -> Column:
            amount = F.get(doc.amounts, i)
            if nearby:
                amount = F.coalesce(amount, nearest_previous_amount(doc, i))
            return F.when(X.has_label(low_line, label), amount)

        return last_present(F.transform(doc.low, at))

    return _by_label(doc, labels, find)


def total(doc: Doc) -> Column:
    return F.coalesce(labelled_total(doc, TOTAL_LABELS, nearby=True), last_amount_in_doc(doc))


def subtotal_explicit(doc: Doc) -> Column:
    return labelled_total(doc, SUBTOTAL_LABELS, nearby=False)


def tax(doc: Doc) -> Column:
    """Amount of the last tax line that has one, else 0."""

    def at(low_line: Column, i: Column) -> Column:
        is_tax = X.contains_any(low_line, TAX_WORDS) & ~X.contains_any(low_line, NOT_TAX_WORDS)
        return F.when(is_tax, F.get(doc.amounts, i))

    found = F.when(
        X.contains_any(doc.folded, TAX_WORDS), last_present(F.transform(doc.low, at))
    )
    return F.coalesce(found, F.lit(0).cast(AMOUNT))


def tax_rate(doc: Doc) -> Column:
    """Percentage on the first tax line that shows one, else 0."""

    def at(low_line: Column, i: Column) -> Column:
        rate = blank_to_null(F.regexp_extract(F.get(doc.lines, i), RATE, 1))
        return F.when(X.contains_any(low_line, TAX_WORDS), rate)

    found = F.when(doc.folded.contains("%"), first_present(F.transform(doc.low, at)))
    return F.coalesce(found.try_cast(AMOUNT), F.lit(0).cast(AMOUNT))


def subtotal(doc: Doc, total_amount: Column, tax_amount: Column) -> Column:
    """Explicit subtotal, else price plus adjustment, else total minus tax."""
    zero = F.lit(0).cast(AMOUNT)
    price = inline_amount(doc, EXAM_PRICE_LABELS)
    adjustment = inline_amount(doc, ADJUSTMENT_LABELS)
    items = F.when(
        price.isNotNull() | adjustment.isNotNull(),
        F.coalesce(price, zero) + F.coalesce(adjustment, zero),
    )
    return F.coalesce(subtotal_explicit(doc), items, total_amount - tax_amount).cast(AMOUNT)


def document_number(doc: Doc) -> Column:
    """Labelled number, transaction number, title line, number near a word, coded number."""
    size = F.size(doc.lines)
    head = F.array_join(F.slice(doc.lines, 1, HEAD_LINES), "\n")

    def titled(line: Column, i: Column) -> Column:
        low_line = F.get(doc.low, i)
        below = F.btrim(F.get(doc.lines, i + 1), F.lit(" #:."))
        own = F.btrim(line, F.lit(" #:."))
        return F.when(
            low_line.isin("invoice", "receipt") & (i + 1 < size) & below.rlike(r"\d"), below
        ).when(line.startswith("#") & line.rlike(r"\d"), own)

    return F.coalesce(
        inline_value(doc, NUMBER_LABELS),
        inline_value(doc, TRANSACTION_LABELS),
        first_present(F.transform(F.slice(doc.lines, 1, HEAD_LINES), titled)),
        # \s must not cross a line end: lines hold no other white space than blanks.
        blank_to_null(
            F.btrim(
                F.regexp_extract(head, NUMBER_AFTER_WORD.replace(r"\s", " "), 1), F.lit(" .,:;")
            )
        ),
        first_match(head, CODED_NUMBER),
        F.lit("unknown"),
    )


def document_date(doc: Doc) -> Column:
    """Labelled date, else the first date-like text of the head, line by line."""

    def dated(line: Column) -> Column:
        return F.coalesce(
            *[first_match(line, p) for p in (ISO_DATE, NUMERIC_DATE, MONTH_DATE)]
        )

    return F.coalesce(
        inline_value(doc, DATE_LABELS),
        first_present(F.transform(F.slice(doc.lines, 1, HEAD_LINES), dated)),
        F.lit(""),
    )


def due_date(doc: Doc) -> Column:
    return F.coalesce(inline_value(doc, DUE_LABELS), F.lit(""))


def first_index(doc: Doc, labels: Sequence[str]) -> Column:
    """1-based position of the first line equal to any label; NULL when there is none."""
    return F.least(*[position_of(doc.low, label.lower()) for label in labels])


def seller(doc: Doc) -> Column:
    """Section value, sponsor, else the first plain line above the buyer block."""
    bill_to = first_index(doc, BILL_TO_LABELS)
    above = F.coalesce(bill_to - 1, F.least(F.size(doc.lines), F.lit(12)))

    def plain(low_line: Column, i: Column) -> Column:
        skip = (
            X.starts_with_any(low_line, NOT_A_SELLER_PREFIXES)
            | F.get(doc.amounts, i).isNotNull()
            | low_line.contains("@")
        )
        return F.when(~skip, F.get(doc.lines, i))

    return F.coalesce(
        section_value(doc, SELLER_LABELS),
        inline_value(doc, SPONSOR_LABELS),
        first_present(F.transform(F.slice(doc.low, 1, above), plain)),
        F.lit(""),
    )


def buyer(doc: Doc) -> Column:
    """Section value, company name, candidate name, else the line below "Bill to"."""
    return F.coalesce(
        section_value(doc, BUYER_LABELS),
        inline_value(doc, COMPANY_LABELS),
        inline_value(doc, CANDIDATE_LABELS),
        F.get(doc.lines, first_index(doc, BILL_TO_LABELS)),
        F.lit(""),
    )


def description(doc: Doc) -> Column:
    """English side of the first plain line that names a service or product."""

    def at(low_line: Column, i: Column) -> Column:
        usable = X.contains_any(low_line, DESCRIPTION_WORDS) & ~X.looks_like_metadata(
            low_line, F.get(doc.amounts, i).isNotNull()
        )
        return F.when(usable, X.english_side(F.get(doc.lines, i)))

    return blank_to_null(first_present(F.transform(doc.low, at)))


def currency(doc: Doc) -> Column:
    """EUR, USD or GBP by sign or code anywhere, in that order; else empty."""
    return (
        F.when(doc.body.rlike("€|EUR"), "EUR")
        .when(doc.body.rlike(r"\$|USD"), "USD")
        .when(doc.body.rlike("£|GBP"), "GBP")
        .otherwise("")
    )


def document_type(doc: Doc) -> Column:
    head = F.array_join(F.slice(doc.low, 1, 5), "\n")
    return F.when(head.contains("receipt"), "receipt").otherwise("invoice")
