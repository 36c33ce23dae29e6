"""EN 16931 / UBL 2.1 XML of nested invoices.

The document tree is fixed, so it is laid out as one ``concat`` over literal pieces and
columns. Optional elements are CASE branches, repeated ones a transform over the lines.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docledger.functions.binding import blank_to_null, let
from docledger.functions.dates import to_iso_date
from docledger.functions.money import money_text, plain_number
from docledger.operators.tax import (
    hundredth_text,
    summed_tax_times_100,
    tax_category,
    tax_groups,
)

# ---- fixed values: namespaces and codes ----
NS_INVOICE = "urn:oasis:names:specification:ubl:schema:xsd:Invoice-2"
NS_CREDIT_NOTE = "urn:oasis:names:specification:ubl:schema:xsd:CreditNote-2"
NS_CAC = "urn:oasis:names:specification:ubl:schema:xsd:CommonAggregateComponents-2"
NS_CBC = "urn:oasis:names:specification:ubl:schema:xsd:CommonBasicComponents-2"
EN16931 = "urn:cen.eu:en16931:2017"
INVOICE_CODE, CREDIT_NOTE_CODE = "380", "381"
UNIT_CODE = "C62"
UNKNOWN_SUPPLIER, UNKNOWN_CUSTOMER = "Unknown supplier", "Unknown customer"
PEPPOL_PROFILE = "urn:fdc:peppol.eu:2017:poacc:billing:01:1.0"
XRECHNUNG = "urn:cen.eu:en16931:2017#compliant#urn:xeinkauf.de:kosit:xrechnung_3.0"
# --------------------------------------------

Piece = str | Column
INDENT = "  "


def is_credit_note(document_type: Column) -> Column:
    return document_type == "credit_note"


def ubl_type(document_type: Column) -> Column:
    """Root, type code and line names for a document type; receipts are invoices."""

    def names(root: str, code: str, quantity: str) -> Column:
        return F.struct(
            F.lit(root).alias("root"),
            F.lit(code).alias("type_code"),
            F.lit(root + "Line").alias("line"),
            F.lit(quantity).alias("quantity"),
        )

    return F.when(
        is_credit_note(document_type), names("CreditNote", CREDIT_NOTE_CODE, "CreditedQuantity")
    ).otherwise(names("Invoice", INVOICE_CODE, "InvoicedQuantity"))


def party_name(name: Column, fallback: str) -> Column:
    return F.coalesce(blank_to_null(name), F.lit(fallback))


def _escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def _attribute(text: Column) -> Column:
    return F.replace(_escaped(text), F.lit('"'), F.lit("&quot;"))


def _joined(pieces: Iterable[Piece]) -> Column:
    """One concat; neighbouring literals become one."""
    merged: list[Piece] = []
    for piece in pieces:
        if isinstance(piece, str) and merged and isinstance(merged[-1], str):
            merged[-1] += piece
        else:
            merged.append(piece)
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in merged])


def _node(level: int, tag: Piece, *children: list[Piece]) -> list[Piece]:
    pad = "\n" + INDENT * level
    inner = [piece for child in children for piece in child]
    return [pad, "<", tag, ">", *inner, pad, "</", tag, ">"]


def _leaf(level: int, tag: Piece, text: Piece, attribute: tuple[str, Piece] | None = None):
    """Element with text that is never empty and needs no escaping."""
    head: list[Piece] = ["\n" + INDENT * level, "<", tag]
    if attribute:
        head += [f' {attribute[0]}="', attribute[1], '"']
    return [*head, ">", text, "</", tag, ">"]


def _text(level: int, tag: str, text: Column) -> list[Piece]:
    """Element with free text; an empty one is a self-closing tag."""

    def element(t: Column) -> Column:
        filled = F.concat(F.lit(f"<{tag}>"), _escaped(t), F.lit(f"</{tag}>"))
        return F.when(t == "", f"<{tag} />").otherwise(filled)

    return ["\n" + INDENT * level, let(text, element)]


def _optional(present: Column, pieces: list[Piece]) -> list[Piece]:
    return [F.when(present, _joined(pieces)).otherwise("")]


def _filled(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def _party(role: str, party: Column, fallback: str) -> list[Piece]:
    name = party_name(party["name"], fallback)
    return _node(
        1,
        role,
        _node(
            2,
            "cac:Party",
            _node(3, "cac:PartyName", _text(4, "cbc:Name", name)),
            _optional(
                _filled(party["vat"]),
                _node(
                    3,
                    "cac:PartyTaxScheme",
                    _text(4, "cbc:CompanyID", party["vat"]),
                    _node(4, "cac:TaxScheme", _leaf(5, "cbc:ID", "VAT")),
                ),
            ),
            _node(
                3,
                "cac:PartyLegalEntity",
                _text(4, "cbc:RegistrationName", name),
                _optional(_filled(party["tax_id"]), _text(4, "cbc:CompanyID", party["tax_id"])),
            ),
        ),
    )


def _tax_category(level: int, tag: str, rate: Column) -> list[Piece]:
    return _node(
        level,
        tag,
        _leaf(level + 1, "cbc:ID", tax_category(rate)),
        _leaf(level + 1, "cbc:Percent", plain_number(rate)),
        _node(level + 1, "cac:TaxScheme", _leaf(level + 2, "cbc:ID", "VAT")),
    )


def _tax_total(totals: Column, groups: Column, currency: Column) -> list[Piece]:
    tax = F.when(totals["tax"] != 0, money_text(totals["tax"])).otherwise(
        hundredth_text(summed_tax_times_100(groups))
    )

    def subtotal(g: Column) -> Column:
        return _joined(
            _node(
                2,
                "cac:TaxSubtotal",
                _leaf(
                    3, "cbc:TaxableAmount", money_text(g["taxable"]), ("currencyID", currency)
                ),
                _leaf(
                    3,
                    "cbc:TaxAmount",
                    hundredth_text(g["tax_times_100"]),
                    ("currencyID", currency),
                ),
                _tax_category(3, "cac:TaxCategory", g["rate"]),
            )
        )

    return _node(
        1,
        "cac:TaxTotal",
        _leaf(2, "cbc:TaxAmount", tax, ("currencyID", currency)),
        [F.array_join(F.transform(groups, subtotal), "")],
    )


def _monetary_total(totals: Column, currency: Column) -> list[Piece]:
    subtotal, total = money_text(totals["subtotal"]), money_text(totals["total"])
    return _node(
        1,
        "cac:LegalMonetaryTotal",
        *[
            _leaf(2, f"cbc:{tag}", amount, ("currencyID", currency))
            for tag, amount in (
                ("LineExtensionAmount", subtotal),
                ("TaxExclusiveAmount", subtotal),
                ("TaxInclusiveAmount", total),
                ("PayableAmount", total),
            )
        ],
    )


def _lines(lines: Column, names: Column, currency: Column) -> Column:
    def line(x: Column, i: Column) -> Column:
        text = F.coalesce(x["description"], F.lit(""))
        return _joined(
            _node(
                1,
                F.concat(F.lit("cac:"), names["line"]),
                _leaf(2, "cbc:ID", (i + 1).cast("string")),
                _leaf(
                    2,
                    F.concat(F.lit("cbc:"), names["quantity"]),
                    plain_number(x["quantity"]),
                    ("unitCode", UNIT_CODE),
                ),
                _leaf(
                    2,
                    "cbc:LineExtensionAmount",
                    money_text(x["line_total"]),
                    ("currencyID", currency),
                ),
                _node(
                    2,
                    "cac:Item",
                    _text(3, "cbc:Description", text),
                    _text(3, "cbc:Name", text),
                    _optional(
                        _filled(x["sku"]),
                        _node(3, "cac:SellersItemIdentification", _text(4, "cbc:ID", x["sku"])),
                    ),
                    _tax_category(3, "cac:ClassifiedTaxCategory", x["vat_rate"]),
                ),
                _node(
                    2,
                    "cac:Price",
                    _leaf(
                        3, "cbc:PriceAmount", money_text(x["unit_price"]), ("currencyID", currency)
                    ),
                ),
            )
        )

    return F.array_join(F.transform(lines, line), "")


def to_ubl_xml(
    invoice: Column, customization: str = EN16931, profile: str | None = None
) -> Column:
    """UBL text of a nested invoice, NULL for a NULL invoice.

    ``customization`` and ``profile`` are an extension for related profiles.
    """

    def document(v: Column) -> Column:
        names, groups, currency = v["names"], v["groups"], v["currency"]
        credit = is_credit_note(invoice["document_type"])
        namespace = F.when(credit, NS_CREDIT_NOTE).otherwise(NS_INVOICE)
        code_tag = F.concat(F.lit("cbc:"), names["root"], F.lit("TypeCode"))
        body = [
            *_leaf(1, "cbc:CustomizationID", customization),
            *(_leaf(1, "cbc:ProfileID", profile) if profile else []),
            *_text(1, "cbc:ID", invoice["number"]),
            *_text(1, "cbc:IssueDate", to_iso_date(invoice["date"])),
            *_optional(
                _filled(invoice["due_date"]),
                _text(1, "cbc:DueDate", to_iso_date(invoice["due_date"])),
            ),
            *_leaf(1, code_tag, names["type_code"]),
            *_text(1, "cbc:DocumentCurrencyCode", F.coalesce(invoice["currency"], F.lit(""))),
            *_party("cac:AccountingSupplierParty", invoice["seller"], UNKNOWN_SUPPLIER),
            *_party("cac:AccountingCustomerParty", invoice["buyer"], UNKNOWN_CUSTOMER),
            *_tax_total(invoice["totals"], groups, currency),
            *_monetary_total(invoice["totals"], currency),
            _lines(invoice["lines"], names, currency),
        ]
        return _joined(
            [
                "<?xml version='1.0' encoding='utf-8'?>\n<",
                names["root"],
                ' xmlns="',
                namespace,
                f'" xmlns:cac="{NS_CAC}" xmlns:cbc="{NS_CBC}">',
                *body,
                "\n</",
                names["root"],
                ">",
            ]
        )

    shared = F.struct(
        ubl_type(invoice["document_type"]).alias("names"),
        tax_groups(invoice["lines"]).alias("groups"),
        _attribute(F.coalesce(invoice["currency"], F.lit(""))).alias("currency"),
    )
    return F.when(invoice.isNotNull(), let(shared, document))
