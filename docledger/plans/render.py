"""Invoice texts made from the star-schema tables, in every layout the parser knows.

Used to test and measure the parser: what is printed is known from the tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIGITS, LETTERS = "0123456789", "bcdfghjklm"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice lines (k, sku, description, qty, unit, rate, total) and their order columns."""
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.concat_ws(" ", "p_name", "p_type").alias("description"),
        F.col("p_retailprice").cast("decimal(18,2)").alias("unit"),
    )
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax"]
    return (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", *order)
        .join(part, "l_partkey")
        .select(
            F.col("l_orderkey").alias("k"),
            *order,
            F.concat(
                F.lit("PT-"), F.lpad((F.col("l_partkey") % 10000).cast("string"), 4, "0")
            ).alias("sku"),
            "description",
            F.col("l_quantity").cast("bigint").alias("qty"),
            "unit",
            F.round(F.col("l_tax") * 100).cast("bigint").alias("rate"),
            F.col("l_extendedprice").cast("decimal(18,2)").alias("total"),
        )
    )


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax"]


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the fields an invoice header shows."""
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"),
        F.concat_ws(
            " ",
            F.initcap("c_mktsegment"),
            F.lit("House"),
            F.translate(F.col("c_custkey").cast("string"), DIGITS, LETTERS),
        ).alias("buyer"),
    )
    return (
        table(spark, sf_dir, "orders")
        .join(customer, "o_custkey")
        .select(
            F.col("o_orderkey").alias("k"),
            "o_custkey",
            "buyer",
            F.concat(F.lit("Atlas Goods "), "o_orderstatus").alias("seller"),
            F.col("o_orderdate").cast("date").alias("d"),
            F.date_add(F.col("o_orderdate").cast("date"), 30).alias("due"),
            F.col("o_totalprice").cast("decimal(18,2)").alias("price"),
        )
    )


def document_facts(spark: SparkSession, sf_dir: str, with_empty: bool = False) -> DataFrame:
    """One row per document: order fields, ordered ``rows`` and their sums.

    An order is one document, however many lines it has, as a document is one row for the
    parser; ``with_empty`` also keeps orders without lines.
    """
    lines = line_facts(spark, sf_dir)
    fields = [c for c in lines.columns if c not in ("k", *LINE_ORDER)]
    grouped = (
        lines.groupBy("k").agg(
            F.sort_array(F.collect_list(F.struct(*LINE_ORDER, *fields))).alias("rows"),
            F.sum("total").cast("decimal(18,2)").alias("sub"),
            F.sum(F.col("total") * F.col("rate")).alias("tax_times_100"),
        )
    )
    zero = F.lit(0).cast("decimal(18,2)")
    tax = (F.round("tax_times_100", 0).cast("decimal(22,0)") * F.lit("0.01").cast("decimal(3,2)")).cast(
        "decimal(18,2)"
    )
    return (
        order_facts(spark, sf_dir)
        .join(grouped, "k", "left" if with_empty else "inner")
        .withColumns(
            {
                "doc_key": F.col("k").cast("string"),
                "n": F.coalesce(F.size("rows"), F.lit(0)),
                "rows": F.when(F.col("rows").isNotNull(), F.col("rows")).otherwise(F.array()),
                "sub": F.coalesce("sub", zero),
                "tax": F.coalesce(tax, zero),
            }
        )
        .withColumn("gross", (F.col("sub") + F.col("tax")).cast("decimal(18,2)"))
    )


def _s(column: Column) -> Column:
    return column.cast("string")


def _cells(row: Callable[[Column], list[Column]]) -> Column:
    """Lines printed for each row, one after another."""
    return F.flatten(F.transform("rows", lambda r: F.array(*row(r))))


def _page(*blocks: Column | str) -> Column:
    """Blocks (a line or an array of lines) under each other."""
    arrays = []
    for block in blocks:
        if isinstance(block, str):
            block = F.lit(block)
        arrays.append(block)
    return F.array_join(F.concat(*arrays), "\n")


def _lines(*lines: Column | str) -> Column:
    return F.array(*[F.lit(x) if isinstance(x, str) else x for x in lines])


def _after(prefix: str, column: Column, suffix: str = "") -> Column:
    return F.concat(F.lit(prefix), column, F.lit(suffix))


def eu_text() -> Column:
    c = F.col
    return _page(
        _lines(
            "BLUE RIVER SOFTWARE LTD",
            "VAT: LT100000000",
            "Invoice no.",
            _after("INV-", _s(c("k"))),
            "Invoice date",
            F.date_format("d", "yyyy-MM-dd"),
            "Due date",
            F.date_format("due", "yyyy-MM-dd"),
            "Currency",
            "EUR",
            "Bill To",
            c("buyer"),
            _after("VAT: C", _s(c("o_custkey"))),
            "Description",
            "Qty",
            "Unit price",
            "VAT %",
            "Line total",
        ),
        _cells(
            lambda r: [
                r["description"],
                _s(r["qty"]),
                _after("€", _s(r["unit"])),
                _after("", _s(r["rate"]), "%"),
                _after("€", _s(r["total"])),
            ]
        ),
        _lines(
            "Subtotal",
            _after("€", _s(c("sub"))),
            "VAT",
            _after("€", _s(c("tax"))),
            "Total due",
            _after("€", _s(c("gross"))),
        ),
    )


def us_text() -> Column:
    c = F.col
    return _page(
        _lines(
            "North Star Office Supplies",
            _after("Tax ID: 12-", _s(c("k"))),
            "Invoice #",
            _after("INV-", _s(c("k"))),
            "Date",
            F.date_format("d", "MMM d, yyyy"),
            "Due",
            F.date_format("due", "MMM d, yyyy"),
            "Bill To",
            c("buyer"),
            "Item",
            "Qty",
            "Price",
            "Amount",
        ),
        _cells(
            lambda r: [
                r["description"],
                _s(r["qty"]),
                _after("$", F.format_number(r["unit"], 2)),
                _after("$", F.format_number(r["total"], 2)),
            ]
        ),
        _lines(
            "Subtotal",
            _after("$", F.format_number("sub", 2)),
            "Sales tax",
            _after("$", F.format_number("tax", 2)),
            "Balance due",
            _after("US$", F.format_number("gross", 2)),
        ),
    )


def sku_text() -> Column:
    c = F.col
    return _page(
        _lines(
            "GLOBAL COMPONENTS TEST INVOICE",
            F.concat(
                F.lit("Invoice INV-"),
                _s(c("k")),
                F.lit(" - Date "),
                F.date_format("d", "yyyy-MM-dd"),
                F.lit(" - Due "),
                F.date_format("due", "yyyy-MM-dd"),
            ),
            "Page 1 of 1",
        ),
        _cells(
            lambda r: [
                r["sku"],
                r["description"],
                _s(r["qty"]),
                _after("", _s(r["unit"]), " EUR"),
                _after("", _s(r["rate"]), "%"),
                _after("", _s(r["total"]), " EUR"),
            ]
        ),
        _lines(
            _after("Subtotal: EUR ", _s(c("sub"))),
            _after("VAT: EUR ", _s(c("tax"))),
            _after("Grand total: EUR ", _s(c("gross"))),
        ),
    )


def credit_text() -> Column:
    c = F.col
    return _page(
        _lines(
            "CREDIT NOTE",
            "Credit note no.",
            _after("CN-", _s(c("k"))),
            "Date",
            F.date_format("d", "dd-MMM-yyyy"),
            "Customer",
            c("buyer"),
            "Description",
            "Qty",
            "Unit price",
            "VAT %",
            "Credit amount",
        ),
        _cells(
            lambda r: [
                r["description"],
                _s(r["qty"]),
                _after("€", _s(r["unit"])),
                _after("", _s(r["rate"]), "%"),
                _after("(€", F.format_number(r["total"], 2), ")"),
            ]
        ),
        _lines(
            _after("Subtotal credit: (", _s(c("sub")), ")"),
            _after("VAT credit: (€", _s(c("tax")), ")"),
            _after("Total credit: -", _s(c("gross")), " EUR"),
        ),
    )


def compact_text() -> Column:
    """Generic table; rows alternate between one line and text above the numbers."""
    c = F.col

    def row(r: Column, i: Column) -> Column:
        numbers = F.concat(
            _s(r["qty"]),
            F.lit(" €"),
            _s(r["unit"]),
            F.lit(" "),
            _s(r["rate"]),
            F.lit("% €"),
            _s(r["total"]),
        )
        return F.when(
            i % 2 == 0, F.array(F.concat(r["description"], F.lit(" "), numbers))
        ).otherwise(F.array(r["description"], F.lit("in stock"), numbers))

    return _page(
        _lines(
            "Page 1 of 1",
            "Invoice",
            _after("Invoice number INV\x00", _s(c("k"))),
            _after("Date of issue ", F.date_format("d", "MMMM d, yyyy")),
            _after("Date due ", F.date_format("due", "MMMM d, yyyy")),
            c("seller"),
            "office@example.com",
            "Bill to",
            c("buyer"),
            "buyer@example.com",
            "Description Qty Unit price Tax Amount",
        ),
        F.flatten(F.transform("rows", row)),
        _lines(
            _after("Subtotal €", _s(c("sub"))),
            _after("VAT €", _s(c("tax"))),
            _after("Total €", _s(c("gross"))),
            _after("Amount due €", _s(c("gross"))),
        ),
    )


def stacked_text() -> Column:
    """Generic table with one value per line and amounts above their labels."""
    c = F.col
    return _page(
        _lines(
            "INVOICE",
            _after("# ", _s(c("k"))),
            c("seller"),
            "Bill To",
            ":",
            c("buyer"),
            F.date_format("d", "MMM d yyyy"),
            "Crate by rail",
            _after("$", F.format_number("sub", 2)),
            "Balance Due",
            ":",
            "Item",
            "Quantity",
            "Rate",
            "Amount",
        ),
        _cells(
            lambda r: [
                r["description"],
                F.lit("in stock"),
                _s(r["qty"]),
                _after("$", F.format_number(r["unit"], 2)),
                _after("$", F.format_number(r["total"], 2)),
            ]
        ),
        _lines(_after("$", F.format_number("sub", 2)), "Subtotal", ":", "Total", ":"),
    )


def receipt_text() -> Column:
    """Generic labelled amounts without a table."""
    c = F.col
    adjustment = F.concat(F.lit("-"), _s(c("k") % 50 + 1), F.lit(".00 USD"))
    return _page(
        _lines(
            _after("Official Receipt / Tax Invoice #: ", _s(c("k"))),
            _after("Prepared on Behalf of your Test Sponsor: ", c("seller")),
            _after("Company Name: ", c("buyer")),
            "Candidate Name: M. Keel",
            "Exam Name: Practical Assessment",
            _after("Scheduled Date: ", F.date_format("due", "d MMMM yyyy")),
            _after("Transaction Date: ", F.date_format("d", "d MMMM yyyy")),
            _after("Exam Price: ", _s(c("price")), " USD"),
            F.when(c("k") % 2 == 0, _after("Promotion Amount: ", adjustment)).otherwise(
                _after("Adjustment: ", F.concat(_s(c("k") % 50 + 1), F.lit(".00 USD")))
            ),
            _after("Tax: ", _s(c("k") % 40), ".25 USD"),
            _after("Transaction Amount: ", _s(c("price")), " USD"),
            _after("Transaction Confirmation #: t", _s(c("k"))),
        )
    )


def bilingual_text() -> Column:
    """Generic two-language labels without a table."""
    c = F.col
    return _page(
        _lines(
            F.concat(
                F.lit("Rechnung / Invoice HB-"),
                F.date_format("d", "yy"),
                F.lit("-"),
                F.lpad(_s(c("k")), 9, "0"),
            ),
            F.date_format("d", "yyyy-MM-dd"),
            "Lieferant / Supplier",
            c("seller"),
            "Kunde / Customer",
            c("buyer"),
            "Liegeplatz / Berth service",
            _after("Netto / Total excl. VAT € ", _s(c("sub"))),
            _after("21% MwSt / 21% VAT € ", _s(c("tax"))),
            _after("Brutto / Total incl. VAT € ", _s(c("gross"))),
        )
    )


# In the order the mixed sets take them, by order key.
TEXTS: dict[str, Callable[[], Column]] = {
    "eu": eu_text,
    "us": us_text,
    "sku": sku_text,
    "credit": credit_text,
    "compact": compact_text,
    "stacked": stacked_text,
    "receipt": receipt_text,
    "bilingual": bilingual_text,
}
FIXED = ("eu", "us", "sku", "credit")
GENERIC = ("compact", "stacked", "receipt", "bilingual")
ALL = (*FIXED, *GENERIC)


def render(
    spark: SparkSession, sf_dir: str, *kinds: str, with_empty: bool = False
) -> DataFrame:
    """(k, doc_key, kind, text) for every order; several kinds take turns by order key."""
    facts = document_facts(spark, sf_dir, with_empty)
    turn = F.col("k") % len(kinds)
    text, name = TEXTS[kinds[-1]](), F.lit(kinds[-1])
    for i, kind in enumerate(kinds[:-1]):
        text = F.when(turn == i, TEXTS[kind]()).otherwise(text)
        name = F.when(turn == i, F.lit(kind)).otherwise(name)
    return facts.select("k", "doc_key", name.alias("kind"), text.alias("text"))
