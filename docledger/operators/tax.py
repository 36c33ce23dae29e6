"""VAT breakdown, numbering and nesting of invoice lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docledger.functions.binding import let, positions


def tax_category(rate: Column) -> Column:
    """S for positive rates, Z for the rest."""
    return F.when(rate > 0, "S").otherwise("Z")


def _hundredth(amount: Column) -> Column:
    """amount / 100 with two decimals, half-up, without an inexact division."""
    return (F.round(amount, 0).cast("decimal(28,0)") * F.lit("0.01").cast("decimal(3,2)")).cast(
        "decimal(28,2)"
    )


def tax_breakdown(lines: DataFrame, doc: str) -> DataFrame:
    """Taxable and tax amount per document and rate, rounded after summing.

    One hash aggregation with map-side partial sums, so a document or rate that holds
    much of the data is mostly summed before the shuffle.
    """
    return (
        lines.groupBy(doc, "vat_rate")
        .agg(
            F.sum("line_total").alias("taxable"),
            F.sum(F.col("line_total") * F.col("vat_rate")).alias("tax_times_100"),
        )
        .select(
            doc,
            "vat_rate",
            F.round("taxable", 2).cast("decimal(28,2)").alias("taxable_amount"),
            _hundredth(F.col("tax_times_100")).alias("tax_amount"),
            tax_category(F.col("vat_rate")).alias("category"),
        )
    )


def document_tax(headers: DataFrame, lines: DataFrame, doc: str, declared: str) -> DataFrame:
    """Declared tax where it is not zero, else the sum over the lines (unrounded parts)."""
    summed = lines.groupBy(doc).agg(
        F.sum(F.col("line_total") * F.col("vat_rate")).alias("tax_times_100")
    )
    zero = F.lit(0).cast("decimal(28,2)")
    return headers.join(summed, doc, "left").select(
        doc,
        F.when(F.col(declared) != 0, F.round(F.col(declared), 2).cast("decimal(28,2)"))
        .otherwise(F.coalesce(_hundredth(F.col("tax_times_100")), zero))
        .alias("tax_amount"),
    )


def declared_balance(headers: DataFrame, lines: DataFrame, doc: str) -> DataFrame:
    """Does the declared tax equal the per-rate sum; does subtotal + tax give the total."""
    summed = lines.groupBy(doc).agg(
        F.sum(F.col("line_total") * F.col("vat_rate")).alias("tax_times_100")
    )
    zero = F.lit(0).cast("decimal(28,2)")
    line_tax = F.coalesce(_hundredth(F.col("tax_times_100")), zero)
    return headers.join(summed, doc, "left").select(
        doc,
        (F.round("tax", 2).cast("decimal(28,2)") == line_tax).alias("tax_matches"),
        (F.col("subtotal") + F.col("tax") == F.col("total")).alias("total_matches"),
    )


def monetary_totals(invoice: Column) -> Column:
    """The four document totals, two decimals."""
    two = lambda c: F.round(c, 2).cast("decimal(28,2)")
    subtotal, total = two(invoice["totals"]["subtotal"]), two(invoice["totals"]["total"])
    return F.struct(
        subtotal.alias("line_extension_amount"),
        subtotal.alias("tax_exclusive_amount"),
        total.alias("tax_inclusive_amount"),
        total.alias("payable_amount"),
    )


def number_lines(lines: DataFrame, doc: str, order: list[str]) -> DataFrame:
    """1-based line id within each document."""
    window = Window.partitionBy(doc).orderBy(*order)
    return lines.withColumn("line_id", F.row_number().over(window))


def line_count(lines: DataFrame, doc: str) -> DataFrame:
    return lines.groupBy(doc).agg(F.count("*").alias("line_count"))


def nest_invoice(headers: DataFrame, lines: DataFrame, doc: str) -> DataFrame:
    """One record per document: the header columns plus its ordered ``lines``.

    For line tables only: parsed documents already carry their lines. The record is one
    row by definition, so its lines have to fit a row.
    """
    fields = [c for c in lines.columns if c not in (doc, "line_idx")]
    nested = (
        lines.groupBy(doc)
        .agg(F.array_sort(F.collect_list(F.struct("line_idx", *fields))).alias("ordered"))
        .select(
            doc,
            F.transform(
                "ordered", lambda x: F.struct(*[x[name].alias(name) for name in fields])
            ).alias("lines"),
        )
    )
    return headers.join(nested, doc, "left")


def tax_groups(lines: Column) -> Column:
    """Per-rate sums of a nested invoice, ascending: array of (rate, taxable, tax_times_100).

    Lines are sorted by rate and cut where the rate changes, so every line is summed once.
    """
    # sort_array: array_sort compares by a lambda. No element is NULL here.
    ordered = F.sort_array(
        F.transform(
            lines, lambda x: F.struct(x["vat_rate"].alias("rate"), x["line_total"].alias("total"))
        )
    )
    zero = F.lit(0)

    def cut(sorted_lines: Column) -> Column:
        rate = lambda i: F.get(sorted_lines, i)["rate"]
        starts = F.filter(
            positions(F.size(sorted_lines)), lambda i: (i == 0) | (rate(i) != rate(i - 1))
        )

        def groups(s: Column) -> Column:
            def group(begin: Column, j: Column) -> Column:
                end = F.coalesce(F.get(s, j + 1), F.size(sorted_lines))
                members = F.slice(sorted_lines, begin + 1, end - begin)
                taxable = F.aggregate(
                    members,
                    zero.cast("decimal(28,6)"),
                    lambda acc, x: (acc + x["total"]).cast("decimal(28,6)"),
                )
                tax = F.aggregate(
                    members,
                    zero.cast("decimal(38,10)"),
                    lambda acc, x: (acc + x["total"] * x["rate"]).cast("decimal(38,10)"),
                )
                return F.struct(
                    rate(begin).alias("rate"),
                    taxable.alias("taxable"),
                    tax.alias("tax_times_100"),
                )

            return F.transform(s, group)

        return let(starts, groups)

    return let(ordered, cut)


def summed_tax_times_100(groups: Column) -> Column:
    return F.aggregate(
        groups,
        F.lit(0).cast("decimal(38,10)"),
        lambda acc, g: (acc + g["tax_times_100"]).cast("decimal(38,10)"),
    )


def hundredth_text(amount: Column) -> Column:
    return _hundredth(amount).cast("string")
