"""Documents to lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docledger.functions.text import clean_line_array

PAGE_MARK = "\n--- page "


def assemble_pages(pages: DataFrame, doc: str, page_no: str, text: str) -> DataFrame:
    """One text per document: pages in order, each under its page mark.

    The result is one string per document, so a document is limited to what one
    string can hold. Jobs that only need lines should use ``page_lines``, which
    never brings the pages of a document together.
    """
    marked = F.concat(
        F.lit(PAGE_MARK), F.col("number").cast("string"), F.lit(" ---\n"), F.col("page_text")
    )
    return (
        pages.select(
            F.col(doc),
            F.col(page_no).alias("number"),
            F.coalesce(F.col(text), F.lit("")).alias("page_text"),
        )
        .select(doc, "number", marked.alias("marked"))
        .groupBy(doc)
        .agg(F.array_sort(F.collect_list(F.struct("number", "marked"))).alias("parts"))
        .select(doc, F.array_join(F.col("parts.marked"), "\n").alias("text"))
    )


def document_lines(docs: DataFrame, doc: str, text: str = "text") -> DataFrame:
    """Line table (doc, line_no, line); narrow, no shuffle."""
    # Outer plus a test above it: the inner form would clean every text twice, once for a
    # pushed-down test that there are lines at all.
    lines = F.posexplode_outer(clean_line_array(F.col(text))).alias("line_no", "line")
    return docs.select(F.col(doc), lines).where(F.col("line_no").isNotNull())


def page_lines(
    pages: DataFrame, doc: str, page_no: str, text: str, pages_per_group: int = 1000
) -> DataFrame:
    """Line table straight from pages, with document-wide line numbers.

    Only line counts are shuffled. The offset of a page is the number of lines in
    earlier groups of its document plus those in earlier pages of its own group, so
    one very long document is spread over many small windows. Page numbers must be
    unique within a document.
    """
    counted = pages.select(
        F.col(doc),
        F.col(page_no),
        F.floor(F.col(page_no) / pages_per_group).alias("page_group"),
        clean_line_array(F.coalesce(F.col(text), F.lit(""))).alias("lines"),
    )
    sizes = counted.select(doc, page_no, "page_group", F.size("lines").alias("n"))
    groups = sizes.groupBy(doc, "page_group").agg(F.sum("n").alias("group_n"))
    by_doc = Window.partitionBy(doc).orderBy("page_group").rowsBetween(
        Window.unboundedPreceding, -1
    )
    by_group = Window.partitionBy(doc, "page_group").orderBy(page_no).rowsBetween(
        Window.unboundedPreceding, -1
    )
    zero = F.lit(0).cast("bigint")
    group_start = groups.select(
        doc, "page_group", F.coalesce(F.sum("group_n").over(by_doc), zero).alias("group_start")
    )
    starts = (
        sizes.withColumn("inner_start", F.coalesce(F.sum("n").over(by_group), zero))
        .join(group_start, [doc, "page_group"])
        .select(doc, page_no, (F.col("group_start") + F.col("inner_start")).alias("start"))
    )
    return (
        counted.select(doc, page_no, "lines")
        .join(starts, [doc, page_no])
        .select(doc, "start", F.posexplode("lines").alias("at", "line"))
        .select(doc, (F.col("start") + F.col("at")).alias("line_no"), "line")
    )


def is_scanned(text: Column, min_chars: int = 20) -> Column:
    """Extension: too little text to be a text document."""
    return F.length(F.trim(F.coalesce(text, F.lit("")))) < min_chars
