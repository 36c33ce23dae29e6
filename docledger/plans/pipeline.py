"""Documents to invoices, and events to outputs, errors and jobs."""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.functions import keys as K
from docledger.operators import jobs as J
from docledger.operators.layouts import (
    LAYOUTS,
    doc_columns,
    with_doc_columns,
)
from docledger.operators.objects import attach_objects, with_event_defaults
from docledger.operators.ubl import to_ubl_xml

_built: dict[tuple[int, str], Column] = {}


def _once(name: str, build) -> Column:
    """Build a large expression once per JVM; it only names columns, so it can be reused."""
    key = (id(SparkContext._gateway), name)
    if key not in _built:
        _built[key] = build()
    return _built[key]


def _parse_expression() -> Column:
    doc = doc_columns()
    first, *middle, last = LAYOUTS
    parsed = F.when(F.col("layout") == first.name, first.build(doc))
    for layout in middle:
        parsed = parsed.when(F.col("layout") == layout.name, layout.build(doc))
    return parsed.otherwise(last.build(doc))


def parse_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``layout``, ``invoice``, ``error_type`` and ``error_message`` to documents.

    One narrow pass: each layout is a branch of a CASE, so a document pays only for
    its own layout and nothing is shuffled or read twice. A document that cannot be
    parsed stays a row, with a NULL invoice and its error.
    """
    parsed = with_doc_columns(docs, text).withColumn("_parsed", _once("parse", _parse_expression))
    # A generator over one element keeps the optimizer from copying the parse expression
    # into later filters and field accesses: each document is parsed exactly once.
    return parsed.select(*docs.columns, "layout", F.inline_outer(F.array("_parsed")))


def with_xml(parsed: DataFrame) -> DataFrame:
    """Add the UBL text of each ``invoice``."""
    return parsed.withColumn("xml", _once("xml", lambda: to_ubl_xml(F.col("invoice"))))


def invoice_lines(parsed: DataFrame, doc: str) -> DataFrame:
    """Line-item table (doc, line_idx, sku, description, ...) of parsed documents.

    The outer form plus a test on its result, because for the inner form the optimizer
    adds a test of the lines below the generator and would work them out twice.
    """
    return (
        parsed.select(
            F.col(doc), F.posexplode_outer(F.col("invoice.lines")).alias("line_idx", "line")
        )
        .where(F.col("line_idx").isNotNull())
        .select(doc, "line_idx", "line.*")
    )


def invoice_headers(parsed: DataFrame, doc: str) -> DataFrame:
    """Header table of parsed documents, without their lines."""
    i = F.col("invoice")
    return parsed.where(i.isNotNull()).select(
        doc,
        *[
            i[name].alias(name)
            for name in ("document_type", "number", "date", "due_date", "currency")
        ],
        i["seller"].alias("seller"),
        i["buyer"].alias("buyer"),
        "invoice.totals.*",
    )


def process_events(
    events: DataFrame,
    objects: DataFrame,
    completed_at: Column,
    input_bucket: str = K.INPUT_BUCKET,
    output_bucket: str = K.OUTPUT_BUCKET,
    error_bucket: str = K.ERROR_BUCKET,
) -> DataFrame:
    """One row per event with everything the output, error and job tables need.

    ``events``: event_id, bucket, object_key, output_bucket, received_at.
    ``objects``: bucket, object_key, content, and optionally text and a slot column.
    Only this lookup moves data; parsing and XML stay in place.
    """
    with_buckets = with_event_defaults(events, input_bucket, output_bucket)
    return process_attached(attach_objects(with_buckets, objects), completed_at, error_bucket)


def process_attached(
    attached: DataFrame, completed_at: Column, error_bucket: str = K.ERROR_BUCKET
) -> DataFrame:
    """``process_events`` for events that already carry their object (or found = false).

    Ids and start times come from the event, the end from the caller's clock. A success always
    has its XML: an invoice that can't be written as such is an error.
    """
    text = (
        F.col("text")
        if "text" in attached.columns
        else F.make_valid_utf8(F.col("content").cast("string"))
    )
    parsed = with_xml(parse_documents(attached.withColumn("_text", text), "_text"))
    present = F.col("found")
    missing = F.concat(F.lit("Object not found: "), "bucket", F.lit("/"), "object_key")
    unwritten = F.col("error_type").isNull() & F.col("xml").isNull()
    staged = parsed.withColumns(
        {
            "error_message": F.when(~present, missing)
            .when(unwritten, "Invoice has a field without a value")
            .otherwise(F.col("error_message")),
            "error_type": F.when(~present | unwritten, "processing_error").otherwise(
                F.col("error_type")
            ),
        }
    ).withColumn("status", J.classify_outcome(F.col("error_type")))
    ok = F.col("status") == J.SUCCESS
    archived = ~ok & present
    key = F.col("object_key")
    return staged.select(
        J.job_id(F.col("bucket"), key, F.col("event_id").cast("string")).alias("id"),
        "status",
        F.col("bucket").alias("input_bucket"),
        key.alias("input_object_key"),
        "output_bucket",
        K.output_key(key).alias("output_object_key"),
        F.when(archived, error_bucket).alias("error_bucket"),
        F.when(archived, K.error_key(key)).alias("error_object_key"),
        F.when(archived, K.error_report_key(key)).alias("error_report_object_key"),
        "layout",
        F.when(ok, F.col("invoice")).alias("invoice"),
        F.when(ok, F.col("xml")).alias("xml"),
        "content",
        "error_type",
        "error_message",
        F.col("received_at").alias("started_at"),
        completed_at.alias("completed_at"),
    )
