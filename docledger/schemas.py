"""Explicit schemas. Nothing is inferred at read time."""

from pyspark.sql import types as T

# Wide enough for any number printed on an invoice (22 integer digits), exact to
# six decimals, and AMOUNT x RATE still fits DECIMAL(38, 10) without rounding.
AMOUNT = T.DecimalType(28, 6)
RATE = T.DecimalType(9, 4)

PARTY = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("vat", T.StringType()),
        T.StructField("tax_id", T.StringType()),
    ]
)

INVOICE_LINE = T.StructType(
    [
        T.StructField("sku", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("quantity", AMOUNT),
        T.StructField("unit_price", AMOUNT),
        T.StructField("vat_rate", RATE),
        T.StructField("line_total", AMOUNT),
    ]
)

TOTALS = T.StructType(
    [
        T.StructField("subtotal", AMOUNT),
        T.StructField("tax", AMOUNT),
        T.StructField("total", AMOUNT),
    ]
)

INVOICE = T.StructType(
    [
        T.StructField("document_type", T.StringType()),
        T.StructField("number", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("due_date", T.StringType()),
        T.StructField("currency", T.StringType()),
        T.StructField("seller", PARTY),
        T.StructField("buyer", PARTY),
        T.StructField("lines", T.ArrayType(INVOICE_LINE)),
        T.StructField("totals", TOTALS),
    ]
)

UPLOAD_EVENT = T.StructType(
    [
        T.StructField("bucket", T.StringType()),
        T.StructField("object_key", T.StringType()),
        T.StructField("output_bucket", T.StringType()),
    ]
)

JOB = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("input_bucket", T.StringType()),
        T.StructField("input_object_key", T.StringType()),
        T.StructField("output_bucket", T.StringType()),
        T.StructField("output_object_key", T.StringType()),
        T.StructField("error_bucket", T.StringType()),
        T.StructField("error_object_key", T.StringType()),
        T.StructField("error_report_object_key", T.StringType()),
        T.StructField("invoice_number", T.StringType()),
        T.StructField("document_type", T.StringType()),
        T.StructField("line_count", T.IntegerType()),
        T.StructField("error_type", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("error_log", T.StringType()),
        T.StructField("started_at", T.TimestampType()),
        T.StructField("completed_at", T.TimestampType()),
        T.StructField("duration_ms", T.LongType()),
    ]
)

ATTACHMENT = T.StructType(
    [
        T.StructField("filename", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("content", T.BinaryType()),
    ]
)

MAIL = T.StructType(
    [
        T.StructField("message_id", T.StringType()),
        T.StructField("from_addr", T.StringType()),
        T.StructField("to_addr", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("received_at", T.TimestampType()),
        T.StructField("attachments", T.ArrayType(ATTACHMENT)),
    ]
)
