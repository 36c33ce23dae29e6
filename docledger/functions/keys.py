"""Object keys, mail addresses and links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docledger.functions.binding import blank_to_null

# ---- fixed values ----
INPUT_BUCKET = "inv-input"
OUTPUT_BUCKET = "inv-output"
ERROR_BUCKET = "inv-error"
ERROR_FOLDER = "failed"
ERROR_POLICY = (
    "Input object is left in place. A copy is archived in the error bucket when available."
)
XML_TYPE = "application/xml"
PDF_TYPE = "application/pdf"
JSON_TYPE = "application/json"
# ----------------------


def _parts(key: Column) -> Column:
    return F.filter(F.split(key, "/"), lambda p: ~p.isin("", "."))


def _normal_path(key: Column) -> Column:
    """Path form without empty and '.' steps; a leading slash stays (exactly two stay two)."""
    root = F.when(key.rlike("^//(?!/)"), "//").when(key.startswith("/"), "/").otherwise("")
    return F.concat(root, F.array_join(_parts(key), "/"))


def output_key(key: Column) -> Column:
    """Replace the last suffix by .xml, or append .xml."""
    name = F.coalesce(F.try_element_at(_parts(key), F.lit(-1)), F.lit(""))
    # A suffix needs at least one character before its dot and one after it.
    has_suffix = name.rlike(r"(?s)^.+\.[^.]+$")
    replaced = F.regexp_replace(_normal_path(key), r"\.[^./]+$", ".xml")
    return F.when(has_suffix, replaced).otherwise(F.concat(key, F.lit(".xml")))


def safe_key(key: Column) -> Column:
    """Key without empty, '.', '..' and root parts."""
    kept = F.filter(_parts(key), lambda p: p != "..")
    return F.coalesce(blank_to_null(F.array_join(kept, "/")), F.lit("invoice.pdf"))


def error_key(key: Column) -> Column:
    return F.concat(F.lit(ERROR_FOLDER + "/"), safe_key(key))


def error_report_key(key: Column) -> Column:
    return F.concat(error_key(key), F.lit(".error.json"))


def error_report(bucket: Column, key: Column, error_type: Column, message: Column) -> Column:
    """JSON report filed beside the archived copy."""
    return F.to_json(
        F.struct(
            bucket.alias("input_bucket"),
            key.alias("input_object_key"),
            error_type.alias("error_type"),
            message.alias("message"),
            F.lit(ERROR_POLICY).alias("policy"),
        ),
        {"ignoreNullFields": "false"},
    )


def mailbox_of(address: Column) -> Column:
    """Local part of an address; the domain does not matter."""
    return F.substring_index(address, "@", 1)


def is_pdf_name(filename: Column) -> Column:
    return F.lower(filename).endswith(".pdf")


def mail_object_key(received_at: Column, filename: Column) -> Column:
    """Time-stamped key, taken from the message so that a replay gives the same key."""
    return F.concat(F.date_format(received_at, "yyyyMMdd-HHmmss"), F.lit("-"), filename)


def event_json(bucket: Column, object_key: Column) -> Column:
    return F.to_json(F.struct(bucket.alias("bucket"), object_key.alias("object_key")))


def or_default(value: Column, default: str) -> Column:
    """Default for a missing or empty value."""
    return F.coalesce(blank_to_null(value), F.lit(default))


def object_url(job_id: Column, kind: str, bucket: Column, key: Column) -> Column:
    present = (F.coalesce(bucket, F.lit("")) != "") & (F.coalesce(key, F.lit("")) != "")
    return F.when(present, F.concat(F.lit("/objects/"), job_id, F.lit("/" + kind)))
