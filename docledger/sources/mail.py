"""Mail with parsed attachments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.functions import keys as K


def explode_attachments(mail: DataFrame) -> DataFrame:
    """One row per attachment; mail without attachments gives none."""
    return mail.select(
        *[c for c in mail.columns if c != "attachments"], F.inline("attachments")
    )


def keep_pdf(attachments: DataFrame) -> DataFrame:
    """Attachments named .pdf, in any case."""
    return attachments.where(K.is_pdf_name(F.col("filename")))


def mail_objects(mail: DataFrame, bucket: str = K.INPUT_BUCKET) -> DataFrame:
    """Stored objects of all PDF attachments, with their mailbox."""
    return keep_pdf(explode_attachments(mail)).select(
        F.lit(bucket).alias("bucket"),
        K.mail_object_key(F.col("received_at"), F.col("filename")).alias("object_key"),
        K.mailbox_of(F.col("to_addr")).alias("mailbox"),
        "message_id",
        "content",
    )
