"""Upload events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docledger.functions.keys import event_json
from docledger.schemas import UPLOAD_EVENT

_CORRUPT = "_corrupt_record"
_EVENT = T.StructType([*UPLOAD_EVENT.fields, T.StructField(_CORRUPT, T.StringType())])


def parse_events(raw: DataFrame, value: str) -> DataFrame:
    """Add the event fields and ``malformed``: not JSON, or no object key."""
    event = F.from_json(F.col(value), _EVENT)
    return (
        raw.withColumn("_event", event)
        .withColumns(
            {
                "bucket": F.col("_event.bucket"),
                "object_key": F.col("_event.object_key"),
                "output_bucket": F.col("_event.output_bucket"),
                "malformed": F.col(f"_event.{_CORRUPT}").isNotNull()
                | F.col("_event.object_key").isNull(),
            }
        )
        .drop("_event")
    )


def split_events(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable events, and the dead-letter rows."""
    good = parsed.where(~F.col("malformed")).drop("malformed")
    dead = parsed.where(F.col("malformed")).drop("malformed")
    return good, dead


def read_events(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """JSON lines with a fixed schema, as ``parse_events`` gives them."""
    reader = spark.readStream if streaming else spark.read
    return parse_events(reader.format("text").load(path), "value")


def build_events(objects: DataFrame) -> DataFrame:
    """One event text per stored object."""
    return objects.withColumn("event", event_json(F.col("bucket"), F.col("object_key")))

