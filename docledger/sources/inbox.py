"""Invoice folders as batch or streaming sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.functions.keys import INPUT_BUCKET

_PDF = {"pathGlobFilter": "*.pdf", "recursiveFileLookup": "false"}
_BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def _objects(files: DataFrame, bucket: str) -> DataFrame:
    return files.select(
        F.lit(bucket).alias("bucket"),
        F.element_at(F.split("path", "/"), -1).alias("object_key"),
        "content",
        F.col("modificationTime").alias("modification_time"),
    )


def scan_inbox(spark: SparkSession, folder: str, bucket: str = INPUT_BUCKET) -> DataFrame:
    """Files ending in .pdf (case matters) directly in the folder; sources stay in place."""
    return _objects(spark.read.format("binaryFile").options(**_PDF).load(folder), bucket)


def stream_inbox(
    spark: SparkSession, folder: str, bucket: str = INPUT_BUCKET, max_files: int = 10_000
) -> DataFrame:
    """The same folder, continuously. Each file is read once, tracked by the checkpoint."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(_BINARY)
        .options(**_PDF)
        .option("maxFilesPerTrigger", max_files)
        .load(folder)
    )
    return _objects(files, bucket)
