"""Output, error and job tables."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.functions import keys as K
from docledger.operators import jobs as J
from docledger.operators.objects import (
    OBJECT_SLOTS,
    SLOT_PREFIX,
    STORED_AT,
    with_key_slot,
)
from docledger.sources.ledger import BATCH, RUN, Ledger, delete


#: Documents and XML repeat their words and elements: about half the bytes of the default codec.
CODEC = "zstd"


def outputs_of(processed: DataFrame) -> DataFrame:
    """XML objects of the successful jobs."""
    return processed.where(F.col("status") == J.SUCCESS).select(
        F.col("output_bucket").alias("bucket"),
        F.col("output_object_key").alias("object_key"),
        F.lit(K.XML_TYPE).alias("content_type"),
        F.encode("xml", "UTF-8").alias("content"),
        "id",
        "started_at",
    )


def errors_of(processed: DataFrame) -> DataFrame:
    """A copy of each failed document and its report; nothing for missing objects."""
    failed = processed.where((F.col("status") != J.SUCCESS) & F.col("error_object_key").isNotNull())
    report = K.error_report(
        F.col("input_bucket"),
        F.col("input_object_key"),
        F.col("error_type"),
        F.col("error_message"),
    )
    return failed.select(
        "id",
        "error_bucket",
        "error_object_key",
        F.lit(K.PDF_TYPE).alias("content_type"),
        "content",
        "error_report_object_key",
        F.lit(K.JSON_TYPE).alias("report_content_type"),
        report.alias("report"),
    )


def started_jobs(events: DataFrame) -> DataFrame:
    """The first log row of every event's job; known before anything is read or parsed."""
    return J.jobs_create(
        events,
        J.job_id(F.col("bucket"), F.col("object_key"), F.col("event_id").cast("string")),
        F.col("bucket"),
        F.col("object_key"),
        F.col("received_at"),
    )


def finished_jobs(processed: DataFrame) -> DataFrame:
    """The last log row of every job."""
    done = J.SUCCESS == F.col("status")
    only_done = lambda name: F.when(done, F.col(name))
    return J.jobs_complete(
        processed,
        F.col("id"),
        F.col("status"),
        F.col("started_at"),
        F.col("completed_at"),
        output_bucket=only_done("output_bucket"),
        output_object_key=only_done("output_object_key"),
        invoice_number=F.col("invoice.number"),
        document_type=F.col("invoice.document_type"),
        line_count=F.size("invoice.lines"),
        error_bucket=F.col("error_bucket"),
        error_object_key=F.col("error_object_key"),
        error_report_object_key=F.col("error_report_object_key"),
        error_type=F.col("error_type"),
        error_message=F.col("error_message"),
        error_log=F.col("error_message"),
    )


def write_batch(df: DataFrame, path: str, run: str, batch_id: int, *partitions: str) -> None:
    """Write one batch of a run; writing it again replaces it, and no other run's rows."""
    (
        df.withColumns({RUN: F.lit(run), BATCH: F.lit(batch_id)})
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", CODEC)
        .partitionBy(RUN, BATCH, *partitions)
        .parquet(path)
    )


def output_ledger(path: str) -> Ledger:
    """The output objects under a path: of several for one key the job that started last counts."""
    return Ledger(path, ("bucket", "object_key"), ("started_at", "id"), ("bucket",))


def write_outputs(processed: DataFrame, path: str, run: str, batch_id: int = 0) -> None:
    """Append the output objects of a batch; ``last_outputs`` tells which of several for one key counts."""
    write_batch(outputs_of(processed), path, run, batch_id, *output_ledger(path).partitions)


def last_outputs(spark: SparkSession, path: str) -> DataFrame:
    """The last output of every key over all batches and runs, as an object store would hold them."""
    return output_ledger(path).latest(spark).drop(RUN, BATCH)


def write_errors(processed: DataFrame, path: str, run: str, batch_id: int = 0) -> None:
    write_batch(errors_of(processed), path, run, batch_id)


def write_started(events: DataFrame, path: str, run: str, batch_id: int = 0) -> None:
    """Jobs as PROCESSING, from events with their buckets; call it before the documents are parsed."""
    write_batch(started_jobs(events).withColumn("phase", F.lit(0)), path, run, batch_id, "phase")


def write_jobs(processed: DataFrame, path: str, run: str, batch_id: int = 0) -> None:
    """Final rows of the jobs."""
    write_batch(finished_jobs(processed).withColumn("phase", F.lit(1)), path, run, batch_id, "phase")


def job_log(spark: SparkSession, path: str) -> DataFrame:
    """The log rows that ``write_started`` and ``write_jobs`` wrote."""
    return spark.read.parquet(path).drop(RUN, BATCH, "phase")


def write_objects(
    objects: DataFrame, path: str, slots: int = OBJECT_SLOTS, append: bool = False
) -> None:
    """Object table partitioned by key slot, for ``resolve_objects``.

    One bucket may hold most objects, so slots are by key, not by bucket. Rows are
    gathered per slot; a slot spreads over many tasks when it is large (AQE rebalance).
    ``append`` adds objects to the table; of several for one key the last written counts.
    """
    name = f"{SLOT_PREFIX}{slots}"
    stamped = objects.withColumn(STORED_AT, F.lit(time.time_ns()))
    slotted = with_key_slot(stamped, slots).hint("rebalance", name)
    writer = slotted.write.mode("append" if append else "overwrite").option("compression", CODEC)
    writer.partitionBy(name).parquet(path)


DRAFT = "draft string, target string"


def export_files(outputs: DataFrame, folder: str) -> None:
    """One file per object under a folder all executors share; all appear at the end, or none.

    Tasks write drafts, and Spark commits the table that names them, so attempts that were lost or
    doubled are in no row of it. A second job renames the named drafts; it may run again, as a draft that is
    gone is a file that is there. Of several rows with one key any one's content stays. Rows without bucket
    or content have no file.
    """
    spark = outputs.sparkSession
    root = f"{folder.rstrip('/')}/_drafts-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        own = f"{root}/files/{uuid.uuid4().hex}"
        store, path = fs.FileSystem.from_uri(own)
        store.create_dir(path, recursive=True)
        n = 0
        for batch in batches:
            drafts = []
            for content in batch.column("content"):
                with store.open_output_stream(f"{path}/{n}") as file:
                    file.write(content.as_buffer())
                drafts.append(f"{own}/{n}")
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array(drafts, pa.string()), batch.column("target")], names=["draft", "target"])

    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        made: set[str] = set()
        for batch in batches:
            for draft, target in zip(*(c.to_pylist() for c in batch.columns)):
                source, goal = fs.FileSystem.from_uri(draft)[1], f"{top.rstrip('/')}/{target}"
                parent = goal.rpartition("/")[0]
                if parent not in made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                if store.get_file_info(source).type == fs.FileType.File:
                    store.move(source, goal)
            yield batch.slice(0, 0)

    target = F.concat("bucket", F.lit("/"), K.safe_key(F.col("object_key")))
    safe = outputs.select(target.alias("target"), F.col("content").cast("binary").alias("content"))
    try:
        drafts = safe.where("target is not null and content is not null").mapInArrow(write, DRAFT)
        drafts.write.parquet(f"{root}/named")
        named = spark.read.schema(DRAFT).parquet(f"{root}/named")
        named.mapInArrow(publish, DRAFT).write.format("noop").mode("overwrite").save()
    finally:
        delete(spark, root)
