"""Continuous processing of upload events and live job state."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docledger.functions.keys import OUTPUT_BUCKET
from docledger.operators.jobs import PROCESSING, jobs_counts, latest_jobs
from docledger.operators.objects import attach_objects, with_event_defaults
from docledger.plans.pipeline import process_attached
from docledger.sources import sinks
from docledger.sources.ledger import Ledger

POLL_INTERVAL = "30 seconds"  # fixed value: default poll interval
FORGET_AFTER = "1 hour"
STATE_SLOTS = 4096  # a checkpoint keeps to its number
COMPACT_EVERY = 100
EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def trigger(writer: DataStreamWriter, interval: str | None = POLL_INTERVAL) -> DataStreamWriter:
    """Poll at an interval, or with None work off what is there and stop."""
    if interval is None:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=interval)


def run_of(checkpoint: str) -> str:
    """Name of a stream's run: batch numbers start again only with another checkpoint."""
    return hashlib.sha256(checkpoint.encode()).hexdigest()[:16]


def _write_batch(
    attached: Callable[[], DataFrame], events: DataFrame, base: str, run: str, batch_id: int
) -> None:
    """PROCESSING rows, then one table of results, then the three tables derived from it.

    The result table is in the shared folder, so a lost executor costs no second parse.
    """
    sinks.write_started(events, f"{base}/jobs", run, batch_id)
    clock = F.lit(datetime.now(UTC))
    path = f"{base}/processed/run_id={run}/batch_id={batch_id}"
    done = process_attached(attached(), clock)
    done.write.mode("overwrite").option("compression", sinks.CODEC).parquet(path)
    processed = events.sparkSession.read.parquet(path)
    sinks.write_outputs(processed, f"{base}/outputs", run, batch_id)
    sinks.write_errors(processed, f"{base}/errors", run, batch_id)
    sinks.write_jobs(processed, f"{base}/jobs", run, batch_id)


def process_batch(
    batch: DataFrame, objects: str | DataFrame, base: str, run: str, batch_id: int
) -> None:
    """Outputs, errors and job rows of one batch, each replaced if the batch runs again.

    ``objects`` as a path is opened now, so objects stored since the last batch are found.
    """
    held = batch.sparkSession.read.parquet(objects) if isinstance(objects, str) else objects
    events = with_event_defaults(batch)
    _write_batch(lambda: attach_objects(events, held), events, base, run, batch_id)


def process_event_stream(
    events: DataFrame,
    objects: str | DataFrame,
    base: str,
    checkpoint: str,
    interval: str | None = POLL_INTERVAL,
):
    """Start the event stream; see ``process_events`` for the columns.

    Give ``objects`` as the path of a table that ``write_objects`` keeps adding to; a DataFrame
    is for a store that no longer changes.
    """
    writer = events.writeStream.option("checkpointLocation", checkpoint)
    return trigger(writer, interval).foreachBatch(
        lambda batch, batch_id: process_batch(batch, objects, base, run_of(checkpoint), batch_id)
    ).start()


def process_inbox_stream(
    files: DataFrame, base: str, checkpoint: str, interval: str | None = POLL_INTERVAL
):
    """Folder to outputs: a file that was read is its own event and object."""

    def batch(df: DataFrame, batch_id: int) -> None:
        # The file that was read is both the event and its object: nothing to join.
        attached = df.select(
            F.col("object_key").alias("event_id"),
            "bucket",
            "object_key",
            F.lit(OUTPUT_BUCKET).alias("output_bucket"),
            F.col("modification_time").alias("received_at"),
            "content",
            F.lit(True).alias("found"),
        )
        _write_batch(lambda: attached, attached.drop("content"), base, run_of(checkpoint), batch_id)

    writer = files.writeStream.option("checkpointLocation", checkpoint)
    return trigger(writer, interval).foreachBatch(batch).start()


def status_changes(log: DataFrame, forget_after: str = FORGET_AFTER) -> DataFrame:
    """(id, status, seq) whenever a job's latest status changes.

    A job with very many rows is reduced to one for each Arrow batch before its rows are dealt out, and
    state holds one status and one number per job. Jobs share their state in ``STATE_SLOTS`` slots by a hash of
    the id, as a call of Python for each job costs far more than the work in it. A job that has ended leaves
    it ``forget_after`` later; a row of it that comes later still is reported again, and its number decides who was
    last. A checkpoint of the time when each job had its own state can't be continued.
    """
    wait = int(_milliseconds(forget_after))
    open_status = PROCESSING

    # Functions made here travel with their code: executors need not have this package.
    def newest_of_batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            yield rows.sort_values("seq", kind="stable").drop_duplicates("id", keep="last")

    def changed(
        key: tuple[int], frames: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        # Per job its status, number and the time it is forgotten, 0 while it is open.
        known = {id: job for id, *job in zip(*state.get)} if state.exists else {}
        newest = {}
        for rows in () if state.hasTimedOut else frames:
            for id, status, seq in zip(rows["id"], rows["status"], rows["seq"].tolist()):
                job = newest.get(id) or known.get(id)
                if job is None or seq > job[1]:
                    newest[id] = [status, seq, 0]
                elif id not in newest:
                    newest[id] = [*job[:2], 0]
        changes = [(id, *job[:2]) for id, job in newest.items() if known.get(id, ())[:2] != job[:2]]
        for job in newest.values():
            job[2] = 0 if job[0] == open_status else now + wait
        held = {id: job for id, job in known.items() if job[2] == 0 or job[2] > now} | newest
        if held:
            state.update(([*held], *map(list, zip(*held.values()))))
            ends = [job[2] for job in held.values() if job[2]]
            if ends:
                state.setTimeoutDuration(max(min(ends) - now, 1))
        else:
            state.remove()
        if changes:
            yield pd.DataFrame(changes, columns=["id", "status", "seq"])

    set_rows = log.select("id", "status", "seq").where("status is not null and seq is not null")
    reduced = set_rows.mapInPandas(newest_of_batches, "id string, status string, seq long")
    slot = F.pmod(F.xxhash64("id"), F.lit(STATE_SLOTS)).cast("int")
    return reduced.withColumn("slot", slot).groupBy("slot").applyInPandasWithState(
        changed,
        "id string, status string, seq long",
        "id array<string>, status array<string>, seq array<long>, until array<long>",
        "update",
        GroupStateTimeout.ProcessingTimeTimeout,
    )


def _milliseconds(duration: str) -> float:
    """A span such as "1 hour" or "30 seconds"."""
    number, unit = duration.split()
    return float(number) * {"second": 1e3, "minute": 6e4, "hour": 36e5, "day": 864e5}[unit.rstrip("s")]


def status_ledger(path: str) -> Ledger:
    return Ledger(path, ("id",), ("seq",))


def status_latest_stream(
    log: DataFrame,
    path: str,
    checkpoint: str,
    interval: str | None = POLL_INTERVAL,
    forget_after: str = FORGET_AFTER,
    compact_every: int = COMPACT_EVERY,
):
    """Keep the latest status of every job under ``path``: each batch appends the jobs that changed.

    State is bounded by the open jobs and those that ended lately, on disk in RocksDB. Every
    ``compact_every`` batches the changes are folded into a snapshot, so a reader merges it with a
    short tail.
    """
    spark = log.sparkSession
    ledger = status_ledger(path)

    def append(df: DataFrame, batch_id: int) -> None:
        sinks.write_batch(df, path, run_of(checkpoint), batch_id)
        if (batch_id + 1) % compact_every == 0:
            ledger.compact(df.sparkSession)

    changes = status_changes(log, forget_after)
    writer = changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    # Jobs are forgotten along with the next changes; batches without any would follow one another.
    with _settings(spark, {STATE_STORE: ROCKSDB, EMPTY_BATCHES: "false"}):
        return trigger(writer, interval).foreachBatch(append).start()


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings that a query takes over when it starts, put back afterwards."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def status_latest(spark: SparkSession, path: str) -> DataFrame:
    """Current status per job out of what ``status_latest_stream`` wrote: snapshot and tail."""
    return latest_jobs(status_ledger(path).rows(spark), columns=["status"])


def status_counts_live(spark: SparkSession, path: str) -> DataFrame:
    """Jobs per status, counted on the latest status and not on every transition."""
    return jobs_counts(status_latest(spark, path))
