"""Copies on streams: within a time span by state, for ever by an index of what was seen."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.sources import sinks
from docledger.sources.ledger import Ledger
from docledger.streaming.jobs import POLL_INTERVAL, run_of, trigger

INDEX_SLOTS = 64
COMPACT_EVERY = 100
SLOT = "key_slot"


def drop_copies_stream(df: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Drop copies that arrive within ``delay`` of each other; rows without a key are no copies.

    A key that very many rows share is reduced to one row for each Arrow batch of a task before the rows
    are dealt out by key, so its state's task gets few of them.
    """
    schema, columns = df.schema, df.columns

    def first_of_batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            yield rows[rows[key].isna() | ~rows.duplicated(key)]

    single = "_copy_key"
    reduced = df.mapInPandas(first_of_batches, schema)
    keyed = reduced.withColumn(single, F.coalesce(F.col(key).cast("string"), F.uuid()))
    return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark([single]).select(*columns)


def index_ledger(path: str, key: str) -> Ledger:
    """The keys seen so far, each once in a snapshot, by slots of their hash."""
    return Ledger(path, (key,), (), (SLOT,))


def _slot(key: str, slots: int):
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def write_first(
    batch: DataFrame, key: str, order: str, path: str, index: str, run: str, batch_id: int, slots: int = INDEX_SLOTS
) -> None:
    """Append the rows of a batch whose key no earlier batch had, of equal keys the one of least ``order``.

    Keys are reduced on the map side, so one key may have most rows. The index is read in the batch's
    slots only and meets the batch's keys, which the planner broadcasts where they are few; its rows are never
    dealt out. A batch that runs again replaces its rows and its keys, and does not see its own keys.
    """
    spark = batch.sparkSession
    named = batch.where(F.col(key).isNotNull())
    least = named.groupBy(key).agg(F.min(order).alias("_least")).withColumn(SLOT, _slot(key, slots))
    ledger = index_ledger(index, key)
    if _written(spark, ledger):
        # At most as many as there are slots.
        wanted = [r[0] for r in least.select(SLOT).distinct().collect()]
        earlier = ~((F.col("run_id") == run) & (F.col("batch_id") >= batch_id))
        seen = ledger.rows(spark).where(F.col(SLOT).cast("int").isin(wanted) & earlier).select(key)
        known = seen.join(least.select(key), key, "left_semi").distinct()
        least = least.join(known, key, "left_anti")
    first = named.join(least.select(key, F.col("_least").alias(order)), [key, order], "left_semi")
    # Rows equal in key and order are copies of each other as well.
    first = first.dropDuplicates([key])
    kept = first.unionByName(batch.where(F.col(key).isNull()))
    sinks.write_batch(kept, path, run, batch_id)
    # The kept rows are on disk now: the index takes its keys from them, not from the sources again.
    own = (F.col("run_id") == run) & (F.col("batch_id") == batch_id)
    keys = spark.read.parquet(path).where(own & F.col(key).isNotNull()).select(key)
    sinks.write_batch(keys.withColumn(SLOT, _slot(key, slots)), index, run, batch_id, SLOT)


def _written(spark: SparkSession, ledger: Ledger) -> bool:
    return ledger.has_batches(spark) or ledger.newest(spark) is not None


def first_rows_stream(
    df: DataFrame,
    key: str,
    order: str,
    path: str,
    index: str,
    checkpoint: str,
    interval: str | None = POLL_INTERVAL,
    compact_every: int = COMPACT_EVERY,
):
    """Keep the first row of every key for ever under ``path``, however late its copies come.

    Needs no state: what was seen is the index, which is compacted every ``compact_every`` batches.
    Rows without a key are all kept.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        write_first(batch, key, order, path, index, run_of(checkpoint), batch_id)
        if (batch_id + 1) % compact_every == 0:
            index_ledger(index, key).compact(batch.sparkSession)

    writer = df.writeStream.option("checkpointLocation", checkpoint)
    return trigger(writer, interval).foreachBatch(append).start()
