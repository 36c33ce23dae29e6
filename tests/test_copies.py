"""Copies on streams: hot keys, rows without a key, late copies and batches that run again."""

import hashlib
from collections import Counter

from pyspark.sql import functions as F

from docledger.plans.queries import QUERIES
from docledger.streaming import copies
from docledger.streaming.jobs import trigger

SCHEMA = "id long, hash string"


def test_first_rows_over_batches(spark, tmp_path):
    path, index = str(tmp_path / "kept"), str(tmp_path / "seen")
    batches = [
        [(5, "a"), (3, "a"), (9, None), (9, None), (7, "b")] + [(100 + i, "hot") for i in range(500)],
        [(1, "a"), (2, "c"), (2, "c"), (10, None), (99, "hot")],
        [(0, "c"), (11, "d"), (12, "b")],
    ]
    want = [[3, 9, 9, 7, 100], [2, 10], [11]]
    for n, rows in enumerate(batches):
        for _ in range(2):  # the second time as after a failure
            copies.write_first(spark.createDataFrame(rows, SCHEMA).repartition(4), "hash", "id", path, index, "r", n)
        kept = spark.read.parquet(path).where(F.col("batch_id") == n)
        assert Counter(r["id"] for r in kept.collect()) == Counter(want[n])
        if n == 1:
            copies.index_ledger(index, "hash").compact(spark)
            copies.index_ledger(index, "hash").prune(spark, keep=0)
    seen = copies.index_ledger(index, "hash").rows(spark)
    assert sorted(r["hash"] for r in seen.collect()) == ["a", "b", "c", "d", "hot"]


def test_first_rows_of_an_empty_batch(spark, tmp_path):
    path, index = str(tmp_path / "kept"), str(tmp_path / "seen")
    copies.write_first(spark.createDataFrame([(1, "a")], SCHEMA), "hash", "id", path, index, "r", 0)
    copies.write_first(spark.createDataFrame([], SCHEMA), "hash", "id", path, index, "r", 1)
    copies.write_first(spark.createDataFrame([(2, None), (0, "a")], SCHEMA), "hash", "id", path, index, "r", 2)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 2]


def test_the_index_is_not_dealt_out_and_only_its_slots_are_read(spark, tmp_path):
    path, index = str(tmp_path / "kept"), str(tmp_path / "seen")
    rows = spark.range(2000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    copies.write_first(rows, "hash", "id", path, index, "r", 0)
    ledger = copies.index_ledger(index, "hash")
    batch = rows.where("id = 7").select("hash")
    slots = [r[0] for r in batch.select(copies._slot("hash", copies.INDEX_SLOTS)).collect()]
    seen = ledger.rows(spark).where(F.col(copies.SLOT).cast("int").isin(slots))
    known = seen.join(batch, "hash", "left_semi")
    assert known.count() == 1
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "PartitionFilters: [" in plan and copies.SLOT in plan


def test_stream_keeps_rows_without_a_key_and_one_of_a_hot_key(spark, tmp_path):
    rows = spark.range(6000).select(
        "id",
        F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 10 > 1, F.col("id").cast("string")).alias("hash"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 50).alias("at"),
    )
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    kept = copies.drop_copies_stream(stream, "hash", "at", "1 hour")
    assert kept.columns == ["id", "hash", "at"]
    writer = kept.writeStream.option("checkpointLocation", str(tmp_path / "cp"))
    query = trigger(writer, None).format("parquet").start(str(tmp_path / "out"))
    query.awaitTermination()
    found = Counter(r["hash"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert found.pop(None) == 600 and found["hot"] == 1 and set(found.values()) == {1} and len(found) == 2401
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3001


def test_stream_of_a_table_that_is_a_folder(spark, tmp_path):
    rows = [(i, f"text {i % 7}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["drop_copies_stream"](spark, str(tmp_path))
    assert Counter(r["hash"] for r in found.collect()) == Counter(
        hashlib.sha256(f"text {i}".encode()).hexdigest() for i in range(7)
    )
