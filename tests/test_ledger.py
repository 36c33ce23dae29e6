"""Last write wins over batches, runs and snapshots; live status forgets finished jobs."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from docledger.operators import jobs as J
from docledger.sources import sinks
from docledger.sources.ledger import Ledger, last_rows
from docledger.streaming import jobs as S

T0 = datetime.datetime(2026, 1, 1, 10, 0, 0)
ROW = "k string, n int, v string"


def test_last_rows_keep_rows_without_a_key(spark):
    df = spark.createDataFrame(
        [("a", 1, "x"), ("a", 2, "y"), ("b", None, "z"), ("b", 0, "w"), (None, 1, "p"), (None, 1, "p")], ROW
    )
    assert sorted(map(tuple, last_rows(df, ["k"], ["n"]).collect()), key=str) == sorted(
        [("a", 2, "y"), ("b", 0, "w"), (None, 1, "p"), (None, 1, "p")], key=str
    )


def test_only_keys_decide_and_contents_of_single_writes_stay(spark):
    """The exchange of the decision carries the key alone."""
    df = spark.range(100).select((F.col("id") % 99).alias("k"), F.col("id").alias("n"), F.lit("content").alias("v"))
    plan = last_rows(df, ["k"], ["n"])._jdf.queryExecution().optimizedPlan().toString()
    decided = [line for line in plan.splitlines() if "Aggregate" in line and "count" in line]
    assert decided and all("content" not in line for line in decided)


@pytest.fixture
def ledger(tmp_path):
    return Ledger(str(tmp_path / "log"), ("k",), ("n",))


def put(spark, ledger, rows, run, batch):
    sinks.write_batch(spark.createDataFrame(rows, ROW), ledger.path, run, batch)


def latest(spark, ledger):
    return {(r["k"], r["v"]) for r in ledger.latest(spark).collect()}


def test_ledger_over_runs_snapshots_and_tail(spark, ledger):
    put(spark, ledger, [("a", 1, "a1"), ("b", 1, "b1")], "10", 0)
    put(spark, ledger, [("a", 3, "a3")], "2", 0)
    put(spark, ledger, [("a", 2, "a2"), ("c", 1, "c1")], "10", 1)
    want = {("a", "a3"), ("b", "b1"), ("c", "c1")}
    assert latest(spark, ledger) == want
    ledger.compact(spark)
    assert latest(spark, ledger) == want and ledger.rows(spark).count() == 3
    put(spark, ledger, [("b", 1, "tie of a later batch"), ("d", 0, "d0")], "10", 2)
    put(spark, ledger, [("e", 0, "new run")], "3", 0)
    want = {("a", "a3"), ("b", "tie of a later batch"), ("c", "c1"), ("d", "d0"), ("e", "new run")}
    assert latest(spark, ledger) == want
    ledger.compact(spark)
    ledger.compact(spark)  # with nothing new
    assert latest(spark, ledger) == want
    ledger.prune(spark, keep=0)
    assert latest(spark, ledger) == want and ledger.rows(spark).count() == 5
    put(spark, ledger, [("a", 9, "a9")], "10", 3)
    assert latest(spark, ledger) == want - {("a", "a3")} | {("a", "a9")}


def test_an_unfinished_snapshot_does_not_count(spark, ledger, tmp_path):
    put(spark, ledger, [("a", 1, "a1")], "r", 0)
    (tmp_path / "log.snapshots" / "000000000000-dead" / "rows").mkdir(parents=True)
    assert latest(spark, ledger) == {("a", "a1")}
    ledger.compact(spark)
    assert latest(spark, ledger) == {("a", "a1")}


def test_outputs_of_several_batches(spark, tmp_path):
    schema = "id string, status string, output_bucket string, output_object_key string, xml string, started_at timestamp"
    path = str(tmp_path / "out")
    for batch, (name, xml, hours) in enumerate([("1", "<old/>", 1), ("2", "<new/>", 5), ("3", "<late/>", 2)]):
        row = (name, "SUCCESS", "o", "a.xml", xml, T0 + datetime.timedelta(hours=hours))
        failed = ("x" + name, "ERROR", "o", "b.xml", None, T0)
        sinks.write_outputs(spark.createDataFrame([row, failed], schema), path, "run", batch)
        if batch == 1:
            sinks.output_ledger(path).compact(spark)
    (row,) = sinks.last_outputs(spark, path).collect()
    assert (row["object_key"], bytes(row["content"]), row["id"]) == ("a.xml", b"<new/>", "2")


LOG = "id string, status string, seq long"


def run_status(spark, tmp_path, rows, **options):
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(LOG).parquet(str(tmp_path / "log"))
    query = S.status_latest_stream(stream, str(tmp_path / "latest"), str(tmp_path / "cp"), None, **options)
    query.awaitTermination()
    return query.lastProgress["stateOperators"][0]["numRowsTotal"]


def statuses(spark, tmp_path):
    return {r["id"]: r["status"] for r in S.status_latest(spark, str(tmp_path / "latest")).collect()}


def test_finished_jobs_leave_the_state(spark, tmp_path):
    """State is bounded by open jobs; a late row of a forgotten job neither is lost nor wins."""
    options = {"forget_after": "1 second", "compact_every": 2}
    jobs = [f"j{i}" for i in range(40)]
    rows = [(j, J.PROCESSING, 0) for j in jobs] + [(j, J.SUCCESS, 1) for j in jobs[:30]]
    assert run_status(spark, tmp_path, [*rows, (None, "x", 1), ("j39", None, 5)], **options) <= 41
    time.sleep(1.5)
    assert run_status(spark, tmp_path, [("j35", J.PROCESSING, 0)] * 500, **options) <= 11
    time.sleep(1.5)
    left = run_status(spark, tmp_path, [("j0", J.PROCESSING, 0), ("j1", J.ERROR, 2), ("j36", J.ERROR, 1)], **options)
    assert left <= 13
    want = dict.fromkeys(jobs[:30], J.SUCCESS) | dict.fromkeys(jobs[30:], J.PROCESSING)
    want |= {"j1": J.ERROR, "j36": J.ERROR}
    found = statuses(spark, tmp_path)
    found.pop(None, None)
    assert found == want
    names = {"spark.sql.streaming.stateStore.providerClass"}
    assert all("RocksDB" not in (spark.conf.get(n, "") or "") for n in names)


def test_files_appear_all_or_none(spark, tmp_path):
    folder = tmp_path / "files"
    rows = [("b", f"d{i % 3}/f{i}.txt", bytes([i])) for i in range(30)] + [("b", "../x/./y.txt", b"up"), (None, "k", b""), ("b", "k", None)]
    df = spark.createDataFrame(rows, "bucket string, object_key string, content binary").repartition(4)
    broken = df.withColumn("content", F.when(F.col("object_key") == "d1/f16.txt", F.raise_error(F.lit("lost"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        sinks.export_files(broken, folder.as_uri())
    assert not [p for p in folder.rglob("*") if p.is_file()]
    for _ in range(2):
        sinks.export_files(df, folder.as_uri())
        found = {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*") if p.is_file()}
        assert {k: v for k, v in found.items() if "y.txt" not in k} == {f"b/d{i % 3}/f{i}.txt": bytes([i]) for i in range(30)}
        assert len(found) == 31 and all(".." not in k for k in found)


def test_jobs_share_python_calls_and_state(spark, tmp_path, monkeypatch):
    """Jobs of one slot keep a status each: late rows do not win, ended ones leave alone, groups are few."""
    monkeypatch.setattr(S, "STATE_SLOTS", 2)
    options = {"forget_after": "1 second", "compact_every": 2}
    jobs = [f"j{i}" for i in range(200)]
    rows = [(j, J.PROCESSING, 0) for j in jobs] + [(j, J.SUCCESS, 2) for j in jobs[:150]]
    assert run_status(spark, tmp_path, rows, **options) == 2
    late = [(j, J.ERROR, 1) for j in jobs[100:160]] + [("n1", J.PROCESSING, 0), (None, J.ERROR, 1)]
    assert run_status(spark, tmp_path, late, **options) == 2
    want = dict.fromkeys(jobs[:150], J.SUCCESS) | dict.fromkeys(jobs[150:], J.PROCESSING)
    want |= dict.fromkeys(jobs[150:160], J.ERROR) | {"n1": J.PROCESSING, None: J.ERROR}
    assert statuses(spark, tmp_path) == want
    written = spark.read.parquet(str(tmp_path / "latest"))
    assert written.where("batch_id = 1").count() == 12  # only jobs whose status changed
    time.sleep(1.5)
    ended = [(j, J.SUCCESS, 9) for j in [*jobs[160:], "n1"]]
    assert run_status(spark, tmp_path, ended, **options) == 2
    time.sleep(1.5)
    assert run_status(spark, tmp_path, [("j0", J.ERROR, 1)], **options) == 1  # all others are forgotten
    assert statuses(spark, tmp_path) == want | {id: J.SUCCESS for id, _, _ in ended}
