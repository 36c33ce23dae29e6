import datetime
import os
import re
from pathlib import Path

from pyspark.sql import functions as F

from docledger.operators import jobs as J
from docledger.operators import objects as O
from docledger.operators.extensions import drop_copies
from docledger.operators.lines import assemble_pages, document_lines, page_lines
from docledger.operators.objects import resolve_objects
from docledger.plans.queries.ingest import _processed, _upload_events
from docledger.plans.queries.parse import broken_documents
from docledger.schemas import MAIL
from docledger.sources import events as E
from docledger.sources import inbox, mail, sinks
from docledger.streaming import jobs as S
from conftest import SF_DIR
from tests_data import EU, RECEIPT

T0 = datetime.datetime(2026, 1, 1, 10, 0, 0)


def test_job_log(spark):
    df = spark.createDataFrame([("j1", T0)], "id string, at timestamp")
    start = J.jobs_create(df, F.col("id"), F.lit("inv-input"), F.lit("a.pdf"), F.col("at"))
    end = J.jobs_complete(
        df, F.col("id"), F.lit("SUCCESS"), F.col("at"),
        F.col("at") + F.expr("INTERVAL 2500 MILLISECONDS"),
        output_bucket=F.lit("inv-output"), output_object_key=F.lit("a.xml"),
        invoice_number=F.lit("N"), document_type=F.lit("invoice"), line_count=F.lit(2),
    )
    jobs = J.latest_jobs(start.unionByName(end).unionByName(end))
    (job,) = J.jobs_get(J.with_links(jobs), "j1").collect()
    assert (job["status"], job["input_object_key"], job["duration_ms"]) == ("SUCCESS", "a.pdf", 2500)
    assert (job["output_url"], job["error_url"]) == ("/objects/j1/output", None)
    assert [tuple(r) for r in J.jobs_counts(jobs).collect()] == [("SUCCESS", 1)]
    assert J.jobs_recent(jobs, 0).count() == 1
    kinds = {r["kind"] for r in J.object_locations(jobs).collect()}
    assert kinds == {"input", "output"}


def test_events_and_objects(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"bucket":"b","object_key":"k"}\n{"object_key":"z"}\n{bad\n{}\n')
    good, dead = E.split_events(E.read_events(spark, str(tmp_path)))
    assert dead.count() == 2
    objects = spark.createDataFrame([("b", "k", b"x"), ("b", "q", b"y")],
                                    "bucket string, object_key string, content binary")
    sinks.write_objects(objects, str(tmp_path / "objects"))
    slotted = spark.read.parquet(str(tmp_path / "objects"))
    for table in (objects, slotted):
        found, missing = resolve_objects(good, table)
        assert [r["object_key"] for r in found.collect()] == ["k"]
        assert [r["object_key"] for r in missing.collect()] == ["z"]


def test_mail(spark):
    message = ("<1>", "s@a.test", "invoices@any.test", "Invoice", T0,
               [("A.PDF", "application/pdf", b"1"), ("x.txt", "text/plain", b"2")])
    (row,) = mail.mail_objects(spark.createDataFrame([message], MAIL)).collect()
    assert row["object_key"] == "20260101-100000-A.PDF"
    assert (row["mailbox"], bytes(row["content"])) == ("invoices", b"1")


def test_inbox_stream_matches_batch(spark, tmp_path):
    folder, base = tmp_path / "in", str(tmp_path / "out")
    (folder / "deep").mkdir(parents=True)
    (folder / "a b.pdf").write_text(EU)
    (folder / "r.pdf").write_text(RECEIPT)
    (folder / "bad.pdf").write_text("hello")
    (folder / "skip.PDF").write_text(EU)
    (folder / "deep" / "skip.pdf").write_text(EU)
    scanned = {r["object_key"] for r in inbox.scan_inbox(spark, str(folder)).collect()}
    assert scanned == {"a b.pdf", "r.pdf", "bad.pdf"}
    for _ in range(2):  # the second run finds nothing new
        S.process_inbox_stream(
            inbox.stream_inbox(spark, str(folder)), base, str(tmp_path / "cp"), interval=None
        ).awaitTermination()
    jobs = J.latest_jobs(sinks.job_log(spark, f"{base}/jobs"))
    assert {(r["input_object_key"], r["status"]) for r in jobs.collect()} == {
        ("a b.pdf", "SUCCESS"), ("r.pdf", "SUCCESS"), ("bad.pdf", "PARSE_ERROR"),
    }
    outputs = spark.read.parquet(f"{base}/outputs")
    sinks.export_files(outputs, (tmp_path / "xml").as_uri())
    assert sorted(os.listdir(tmp_path / "xml" / "inv-output")) == ["a b.xml", "r.xml"]
    xml = Path(tmp_path / "xml" / "inv-output" / "r.xml").read_bytes()
    assert xml.startswith(b"<?xml version='1.0' encoding='utf-8'?>\n<Invoice ")
    (error,) = spark.read.parquet(f"{base}/errors").collect()
    assert error["error_report_object_key"] == "failed/bad.pdf.error.json"


def test_batch_write_is_repeatable(spark, tmp_path):
    df = spark.range(5).withColumn("bucket", F.lit("b"))
    for _ in range(2):
        for run, batch in (("a", 0), ("a", 1), ("b", 0)):
            sinks.write_batch(df, str(tmp_path / "t"), run, batch, "bucket")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 15


def test_processing_is_repeatable(spark):
    sf_dir = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    first = _processed(spark, sf_dir).select("id", "status", "xml")
    assert first.exceptAll(_processed(spark, sf_dir).select("id", "status", "xml")).count() == 0


def test_page_lines_agree_with_assembled_text(spark):
    pages = [("hot", n, f"line {n}\n\nPage {n}\nmore") for n in range(1, 2500)]
    pages += [("d2", 1, ""), ("d2", 2, "x"), ("d3", 1, None)]
    df = spark.createDataFrame(pages, "doc string, page int, text string")
    direct = page_lines(df, "doc", "page", "text", pages_per_group=100)
    whole = document_lines(assemble_pages(df, "doc", "page", "text"), "doc")
    whole = whole.withColumn("line_no", F.col("line_no").cast("bigint"))
    assert direct.count() == whole.count() == 2499 * 2 + 1
    assert direct.exceptAll(whole).count() == 0


EVENT = "event_id string, bucket string, object_key string, output_bucket string, received_at timestamp"


def test_event_stream_finds_objects_stored_after_its_start(spark, tmp_path):
    base, store = str(tmp_path / "out"), str(tmp_path / "objects")
    put = lambda key, text, append: sinks.write_objects(
        spark.createDataFrame([("inv-input", key, text.encode())], "bucket string, object_key string, content binary"),
        store, slots=8, append=append,
    )
    events = spark.createDataFrame([], EVENT)
    put("a.pdf", "hello", False)
    for key, text in (("a.pdf", EU), ("b.pdf", RECEIPT), ("B.PDF", EU)):
        put(key, text, True)
        event = spark.createDataFrame([(key, None, key, None, T0)], EVENT)
        event.write.mode("append").parquet(str(tmp_path / "events"))
        stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
        S.process_event_stream(stream, store, base, str(tmp_path / "cp"), interval=None).awaitTermination()
    log = sinks.job_log(spark, f"{base}/jobs")
    assert log.where("status = 'PROCESSING'").count() == 3
    assert {(r["input_object_key"], r["status"]) for r in J.latest_jobs(log).collect()} == {
        ("a.pdf", "SUCCESS"), ("b.pdf", "SUCCESS"), ("B.PDF", "SUCCESS"),
    }


def test_only_the_slots_of_the_events_are_read(spark, tmp_path):
    store = str(tmp_path / "objects")
    objects = spark.range(200).select(
        F.lit("b").alias("bucket"), F.col("id").cast("string").alias("object_key"), F.lit(b"x").alias("content")
    )
    sinks.write_objects(objects, store, slots=64)
    events = spark.createDataFrame([("b", "7"), ("b", "7"), ("b", "none")], "bucket string, object_key string")
    found, missing = resolve_objects(events, spark.read.parquet(store))
    assert (found.count(), missing.count()) == (2, 1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and re.search(r"key_slot_64#\d+ (IN|=)", plan)


def test_last_job_wins_an_output_key(spark, tmp_path):
    rows = [("1", "SUCCESS", "o", "a.xml", "<old/>", T0), ("2", "SUCCESS", "o", "a.xml", "<new/>", T0 + datetime.timedelta(1))]
    processed = spark.createDataFrame(
        rows, "id string, status string, output_bucket string, output_object_key string, xml string, started_at timestamp"
    )
    sinks.write_outputs(processed, str(tmp_path / "t"), "run")
    (row,) = sinks.last_outputs(spark, str(tmp_path / "t")).collect()
    assert bytes(row["content"]) == b"<new/>" and row["id"] == "2"


def test_rows_without_content_are_no_copies(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a")], "id int, t string")
    assert {r["id"] for r in drop_copies(df, "id", "t").collect()} == {1, 2, 3}


def test_drop_copies_of_one_hot_text(spark):
    df = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 > 0, "same").otherwise(F.col("id").cast("string")).alias("t")
    )
    kept = {r["id"] for r in drop_copies(df, "id", "t").collect()}
    assert kept == {i for i in range(3000) if i % 3 == 0} | {1}


def test_an_object_named_by_half_of_all_events_keeps_tasks_even(spark, monkeypatch):
    monkeypatch.setattr(O, "HOT_EVENTS", 200)
    key = F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string"))
    events = spark.range(8000).select(F.lit("b").alias("bucket"), key.alias("object_key"), F.col("id").alias("event_id"))
    events = events.unionByName(spark.createDataFrame([("b", None, -1), (None, "hot", -2), ("b", "none", -3)], "bucket string, object_key string, event_id long"))
    names = ["hot", *map(str, range(1, 8000, 2)), "other"]
    objects = spark.createDataFrame([("b", n, n.encode()) for n in names], "bucket string, object_key string, content binary")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        met = O.attach_objects(events, objects)
        assert met.columns == [*events.columns, "content", "found"]
        sizes = [r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 8003 and max(sizes) < 1200
        rows = {r["event_id"]: (r["found"], r["content"] and bytes(r["content"]).decode()) for r in met.collect()}
        found, missing = O.resolve_objects(events, objects)
        assert (found.count(), missing.count()) == (8000, 3)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert rows.pop(-1) == rows.pop(-2) == rows.pop(-3) == (False, None)
    assert all(rows[i] == (True, "hot" if i % 2 == 0 else str(i)) for i in range(8000))


def test_contents_move_once_where_no_key_is_hot(spark):
    named = [("b", str(i % 20), i) for i in range(50)]
    events = spark.createDataFrame(named, "bucket string, object_key string, event_id long")
    rows = [("b", str(k), f"{k}-{at}".encode(), at) for k in range(15) for at in (1, 2)] + [(None, "3", b"none", 3)]
    objects = spark.createDataFrame(rows, "bucket string, object_key string, content binary, stored_at long")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        met = O.attach_objects(events, objects)
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"- (?:Reused)?Exchange\b", plan)) <= 3  # events, their keys, and objects
        found = {r["event_id"]: (r["found"], r["content"] and bytes(r["content"])) for r in met.collect()}
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert found == {i: (True, f"{i % 20}-2".encode()) if i % 20 < 15 else (False, None) for i in range(50)}


def test_events_of_the_queries_do_not_join_orders_again(spark):
    docs = broken_documents(spark, SF_DIR)
    events = _upload_events(docs)
    plan = events._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "o_orderkey" not in plan
    keys = [r["doc_key"] for r in docs.select("doc_key").collect()]
    want = [*keys, *(f"x{k}" for k in keys if int(k) % 10 == 0)]
    assert sorted(r["event_id"] for r in events.collect()) == sorted(want)


def test_written_contents_are_zstd(spark, tmp_path):
    import pyarrow.parquet as pq

    rows = [("b", f"{i}.pdf", f"line {i}\n".encode() * 50) for i in range(20)]
    objects = spark.createDataFrame(rows, "bucket string, object_key string, content binary")
    sinks.write_objects(objects, str(tmp_path / "objects"), slots=2)
    sinks.write_batch(objects, str(tmp_path / "log"), "run", 0)
    files = list(tmp_path.rglob("*.parquet"))
    codecs = {pq.ParquetFile(f).metadata.row_group(0).column(i).compression for f in files for i in (0, 1, 2)}
    assert codecs == {"ZSTD"} and {p.name for p in (tmp_path / "log").rglob("run_id=run")} == {"run_id=run"}
    for folder in ("objects", "log"):
        back = spark.read.parquet(str(tmp_path / folder)).select("bucket", "object_key", "content")
        assert sorted((r[0], r[1], bytes(r[2])) for r in back.collect()) == sorted(rows)
