"""Sources, sinks, streams and mail."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from docledger.functions import keys as K
from docledger.operators import extensions as X
from docledger.operators.jobs import latest_jobs
from docledger.operators.lines import assemble_pages
from docledger.operators.objects import resolve_objects, with_event_defaults
from docledger.plans.pipeline import process_events
from docledger.plans.queries.base import facts_sql, query, text, work_folder
from docledger.plans.queries.invoices import XML_SQL
from docledger.plans.queries.jobs import _LOG, event_log
from docledger.plans.queries.parse import (
    ERROR_SQL,
    STATUS_SQL,
    TYPE_SQL,
    broken_documents,
)
from docledger.plans.queries.text import PAGE_SQL
from docledger.plans.render import table
from docledger.sources import events as E
from docledger.sources import inbox, mail, sinks, xml_compare
from docledger.streaming import copies
from docledger.streaming import jobs as S

# ---- folders ----

_INBOX_SQL = f"""SELECT 'inv-input' AS bucket, 'conv-' || conv_id || '.pdf' AS object_key,
  sha256(text) AS content_sha256 FROM ({PAGE_SQL})"""


def _fill_inbox(spark, sf) -> str:
    """A folder with one file per conversation; every name also exists as .PDF."""
    folder = work_folder(spark, "inbox")
    pages = table(spark, sf, "conversations").withColumn("page_no", F.col("turn") + 1)
    docs = assemble_pages(pages, "conv_id", "page_no", "text")
    name = F.concat(F.lit("conv-"), F.col("conv_id").cast("string"))
    files = docs.select(
        F.lit("in").alias("bucket"),
        F.explode(F.array(F.concat(name, F.lit(".pdf")), F.concat(name, F.lit(".PDF")))).alias(
            "object_key"
        ),
        F.encode("text", "UTF-8").alias("content"),
    )
    sinks.export_files(files, folder)
    return f"{folder}/in"


@query("scan_inbox", _INBOX_SQL)
def _(spark, sf):
    found = inbox.scan_inbox(spark, _fill_inbox(spark, sf))
    return found.select("bucket", "object_key", F.sha2("content", 256).alias("content_sha256"))


@query("stream_inbox", _INBOX_SQL)
def _(spark, sf):
    out = work_folder(spark, "stream-inbox")
    files = inbox.stream_inbox(spark, _fill_inbox(spark, sf)).select(
        "bucket", "object_key", F.sha2("content", 256).alias("content_sha256")
    )
    writer = files.writeStream.option("checkpointLocation", f"{out}/checkpoint")
    S.trigger(writer, None).format("parquet").start(f"{out}/objects").awaitTermination()
    return spark.read.parquet(f"{out}/objects")


# ---- events ----


def _raw_events(spark, sf):
    """Event texts; every seventh is cut off, every fifth has no bucket, some an empty one."""
    e = table(spark, sf, "events")
    n = F.col("event_id")
    bucket = F.when(n % 5 == 0, F.lit(None).cast("string")).when(n % 5 == 1, "").otherwise("b1")
    body = F.to_json(
        F.struct(
            bucket.alias("bucket"),
            F.concat(F.lit("doc-"), F.col("user_id").cast("string"), F.lit(".pdf")).alias(
                "object_key"
            ),
        )
    )
    cut = F.substr(body, F.lit(1), F.length(body) - 3)
    return e.select("event_id", F.when(n % 7 == 0, cut).otherwise(body).alias("value"))


@query(
    "read_events",
    """SELECT event_id, event_id % 7 = 0 AS malformed, CASE WHEN event_id % 7 = 0 THEN ''
      WHEN event_id % 5 > 1 THEN 'b1' ELSE '' END AS bucket,
      CASE WHEN event_id % 7 = 0 THEN '' ELSE 'doc-' || user_id || '.pdf' END AS object_key
      FROM events""",
)
def _(spark, sf):
    parsed = E.parse_events(_raw_events(spark, sf), "value")
    ok = ~F.col("malformed")
    return parsed.select(
        "event_id",
        "malformed",
        text(F.when(ok, F.col("bucket")), "bucket"),
        text(F.when(ok, F.col("object_key")), "object_key"),
    )


@query(
    "dead_letters",
    """SELECT event_id, raw FROM (SELECT event_id, CASE WHEN event_id % 5 = 0
        THEN '{"object_key":"doc-' || user_id || '.pdf"}'
        ELSE '{"bucket":"' || CASE WHEN event_id % 5 = 1 THEN '' ELSE 'b1' END
          || '","object_key":"doc-' || user_id || '.pdf"}' END AS body FROM events) t,
      LATERAL (SELECT substr(body, 1, length(body) - 3) AS raw) WHERE event_id % 7 = 0""",
)
def _(spark, sf):
    """What could not be read as an event is kept as it came."""
    _good, dead = E.split_events(E.parse_events(_raw_events(spark, sf), "value"))
    return dead.select("event_id", F.col("value").alias("raw"))


@query(
    "with_event_defaults",
    """SELECT event_id, CASE WHEN event_id % 5 > 1 THEN 'b1' ELSE 'inv-input' END AS bucket,
      'inv-output' AS output_bucket FROM events WHERE event_id % 7 <> 0""",
)
def _(spark, sf):
    good, _dead = E.split_events(E.parse_events(_raw_events(spark, sf), "value"))
    return with_event_defaults(good).select("event_id", "bucket", "output_bucket")


def _document_objects(spark, sf):
    return table(spark, sf, "documents").select(
        F.lit(K.INPUT_BUCKET).alias("bucket"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("object_key"),
        F.col("text").cast("binary").alias("content"),
    )


@query(
    "resolve_objects",
    """SELECT event_id, doc_id IS NOT NULL AS found,
      CAST(coalesce(strlen(text), -1) AS BIGINT) AS bytes
      FROM events LEFT JOIN documents ON doc_id = user_id""",
)
def _(spark, sf):
    events = table(spark, sf, "events").select(
        "event_id",
        F.lit(K.INPUT_BUCKET).alias("bucket"),
        F.concat(F.lit("doc-"), F.col("user_id").cast("string"), F.lit(".pdf")).alias("object_key"),
    )
    sizes = _document_objects(spark, sf).withColumn("content", F.octet_length("content"))
    found, missing = resolve_objects(events, sizes)
    return found.select(
        "event_id", F.lit(True).alias("found"), F.col("content").cast("bigint").alias("bytes")
    ).unionByName(
        missing.select(
            "event_id", F.lit(False).alias("found"), F.lit(-1).cast("bigint").alias("bytes")
        )
    )


@query(
    "build_events",
    """SELECT '{"bucket":"inv-input","object_key":"doc-' || doc_id || '.pdf"}' AS event
      FROM documents""",
)
def _(spark, sf):
    return E.build_events(_document_objects(spark, sf)).select("event")


# ---- mail ----


def _mail(spark, sf):
    """One message per document: its text twice as PDF (in two spellings) and a note."""
    d = table(spark, sf, "documents")
    number = F.col("doc_id").cast("string")

    def attachment(name, kind, content):
        return F.struct(
            name.alias("filename"),
            F.lit(kind).alias("content_type"),
            content.cast("binary").alias("content"),
        )

    return d.select(
        F.concat(F.lit("<m"), number, F.lit("@mail.test>")).alias("message_id"),
        F.concat("source", F.lit("@supplier.test")).alias("from_addr"),
        F.concat("lang", F.lit("-invoices@any.test")).alias("to_addr"),
        F.timestamp_seconds(F.lit(1700000000) + F.col("doc_id") * 3607).alias("received_at"),
        F.array(
            attachment(F.concat(F.lit("a"), number, F.lit(".pdf")), K.PDF_TYPE, F.col("text")),
            attachment(F.concat(F.lit("b"), number, F.lit(".PDF")), K.PDF_TYPE, F.col("text")),
            attachment(F.lit("note.pdf.txt"), "text/plain", F.col("source")),
        ).alias("attachments"),
    )


_MAIL = """WITH m AS (SELECT '<m' || doc_id || '@mail.test>' AS message_id, doc_id, text, source,
  lang || '-invoices' AS mailbox,
  strftime(make_timestamp((1700000000 + doc_id * 3607) * 1000000), '%Y%m%d-%H%M%S-') AS prefix
  FROM documents), pdf AS (SELECT *, 'a' || doc_id || '.pdf' AS filename FROM m
  UNION ALL SELECT *, 'b' || doc_id || '.PDF' FROM m) """


@query(
    "explode_attachments",
    _MAIL
    + """SELECT message_id, filename, CAST(strlen(text) AS BIGINT) AS bytes FROM pdf
      UNION ALL SELECT message_id, 'note.pdf.txt', CAST(strlen(source) AS BIGINT) FROM m""",
)
def _(spark, sf):
    return mail.explode_attachments(_mail(spark, sf)).select(
        "message_id", "filename", F.octet_length("content").cast("bigint").alias("bytes")
    )


@query("keep_pdf", _MAIL + "SELECT message_id, filename FROM pdf")
def _(spark, sf):
    return mail.keep_pdf(mail.explode_attachments(_mail(spark, sf))).select(
        "message_id", "filename"
    )


@query(
    "mail_objects",
    _MAIL
    + """SELECT 'inv-input' AS bucket, prefix || filename AS object_key, mailbox, message_id,
      sha256(text) AS content_sha256 FROM pdf""",
)
def _(spark, sf):
    found = mail.mail_objects(_mail(spark, sf))
    return found.withColumn("content_sha256", F.sha2("content", 256)).drop("content")


@query(
    "mailbox_of",
    "SELECT lang || '-invoices' AS mailbox, count(*) AS n FROM documents GROUP BY lang",
)
def _(spark, sf):
    mailbox = K.mailbox_of(F.col("to_addr"))
    return _mail(spark, sf).groupBy(mailbox.alias("mailbox")).agg(F.count("*").alias("n"))


@query(
    "allowed_senders",
    """SELECT '<m' || doc_id || '@mail.test>' AS message_id FROM documents
      WHERE source IN (SELECT 'src' || n_nationkey FROM nation WHERE n_regionkey < 2)""",
)
def _(spark, sf):
    senders = (
        table(spark, sf, "nation")
        .where(F.col("n_regionkey") < 2)
        .select(
            F.concat(
                F.lit("src"), F.col("n_nationkey").cast("string"), F.lit("@supplier.test")
            ).alias("from_addr")
        )
    )
    return X.allowed_senders(_mail(spark, sf), senders).select("message_id")


@query(
    "within_size",
    _MAIL + "SELECT message_id, filename FROM pdf WHERE strlen(text) <= 1000",
)
def _(spark, sf):
    attachments = mail.keep_pdf(mail.explode_attachments(_mail(spark, sf)))
    return X.within_size(attachments, 1000).select("message_id", "filename")


@query(
    "drop_copies",
    "SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha256(text)",
)
def _(spark, sf):
    return X.drop_copies(table(spark, sf, "documents"), "doc_id", "text").select("doc_id")


@query(
    "drop_copies_stream",
    "SELECT DISTINCT sha256(text) AS hash FROM documents",
)
def _(spark, sf):
    out = work_folder(spark, "stream-copies")
    documents = table(spark, sf, "documents")
    # A pattern matches the table as one file and as a folder of files; a plain path must be a folder.
    stream = (
        spark.readStream.schema(documents.schema)
        .parquet(f"{sf}/documents.parque[t]")
        .select(
            F.sha2(F.col("text").cast("binary"), 256).alias("hash"),
            F.timestamp_seconds(F.lit(1700000000) + F.col("doc_id") % 60).alias("received_at"),
        )
    )
    kept = copies.drop_copies_stream(stream, "hash", "received_at", "1 hour").select("hash")
    writer = kept.writeStream.option("checkpointLocation", f"{out}/checkpoint")
    S.trigger(writer, None).format("parquet").start(f"{out}/kept").awaitTermination()
    return spark.read.parquet(f"{out}/kept")


@query(
    "first_rows_stream",
    """WITH d AS (
      SELECT doc_id, doc_id % 4 AS part, CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN 'hot' ELSE sha256(text)
        END AS hash FROM documents
    ) SELECT doc_id FROM d WHERE hash IS NULL OR hash IN (SELECT hash FROM d GROUP BY hash HAVING count(*) = 1)
    UNION ALL SELECT doc_id FROM d WHERE hash IS NOT NULL
      AND hash IN (SELECT hash FROM d GROUP BY hash HAVING count(*) > 1)
    QUALIFY row_number() OVER (PARTITION BY hash ORDER BY part, doc_id) = 1""",
)
def _(spark, sf):
    """Four batches, half of all rows under one hash, a ninth without; copies come batches later."""
    base = work_folder(spark, "first-rows")
    hash_ = F.when(F.col("doc_id") % 9 == 0, F.lit(None)).when(F.col("doc_id") % 2 == 0, "hot")
    docs = table(spark, sf, "documents").select(
        "doc_id", hash_.otherwise(F.sha2(F.col("text").cast("binary"), 256)).alias("hash")
    )
    for part in range(4):
        docs.where(F.col("doc_id") % 4 == part).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(docs.schema).parquet(f"{base}/in")
        copies.first_rows_stream(
            stream, "hash", "doc_id", f"{base}/kept", f"{base}/seen", f"{base}/checkpoint", None, compact_every=2
        ).awaitTermination()
    return spark.read.parquet(f"{base}/kept").select("doc_id")


@query(
    "write_files",
    """SELECT 'lang-' || lang || '/' || source || '/' || doc_id || '.txt' AS file, sha256(text) AS content_sha256
      FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL""",
)
def _(spark, sf):
    """A file for each document, read back from the folder."""
    folder = work_folder(spark, "files")
    key = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    bucket = F.concat(F.lit("lang-"), "lang")
    docs = table(spark, sf, "documents")
    sinks.export_files(docs.select(bucket.alias("bucket"), key.alias("object_key"), F.col("text").alias("content")), folder)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(
        F.regexp_extract("path", "lang-.*$", 0).alias("file"), F.sha2("content", 256).alias("content_sha256")
    )


@query(
    "xml_differences",
    """WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents)
    SELECT doc_id, '/' AS path, 'only_left' AS change, '' AS left_value, '' AS right_value FROM d WHERE doc_id % 11 = 0
    UNION ALL SELECT doc_id, '/doc/line[1]/lang[1]', 'changed', lang, lang || '-x' FROM d
      WHERE doc_id % 5 = 0 AND doc_id % 11 > 0
    UNION ALL SELECT doc_id, '/doc/line[2]', 'only_right', '', '@n=2' FROM d WHERE doc_id % 7 = 0 AND doc_id % 11 > 0
    UNION ALL SELECT doc_id, '/doc', 'changed', '@id=' || doc_id, '@id=' || doc_id || '0' FROM d
      WHERE doc_id % 13 = 0 AND doc_id % 11 > 0""",
)
def _(spark, sf):
    """Planted changes: a value, an added part, an attribute of the root, and documents left out."""
    docs = table(spark, sf, "documents").select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")
    )

    def xml(number, lang, more):
        return F.concat(
            F.lit('<doc id="'), number, F.lit('"><line n="1"><lang>'), lang, F.lit("</lang><source>"), "source",
            F.lit("</source></line>"), more, F.lit("</doc>"),
        )

    own = F.col("doc_id").cast("string")
    left = docs.select("doc_id", xml(own, F.col("lang"), F.lit("")).alias("xml"))
    changed = F.when(F.col("doc_id") % 5 == 0, F.concat("lang", F.lit("-x"))).otherwise(F.col("lang"))
    number = F.when(F.col("doc_id") % 13 == 0, F.concat(own, F.lit("0"))).otherwise(own)
    more = F.when(F.col("doc_id") % 7 == 0, '<line n="2"><lang>q</lang></line>').otherwise("")
    right = docs.where(F.col("doc_id") % 11 > 0).select("doc_id", xml(number, changed, more).alias("xml"))
    found = xml_compare.xml_differences(left, right, "doc_id", "xml")
    return found.select(
        "doc_id", "path", "change", *[text(F.col(c), c) for c in ("left_value", "right_value")]
    )


# ---- events to outputs, errors and jobs ----

_CLOCK = datetime.datetime(2030, 1, 1, tzinfo=datetime.UTC)


def _upload_events(docs):
    """An event per document, and one for an object that does not exist per ten orders.

    The documents' keys are stored first: events are read several times, and orders would be joined and
    grouped with their lines anew each time.
    """
    spark = docs.sparkSession
    path = work_folder(spark, "event-keys")
    docs.select("k", "doc_key").write.parquet(path)
    docs = spark.read.parquet(path)
    present = docs.select(
        F.col("doc_key").alias("event_id"),
        F.lit("").alias("bucket"),
        F.concat(F.lit("in/"), F.col("doc_key"), F.lit(".pdf")).alias("object_key"),
    )
    absent = docs.where(F.col("k") % 10 == 0).select(
        F.concat(F.lit("x"), F.col("doc_key")).alias("event_id"),
        F.lit("").alias("bucket"),
        F.concat(F.lit("in/x"), F.col("doc_key"), F.lit(".pdf")).alias("object_key"),
    )
    return present.unionByName(absent).select(
        "*",
        F.lit(None).cast("string").alias("output_bucket"),
        F.lit(_CLOCK).alias("received_at"),
    )


def _stored(docs):
    return docs.select(
        F.lit(K.INPUT_BUCKET).alias("bucket"),
        F.concat(F.lit("in/"), F.col("doc_key"), F.lit(".pdf")).alias("object_key"),
        F.encode("text", "UTF-8").alias("content"),
    )


def _processed(spark, sf):
    docs = broken_documents(spark, sf)
    return process_events(_upload_events(docs), _stored(docs), F.lit(_CLOCK))


_FIRST = "FROM f JOIN r USING (k) WHERE idx = 0"


@query(
    "process_events",
    facts_sql(
        f"""SELECT 'in/' || doc_key || '.pdf' AS object_key, {STATUS_SQL} AS status,
      {TYPE_SQL} AS error_type, {ERROR_SQL} AS error_message,
      CASE WHEN k % 6 = 0 THEN n ELSE -1 END AS line_count {_FIRST}
      UNION ALL SELECT 'in/x' || doc_key || '.pdf', 'ERROR', 'processing_error',
      'Object not found: inv-input/in/x' || doc_key || '.pdf', -1 FROM f WHERE k % 10 = 0"""
    ),
)
def _(spark, sf):
    return _processed(spark, sf).select(
        F.col("input_object_key").alias("object_key"),
        "status",
        text(F.col("error_type"), "error_type"),
        text(F.col("error_message"), "error_message"),
        F.coalesce(F.size("invoice.lines"), F.lit(-1)).cast("bigint").alias("line_count"),
    )


# The XML itself is part of the comparison.
_OUTPUT_SQL = f"""SELECT 'inv-output' AS bucket, 'in/' || doc_key || '.xml' AS object_key,
  'application/xml' AS content_type, sha256(xml) AS content_sha256
  FROM ({facts_sql(XML_SQL)}) WHERE CAST(doc_key AS BIGINT) % 6 = 0"""


@query("write_outputs", _OUTPUT_SQL)
def _(spark, sf):
    path = work_folder(spark, "outputs")
    sinks.write_outputs(_processed(spark, sf), path, "run")
    sha = F.sha2("content", 256).alias("content_sha256")
    return spark.read.parquet(path).select("bucket", "object_key", "content_type", sha)


@query(
    "outputs_last_write",
    """SELECT 'inv-output' AS bucket, 'out/' || doc_id % 300 || '.xml' AS object_key, sha256(text) AS content_sha256
      FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id % 300
        ORDER BY doc_id * 7919 % 1009 DESC, doc_id % 3 DESC, CAST(doc_id AS VARCHAR) DESC) = 1""",
)
def _(spark, sf):
    """Keys written again and again in three batches, a snapshot after the second: the last job's output counts."""
    path = work_folder(spark, "last-write")
    docs = table(spark, sf, "documents")
    for batch in range(3):
        processed = docs.where(F.col("doc_id") % 3 == batch).select(
            F.lit("SUCCESS").alias("status"),
            F.lit(K.OUTPUT_BUCKET).alias("output_bucket"),
            F.concat(F.lit("out/"), F.col("doc_id") % 300, F.lit(".xml")).alias("output_object_key"),
            F.col("text").alias("xml"),
            F.concat(F.col("doc_id") % 3, F.lit("-"), F.col("doc_id").cast("string")).alias("id"),
            F.timestamp_seconds(F.col("doc_id") * 7919 % 1009).alias("started_at"),
        )
        sinks.write_outputs(processed, path, "run", batch)
        if batch == 1:
            sinks.output_ledger(path).compact(spark)
    sha = F.sha2("content", 256).alias("content_sha256")
    return sinks.last_outputs(spark, path).select("bucket", "object_key", sha)


@query(
    "write_errors",
    facts_sql(
        f"""SELECT 'inv-error' AS error_bucket, 'failed/in/' || doc_key || '.pdf' AS error_object_key,
      '{{"input_bucket":"inv-input","input_object_key":"in/' || doc_key || '.pdf","error_type":"'
      || {TYPE_SQL} || '","message":"' || {ERROR_SQL} || '","policy":"Input object is left in place.'
      || ' A copy is archived in the error bucket when available."}}' AS report, 'INV-' || doc_key AS archived
      {_FIRST} AND k % 6 > 0"""
    ),
)
def _(spark, sf):
    path = work_folder(spark, "errors")
    sinks.write_errors(_processed(spark, sf), path, "run")
    return spark.read.parquet(path).select(
        "error_bucket", "error_object_key", "report", _invoice_number(F.col("content")).alias("archived")
    )


def _invoice_number(content):
    return F.regexp_extract(content.cast("string"), "INV-[0-9]+", 0)


_JOBS_SQL = f"""SELECT 'in/' || doc_key || '.pdf' AS input_object_key, {STATUS_SQL} AS status,
  CASE WHEN k % 6 = 0 THEN 'INV-' || doc_key ELSE '' END AS invoice_number FROM f
  UNION ALL SELECT 'in/x' || doc_key || '.pdf', 'ERROR', '' FROM f WHERE k % 10 = 0"""


def _job_view(spark, path):
    return latest_jobs(sinks.job_log(spark, path)).select(
        "input_object_key", "status", text(F.col("invoice_number"), "invoice_number")
    )


@query("write_jobs", facts_sql(_JOBS_SQL))
def _(spark, sf):
    path = work_folder(spark, "jobs")
    docs = broken_documents(spark, sf)
    sinks.write_started(with_event_defaults(_upload_events(docs)), path, "run")
    sinks.write_jobs(_processed(spark, sf), path, "run")
    return _job_view(spark, path)


@query("process_event_stream", facts_sql(_JOBS_SQL))
def _(spark, sf):
    base = work_folder(spark, "events")
    docs = broken_documents(spark, sf)
    sinks.write_objects(_stored(docs), f"{base}/objects", slots=32)
    events = _upload_events(docs)
    events.write.parquet(f"{base}/incoming")
    stream = spark.readStream.schema(events.schema).parquet(f"{base}/incoming")
    S.process_event_stream(
        stream, f"{base}/objects", base, f"{base}/checkpoint", interval=None
    ).awaitTermination()
    return _job_view(spark, f"{base}/jobs")


@query(
    "outputs_of_two_runs",
    facts_sql(f"""SELECT 'first' AS run_id, object_key, document FROM ({{0}}) UNION ALL
      SELECT 'second', object_key, document FROM ({{0}})""".replace(
        "{0}",
        """SELECT 'in/' || doc_key || '.xml' AS object_key, 'INV-' || doc_key AS document
        FROM f WHERE k % 6 = 0""",
    )),
)
def _(spark, sf):
    """Two runs over the same events keep their outputs apart; each file holds its own document."""
    path = work_folder(spark, "two-runs")
    for run in ("first", "second"):
        sinks.write_outputs(_processed(spark, sf), path, run)
    number = F.regexp_extract(F.col("content").cast("string"), "<cbc:ID>([^<]*)</cbc:ID>", 1)
    return spark.read.parquet(path).select("run_id", "object_key", number.alias("document"))


@query("put_then_notify", facts_sql(_JOBS_SQL))
def _(spark, sf):
    """Objects and events come in two steps; the second objects are stored after the first batch."""
    base = work_folder(spark, "put-then-notify")
    docs = broken_documents(spark, sf)
    events = _upload_events(docs)
    late = F.crc32("object_key") % 2 == 1
    for step, part in enumerate((~late, late)):
        sinks.write_objects(_stored(docs).where(part), f"{base}/objects", slots=32, append=step > 0)
        events.where(part).write.mode("append").parquet(f"{base}/incoming")
        stream = spark.readStream.schema(events.schema).parquet(f"{base}/incoming")
        S.process_event_stream(
            stream, f"{base}/objects", base, f"{base}/checkpoint", interval=None
        ).awaitTermination()
    return _job_view(spark, f"{base}/jobs")


@query(
    "process_inbox_stream",
    f"SELECT object_key AS input_object_key, 'PARSE_ERROR' AS status FROM ({_INBOX_SQL})",
)
def _(spark, sf):
    """A folder of texts without amounts: every file becomes a job that says so."""
    base = work_folder(spark, "inbox-stream")
    files = inbox.stream_inbox(spark, _fill_inbox(spark, sf))
    no_digits = F.encode(F.regexp_replace(F.col("content").cast("string"), "[0-9]", ""), "UTF-8")
    S.process_inbox_stream(
        files.withColumn("content", no_digits), base, f"{base}/checkpoint", interval=None
    ).awaitTermination()
    latest = latest_jobs(sinks.job_log(spark, f"{base}/jobs"))
    return latest.select("input_object_key", "status")


def _status_stream(spark, sf) -> str:
    """The log in five batches, in no order of time; a snapshot after each second one, then a tail."""
    base = work_folder(spark, "status")
    log = event_log(spark, sf).select("id", "status", "seq")
    log.repartition(5, F.xxhash64("id", "seq")).write.parquet(f"{base}/log")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/log")
    S.status_latest_stream(
        stream, f"{base}/latest", f"{base}/checkpoint", interval=None, compact_every=2
    ).awaitTermination()
    return f"{base}/latest"


@query("status_latest", _LOG + "SELECT id, status FROM job")
def _(spark, sf):
    return S.status_latest(spark, _status_stream(spark, sf))


@query("status_counts_live", _LOG + 'SELECT status, count(*) AS "count" FROM job GROUP BY status')
def _(spark, sf):
    return S.status_counts_live(spark, _status_stream(spark, sf))
