"""Job history over a status log made from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from docledger.operators import jobs as J
from docledger.plans.queries.base import query, text
from docledger.plans.render import table

_STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def event_log(spark, sf):
    """Status log: even events start a job, odd ones end it (sign-ups only touch it)."""
    events = table(spark, sf, "events").select(
        "event_id",
        F.concat(F.lit("job-"), F.floor(F.col("event_id") / 2).cast("string")).alias("id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("doc-"), F.col("user_id").cast("string")).alias("name"),
        "event_type",
    )
    key = F.concat("name", F.lit(".pdf"))
    starts = J.jobs_create(
        events.where(F.col("event_id") % 2 == 0), F.col("id"), F.lit("inv-input"), key, F.col("ts")
    )
    kind = F.col("event_type")
    error = F.when(kind == "view", "parse_error").when(kind == "error", "processing_error")
    failed, ok = error.isNotNull(), error.isNull()
    ends = J.jobs_complete(
        events.where((F.col("event_id") % 2 == 1) & (kind != "signup")),
        F.col("id"),
        J.classify_outcome(error),
        F.col("ts") - F.expr("INTERVAL 1500 MILLISECONDS"),
        F.col("ts"),
        output_bucket=F.when(ok, "inv-output"),
        output_object_key=F.when(ok, F.concat("name", F.lit(".xml"))),
        error_bucket=F.when(failed, "inv-error"),
        error_object_key=F.when(failed, F.concat(F.lit("failed/"), key)),
        error_type=error,
        invoice_number=F.when(ok, F.concat(F.lit("N"), F.col("event_id").cast("string"))),
        document_type=F.when(ok, "invoice"),
        line_count=F.when(ok, F.length("name")),
    )
    touched = J.jobs_update(
        events.where((F.col("event_id") % 2 == 1) & (kind == "signup")),
        F.col("id"),
        1,
        error_message=F.lit("waiting"),
    )
    return starts.unionByName(ends).unionByName(touched)


_LOG = """WITH e AS (
  SELECT event_id, event_id // 2 AS j, 'job-' || (event_id // 2) AS id, ts, event_type,
    'doc-' || user_id AS name FROM events
), s AS (SELECT * FROM e WHERE event_id % 2 = 0), c AS (SELECT * FROM e WHERE event_id % 2 = 1),
jobs AS (
  SELECT s.id, CASE WHEN c.event_type IS NULL OR c.event_type = 'signup' THEN 'PROCESSING'
      WHEN c.event_type = 'view' THEN 'PARSE_ERROR' WHEN c.event_type = 'error' THEN 'ERROR'
      ELSE 'SUCCESS' END AS status,
    'inv-input' AS input_bucket, s.name || '.pdf' AS input_object_key,
    s.ts AS started_at, c.event_type IN ('click', 'purchase') AS ok,
    c.event_type IN ('view', 'error') AS failed, c.name AS end_name, c.event_id AS end_event,
    c.event_type AS end_type, c.ts AS end_ts
  FROM s LEFT JOIN c ON s.j = c.j
), job AS (
  SELECT *, CASE WHEN ok THEN 'inv-output' ELSE '' END AS output_bucket,
    CASE WHEN ok THEN end_name || '.xml' ELSE '' END AS output_object_key,
    CASE WHEN failed THEN 'inv-error' ELSE '' END AS error_bucket,
    CASE WHEN failed THEN 'failed/' || end_name || '.pdf' ELSE '' END AS error_object_key,
    CASE WHEN ok THEN 'N' || end_event ELSE '' END AS invoice_number,
    CASE WHEN end_type = 'signup' THEN 'waiting' ELSE '' END AS error_message,
    CASE WHEN ok OR failed THEN 1500 ELSE -1 END AS duration
  FROM jobs
)
"""


def latest(spark, sf):
    return J.latest_jobs(event_log(spark, sf))


@query(
    "jobs_create",
    """SELECT 'job-' || (event_id // 2) AS id, 'PROCESSING' AS status,
    'doc-' || user_id || '.pdf' AS input_object_key,
    strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS started_at FROM events WHERE event_id % 2 = 0""",
)
def _(spark, sf):
    return event_log(spark, sf).where(F.col("seq") == 0).select(
        "id", "status", "input_object_key", F.date_format("started_at", _STAMP).alias("started_at")
    )


@query(
    "jobs_latest",
    _LOG
    + """SELECT id, status, input_bucket, input_object_key, output_object_key, error_object_key,
    invoice_number, error_message, strftime(started_at, '%Y-%m-%d %H:%M:%S.%f') AS started_at,
    CAST(duration AS BIGINT) AS duration_ms FROM job""",
)
def _(spark, sf):
    return latest(spark, sf).select(
        "id",
        "status",
        "input_bucket",
        "input_object_key",
        text(F.col("output_object_key"), "output_object_key"),
        text(F.col("error_object_key"), "error_object_key"),
        text(F.col("invoice_number"), "invoice_number"),
        text(F.col("error_message"), "error_message"),
        F.date_format("started_at", _STAMP).alias("started_at"),
        F.coalesce("duration_ms", F.lit(-1)).cast("bigint").alias("duration_ms"),
    )


@query("jobs_recent", _LOG + "SELECT id, status FROM job ORDER BY started_at DESC, id LIMIT 9999")
def _(spark, sf):
    return J.jobs_recent(latest(spark, sf), 9999).select("id", "status")


@query("jobs_get", _LOG + "SELECT id, status, input_object_key FROM job WHERE id = 'job-42'")
def _(spark, sf):
    return J.jobs_get(latest(spark, sf), "job-42").select("id", "status", "input_object_key")


@query("jobs_counts", _LOG + 'SELECT status, count(*) AS "count" FROM job GROUP BY status')
def _(spark, sf):
    return J.jobs_counts(J.latest_jobs(event_log(spark, sf), columns=["status"]))


@query(
    "dashboard_kpis",
    _LOG
    + """SELECT count(*) AS total, count(*) FILTER (status = 'SUCCESS') AS success,
    count(*) FILTER (status IN ('ERROR', 'PARSE_ERROR')) AS failed,
    count(*) FILTER (status = 'PROCESSING') AS processing FROM job""",
)
def _(spark, sf):
    return J.dashboard_kpis(J.latest_jobs(event_log(spark, sf), columns=["status"]))


@query(
    "duration_ms",
    """SELECT event_id, (epoch_us(ts) % 86400000000) // 1000 AS ms FROM events""",
)
def _(spark, sf):
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select(
        "event_id", J.duration_ms(F.date_trunc("day", ts), ts).alias("ms")
    )


@query(
    "parse_result",
    _LOG
    + """SELECT id AS job_id, input_bucket, input_object_key, output_bucket, output_object_key,
    invoice_number, 'invoice' AS document_type, CAST(length(end_name) AS BIGINT) AS line_count
    FROM job WHERE status = 'SUCCESS'""",
)
def _(spark, sf):
    result = J.parse_result(latest(spark, sf))
    return result.withColumn("line_count", F.col("line_count").cast("bigint"))


@query(
    "archive_location",
    _LOG
    + """SELECT id, status, CASE WHEN failed AND j % 3 > 0 THEN error_bucket ELSE '' END
      AS error_bucket, CASE WHEN failed AND j % 3 > 0 THEN error_object_key ELSE '' END
      AS error_object_key FROM (SELECT *, end_event // 2 AS j FROM job)""",
)
def _(spark, sf):
    jobs = latest(spark, sf)
    number = F.substring_index("id", "-", -1).cast("bigint")
    archived = jobs.where(F.col("error_bucket").isNotNull() & (number % 3 > 0))
    return J.archive_location(jobs, archived).select(
        "id",
        "status",
        text(F.col("error_bucket"), "error_bucket"),
        text(F.col("error_object_key"), "error_object_key"),
    )


@query(
    "with_links",
    _LOG
    + """SELECT id, '/objects/' || id || '/input' AS input_url,
    CASE WHEN ok THEN '/objects/' || id || '/output' ELSE '' END AS output_url,
    CASE WHEN failed THEN '/objects/' || id || '/error' ELSE '' END AS error_url,
    '' AS error_report_url FROM job""",
)
def _(spark, sf):
    urls = ["input_url", "output_url", "error_url", "error_report_url"]
    return J.with_links(latest(spark, sf)).select("id", *[text(F.col(u), u) for u in urls])


@query(
    "object_locations",
    _LOG
    + """SELECT id, 'input' AS kind, input_bucket AS bucket, input_object_key AS object_key FROM job
    UNION ALL SELECT id, 'output', output_bucket, output_object_key FROM job WHERE ok
    UNION ALL SELECT id, 'error', error_bucket, error_object_key FROM job WHERE failed""",
)
def _(spark, sf):
    return J.object_locations(latest(spark, sf))
