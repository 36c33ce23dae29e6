"""Job history: an append-only status log, its latest view and reports over it.

A log row is a job row plus ``seq``: 0 when processing starts, 1 when it ends. Later
rows only carry the columns they set.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.functions.keys import object_url
from docledger.schemas import JOB

# ---- fixed values ----
PROCESSING, SUCCESS, PARSE_ERROR, ERROR = "PROCESSING", "SUCCESS", "PARSE_ERROR", "ERROR"
DEFAULT_LIMIT = 100
OBJECT_KINDS = {
    "output": ("output_bucket", "output_object_key"),
    "error": ("error_bucket", "error_object_key"),
    "error-report": ("error_bucket", "error_report_object_key"),
    "input": ("input_bucket", "input_object_key"),
}
# ----------------------


def job_id(*parts: Column) -> Column:
    """Deterministic id, so a retried event is the same job."""
    return F.sha2(F.concat_ws("\n", *parts), 256)


def duration_ms(started: Column, completed: Column) -> Column:
    """Whole milliseconds between two times."""
    return F.call_function("div", F.unix_micros(completed) - F.unix_micros(started), F.lit(1000))


def classify_outcome(error_type: Column) -> Column:
    """Job status for an error type; no error is a success."""
    return (
        F.when(error_type.isNull(), SUCCESS)
        .when(error_type == "parse_error", PARSE_ERROR)
        .otherwise(ERROR)
    )


def log_rows(df: DataFrame, seq: int, columns: dict[str, Column]) -> DataFrame:
    """Log rows with the given columns set and the others NULL."""
    return df.select(
        *[
            (columns[f.name].cast(f.dataType) if f.name in columns else F.lit(None).cast(f.dataType))
            .alias(f.name)
            for f in JOB.fields
        ],
        F.lit(seq).cast("bigint").alias("seq"),
    )


def jobs_create(
    df: DataFrame, id: Column, input_bucket: Column, input_object_key: Column, started_at: Column
) -> DataFrame:
    return log_rows(
        df,
        0,
        {
            "id": id,
            "status": F.lit(PROCESSING),
            "input_bucket": input_bucket,
            "input_object_key": input_object_key,
            "started_at": started_at,
        },
    )


def jobs_complete(
    df: DataFrame,
    id: Column,
    status: Column,
    started_at: Column,
    completed_at: Column,
    **values: Column,
) -> DataFrame:
    return log_rows(
        df,
        1,
        {
            "id": id,
            "status": status,
            "completed_at": completed_at,
            "duration_ms": duration_ms(started_at, completed_at),
            **values,
        },
    )


def jobs_update(df: DataFrame, id: Column, seq: int, **values: Column) -> DataFrame:
    return log_rows(df, seq, {"id": id, **values})


def latest_jobs(log: DataFrame, order: str = "seq", columns: Sequence[str] | None = None) -> DataFrame:
    """One row per job: for each column the latest value that was set.

    ``max_by`` reduces each job to one row on the map side first, so a job with very
    many log rows costs no more than others after the shuffle. Ask for few columns where
    few are needed: the others are then not read.
    """
    names = columns or [c for c in log.columns if c not in ("id", order)]
    return log.groupBy("id").agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in names]
    )


def jobs_recent(jobs: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Newest jobs first, as many as the caller asks for, one at least."""
    return jobs.orderBy(F.desc("started_at"), "id").limit(max(1, limit))


def jobs_get(jobs: DataFrame, id: str) -> DataFrame:
    return jobs.where(F.col("id") == id)


def jobs_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count("*").alias("count"))


def dashboard_kpis(jobs: DataFrame) -> DataFrame:
    """Counters of the dashboard, over all jobs."""

    def count(*statuses: str) -> Column:
        return F.count_if(F.col("status").isin(*statuses))

    return jobs.agg(
        F.count("*").alias("total"),
        count(SUCCESS).alias("success"),
        count(ERROR, PARSE_ERROR).alias("failed"),
        count(PROCESSING).alias("processing"),
    )


def parse_result(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status") == SUCCESS).select(
        F.col("id").alias("job_id"),
        "input_bucket",
        "input_object_key",
        "output_bucket",
        "output_object_key",
        "invoice_number",
        "document_type",
        "line_count",
    )


def archive_location(jobs: DataFrame, archived: DataFrame) -> DataFrame:
    """Jobs with the error columns of their archived copy, NULL where nothing was archived."""
    names = ["error_bucket", "error_object_key", "error_report_object_key"]
    return jobs.drop(*names).join(archived.select("id", *names), "id", "left")


def with_links(jobs: DataFrame) -> DataFrame:
    """Add the link of each object that exists."""
    return jobs.withColumns(
        {
            kind.replace("-", "_") + "_url": object_url(
                F.col("id"), kind, F.col(bucket), F.col(key)
            )
            for kind, (bucket, key) in OBJECT_KINDS.items()
        }
    )


def object_locations(jobs: DataFrame) -> DataFrame:
    """(id, kind, bucket, object_key) for every object a job has."""
    kinds = F.array(
        *[
            F.struct(
                F.lit(kind).alias("kind"),
                F.col(bucket).alias("bucket"),
                F.col(key).alias("object_key"),
            )
            for kind, (bucket, key) in OBJECT_KINDS.items()
        ]
    )
    present = F.filter(
        kinds,
        lambda x: (F.coalesce(x["bucket"], F.lit("")) != "")
        & (F.coalesce(x["object_key"], F.lit("")) != ""),
    )
    return jobs.select("id", F.inline(present))
