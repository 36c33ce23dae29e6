"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from docledger.plans.pipeline import parse_documents, with_xml  # noqa: E402
from docledger.plans.queries import QUERIES  # noqa: E402
from docledger.plans.render import ALL, render  # noqa: E402

HEADLINE = (
    "clean_lines",
    "tax_breakdown",
    "route_layout",
    "header_eu",
    "header_generic",
    "fixed_rows",
    "generic_rows",
    "parsed_tax_breakdown",
    "ubl_xml",
    "ubl_roundtrip",
    "process_events",
    "process_event_stream",
    "jobs_latest",
    "jobs_recent",
    "status_latest",
    "drop_copies",
)


def parse_stored(spark: SparkSession, sf_dir: str) -> tuple[int, float]:
    """Documents of all shapes, printed and stored beforehand: their number, and seconds to XML."""
    with tempfile.TemporaryDirectory(prefix="docledger-bench-") as folder:
        path = f"file://{folder}/documents"
        render(spark, sf_dir, *ALL).select("doc_key", "text").write.parquet(path)
        stored = spark.read.parquet(path)
        count = stored.count()
        start = time.perf_counter()
        xml = with_xml(parse_documents(stored)).select("doc_key", "xml")
        xml.write.format("noop").mode("overwrite").save()
        return count, time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("docledger-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    documents, parse_seconds = parse_stored(spark, sf_dir)
    seconds["parse_stored"] = round(parse_seconds, 3)
    line = {
        "metric": "headline queries, total wall time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "documents_per_second": round(documents / parse_seconds),
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
