"""Run queries beside their SQL and compare the rows."""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def compare(spark, con, name: str, run, sql: str, sf_dir: str) -> str:
    """'' when both give the same columns and rows, else what differs."""
    result = run(spark, sf_dir)
    columns = sorted(result.columns)
    expected = con.sql(sql)
    if sorted(expected.columns) != columns:
        return f"columns {columns} against {sorted(expected.columns)}"
    left = Counter(tuple(row) for row in result.select(*columns).collect())
    right = Counter(expected.select(*columns).fetchall())
    if left == right:
        return "" if left else "no rows"
    extra, lacking = left - right, right - left
    return (
        f"{sum(left.values())} rows against {sum(right.values())}; "
        f"only here: {list(extra)[:2]}; only in SQL: {list(lacking)[:2]}"
    )


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    sys.path.insert(0, ".")
    from __spark_entry__ import oracle_sql, queries

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    checks = oracle_sql()
    bad = 0
    for name, run in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in checks:
                problem = compare(spark, con, name, run, checks[name], sf_dir)
            else:
                problem = "" if run(spark, sf_dir).count() else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(problem)
        mark = "ok  " if not problem else "FAIL"
        kind = "" if name in checks else " (rows only)"
        print(f"{mark} {name}{kind} {time.time() - start:.1f}s {problem}", flush=True)
    print("failures:", bad)
