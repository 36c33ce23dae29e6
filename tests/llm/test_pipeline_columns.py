"""Stages leave columns alone whose names their operators use for results."""

import corpus_pipeline
from conftest import SF_DIR
from pyspark.sql import functions as F

from docledger.llm.common import table

NAMES = ("keep", "votes", "words", "turn", "size", "taken", "target", "n_hit", "items", "contaminated", "component_id", "carried")


def test_clashing_columns_pass_all_stages(spark):
    docs = table(spark, SF_DIR, "documents").limit(60).drop("n_chars")
    docs = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in NAMES])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF_DIR)
        assert kept.columns == docs.columns, name
        rows = kept.collect()
        assert rows and all(row[n] == f"{n}{row['doc_id']}" for row in rows for n in NAMES), name
