"""Registered queries of language identification and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from docledger.llm import language, neighbours
from docledger.llm.common import table
from docledger.llm.registry import query


@query("op8_neighbours")
def op8(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))


@query("op10_language")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs.where(~language.held_out()))
    judged = language.identify(docs, model).withColumn("held_out", language.held_out())
    return judged.select("doc_id", "held_out", "lang_pred", "score")
