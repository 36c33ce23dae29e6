"""From raw documents to token files: the stages, in order, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docledger.llm import decontaminate, jaccard, mixing, quality, tokens
from docledger.llm.common import Scratch, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


NEEDED = ("doc_id", "text", "source")


def apart(docs: DataFrame) -> DataFrame:
    """The columns that operators read, and all others in one, so that no result can take their names."""
    rest = [F.col(c) for c in docs.columns if c not in NEEDED]
    carried = F.struct(*rest) if rest else F.lit(None)
    return docs.select(*[c for c in NEEDED if c in docs.columns], carried.alias("carried"))


def whole(done: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of `docs` again."""
    return done.select(*[F.col(c) if c in NEEDED else F.col("carried").getField(c).alias(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on these documents, does not reject."""
    return whole(quality.judge(apart(docs), quality.learn(docs)).where("keep"), docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group; rows without an id can't be named and stay.

    Of several rows with that id the one with the least text stays.
    """
    found = jaccard.jaccard_components(docs)
    chosen = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    kept = apart(docs).join(chosen, "doc_id", "left_semi")
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last()))
    kept = kept.withColumn("turn", turn).where("turn = 1")
    return whole(kept, docs).unionByName(docs.where(F.col("doc_id").isNull()).select(*docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in benchmark windows."""
    found = decontaminate.find_benchmark(apart(docs), table(spark, sf_dir, "benchmark"))
    return whole(found.where(~F.col("contaminated")), docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document; the one at a source's border is cut to its words.

    A cut text has a new `n_chars`, where the table has that column.
    """
    mixed = mixing.mix(apart(docs))
    times_whole = F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int")
    rest = (F.col("taken") - times_whole * F.col("size")).cast("int")
    times = F.concat(
        F.array_repeat(F.lit(0), times_whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>"))
    )
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    taken = mixed.where("taken > 0").withColumn("words", F.explode(times))
    cut = F.when(F.col("words") == 0, F.col("text")).otherwise(F.array_join(F.slice(words, 1, F.greatest("words", F.lit(1))), " "))
    return whole(taken.withColumn("text", cut).withColumn("carried", _recounted(docs)), docs)


def _recounted(docs: DataFrame) -> Column:
    """The carried columns, with the length of a cut text."""
    if "n_chars" not in docs.columns:
        return F.col("carried")
    own = F.col("carried").getField("n_chars")
    count = F.when(F.col("words") == 0, own).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return F.col("carried").withField("n_chars", count)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and from them a row for each document in them."""
    return tokens.tokenized(docs, tokens.default_tokenizer())


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: Expectation-maximisation and the tokenizer are beyond SQL: tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.keep(docs, name)
    return docs
