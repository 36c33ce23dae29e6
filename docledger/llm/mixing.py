"""Mixing sources to target weights by capped water-filling.

Targets share a total by weight; a source whose share exceeds its cap (epochs times its size) is
clamped to the cap, and what it leaves is shared by weight among the others, until none exceeds its cap.
Each source then gives every document so many whole times, and the rest as a seeded sample: documents in
the order of a hash, until the fraction is reached; the document on the border gives its leading words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docledger.llm.common import Scratch, free_name

WEIGHTS = (5, 2, 1)
TOTAL_PERCENT = 150
MOST_EPOCHS = 2
SEED = 17
#: Leading hex digits of the hash that name a bin; running sums first run over bins.
BIN_DIGITS = 3


def word_count(text: str) -> Column:
    """Number of white-space words; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame,
    scratch: Scratch,
    weights: tuple[int, ...] = WEIGHTS,
    total_percent: int = TOTAL_PERCENT,
    most_epochs: int = MOST_EPOCHS,
) -> DataFrame:
    """Targets for one row per source (source, source_size): adds weight, target and whole/rest words.

    Sources by code point, null last, take the weights in turn. Sums stay whole numbers; each round is
    one small aggregate, and every round clamps at least one source or is the last.
    """
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(ranked) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long")
    level = scratch.keep(sizes.withColumn("weight", weight), "sources")
    cap = F.col("source_size") * most_epochs
    total = level.agg(F.sum("source_size")).first()[0] or 0
    whole, rest = divmod(total * total_percent, 100)
    share = whole + rest / 100
    clamped, n_clamped = F.lit(False), -1
    while True:
        row = level.agg(
            F.coalesce(F.sum(F.when(clamped, cap)), F.lit(0)).alias("held"),
            F.sum(F.when(~clamped, F.col("weight"))).alias("weights"),
            F.count(F.when(clamped, 1)).alias("n"),
        ).first()
        room, weight_sum = share - row.held, row.weights
        if row.n == n_clamped or not weight_sum:
            break
        n_clamped = row.n
        # The level only rises from round to round, so a clamped source stays clamped.
        clamped = F.lit(float(room)) * F.col("weight") > cap * F.lit(float(weight_sum))
    capped = cap.cast("double")
    if not weight_sum:
        return level.withColumn("target", capped)
    free = F.lit(float(room)) * F.col("weight") / F.lit(float(weight_sum))
    return level.withColumn("target", F.when(clamped, capped).otherwise(free))


def mix(
    docs: DataFrame,
    scratch: Scratch | None = None,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    weights: tuple[int, ...] = WEIGHTS,
    total_percent: int = TOTAL_PERCENT,
    most_epochs: int = MOST_EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """Every row and column of `docs` with size, source_size, target, and taken words.

    `taken` counts repeats: `size` for each whole epoch, plus `size` again for sampled documents, or
    the leading words of the one document per source at the border of the sample. The taken words of a
    source are its target to the nearest word. Reruns give the same rows: the order is by
    md5(seed|source|id), then id, size and md5 of the text.

    A null source is a source of its own and ranks last; null or empty texts have size 0 and are taken 0
    times; null ids take part; identical rows are taken one after the other, and which of them is the one
    at the border makes no difference; an empty table gives no rows. Columns of `docs` with the names of
    the results are replaced. A source may hold any share of the rows: running sums run over bins of
    the hash, and only the one bin in which a source's sample ends is shuffled and put in order.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mixing")
    names = ("hash", "text_hash", "bin", "source", "bin2", "rest", "epochs", "before", "upto", "first")
    own = {n: free_name(docs, f"mix_{n}") for n in names}
    order = F.md5(
        F.concat_ws(
            "|",
            F.lit(str(seed)),
            F.coalesce(F.col(source).cast("string"), F.lit("")),
            F.coalesce(F.col(doc_id).cast("string"), F.lit("")),
        )
    )
    sized = docs.withColumns(
        {"size": word_count(text), own["hash"]: order, own["text_hash"]: F.md5(F.coalesce(F.col(text), F.lit("")))}
    ).withColumn(own["bin"], F.substring(own["hash"], 1, BIN_DIGITS))
    bins = scratch.keep(
        sized.groupBy(F.col(source).alias("source"), F.col(own["bin"]).alias("bin")).agg(F.sum("size").alias("n")),
        "bins",
    )
    sizes = bins.groupBy("source").agg(F.sum("n").alias("source_size"))
    targets = source_targets(sizes, scratch, weights, total_percent, most_epochs)
    wanted = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(wanted / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.select(
        F.col("source").alias(own["source"]),
        "source_size",
        "target",
        epochs.alias(own["epochs"]),
        (wanted - epochs * F.col("source_size")).alias(own["rest"]),
    )
    earlier = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        bins.withColumn(own["before"], F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .withColumn(own["upto"], F.col(own["before"]) + F.col("n"))
        .withColumnRenamed("bin", own["bin2"])
        .join(targets, F.col("source").eqNullSafe(F.col(own["source"])))
        .drop("source", "n")
    )
    same = F.col(source).eqNullSafe(F.col(own["source"])) & (F.col(own["bin"]) == F.col(own["bin2"]))
    joined = sized.drop("source_size", "target", "taken").join(plan, same)
    # Only the bin in which the sample of a source ends needs its documents in order.
    border = (F.col(own["before"]) < F.col(own["rest"])) & (F.col(own["rest"]) < F.col(own["upto"]))
    inside = Window.partitionBy(own["source"], own["bin"]).orderBy(
        own["hash"], F.col(doc_id).asc_nulls_last(), "size", own["text_hash"]
    )
    earlier = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = own["first"]
    ordered = joined.where(border).withColumn(first, F.col(own["before"]) + earlier)
    clear = joined.where(~border).withColumn(first, F.col(own["before"]))
    room = F.greatest(F.lit(0), F.col(own["rest"]) - F.col(first))
    part = F.when(F.col(own["upto"]) <= F.col(own["rest"]), F.col("size")).otherwise(F.least(F.col("size"), room))
    taken = F.col(own["epochs"]) * F.col("size") + part
    return ordered.unionByName(clear).withColumn("taken", taken.cast("long")).drop(*own.values())
