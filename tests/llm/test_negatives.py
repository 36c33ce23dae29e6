"""Hard negatives beside plain loops, and the vertical scan beside plain products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docledger.llm import negatives


def plain(rows, step=50, positives=5, most=3):
    held = [
        (v, label, [math.floor(256 * x) for x in vector])
        for v, label, vector in rows
        if None not in (v, label, vector) and all(x is not None and math.isfinite(x) for x in vector)
    ]
    out = set()
    for a, label, vector in {(v, label, tuple(x)) for v, label, x in held if v % step == 0}:
        scored = [
            (-sum(x * y for x, y in zip(vector, other)), v, same == label)
            for v, same, other in held
            if v != a and len(other) == len(vector)
        ]
        for p, name, same in sorted(s for s in scored if s[2])[:positives]:
            fits = sorted((n, v) for n, v, same in scored if not same and -50 * p <= -100 * n <= -95 * p)
            out |= {(a, name, i, v, -p, -n) for i, (n, v) in enumerate(fits[:most], 1)}
    return out


def vectors(seed, n=400, dim=6):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        base = [rnd.choice([-1.0, 0.0, 0.5, 1.0]) + rnd.choice([0.0, 0.01, rnd.random()]) for _ in range(dim)]
        rows.append((i, rnd.choice([1, 1, 1, 2, 3, -4]), base))
    rows += [(n + 50 + i, 1, rows[3][2]) for i in range(20)]
    rows += [(900, None, rows[0][2]), (950, 1, None), (1000, 2, [0.1, None] * 3), (1050, 2, [float("nan")] * 6)]
    rows += [(1100, 2, [float("inf")] * 6), (None, 1, rows[0][2]), (1150, 3, [0.0] * 6), (1200, 7, [1.0] * 6)]
    rows += [(1250, 1, [1.0, 2.0]), (1251, 1, [3.0, 1.0]), (1252, 2, [1.0, 1.4]), (1300, 1, []), (1301, 1, []), (1302, 2, [])]
    rnd.shuffle(rows)
    return rows


SCHEMA = "vec_id long, label int, embedding array<double>"


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives(spark, seed):
    rows = vectors(seed)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", rank int, Block int").repartition(5)
    got = negatives.hard_negatives(df, F.col("vec_id") % 50 == 0)
    assert set(map(tuple, got.collect())) == plain(rows)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert [t for _, t in got.dtypes] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]


def test_repeated_rows_are_candidates_and_one_anchor(spark):
    rows = vectors(5, 120) * 2
    got = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0)
    assert set(map(tuple, got.collect())) == plain(rows)


def test_copied_chunks_are_not_broadcast(spark):
    """Copies for each cell would pass through the driver, however small the stored chunks look."""
    rows = [r for r in vectors(3, 120) if None not in r]
    got = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0)
    assert "Broadcast" not in got._jdf.queryExecution().sparkPlan().toString()
    blocks = spark.createDataFrame([(1, 2, 3)], "block long, dim int, label long")
    chunks = spark.createDataFrame([(5, 2, 3, 1, b"")], "chunk long, dim int, label long, n int, ids binary")
    met = negatives._meet(blocks, chunks, 4, ["dim", "label"])
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString() and met.count() == 1


def test_empty_tables_and_lone_labels(spark):
    anchor = F.col("vec_id") % 50 == 0
    assert negatives.hard_negatives(spark.createDataFrame([], SCHEMA), anchor).collect() == []
    lone = [(0, 1, [1.0]), (1, 2, [1.0]), (50, 3, [0.9])]
    assert negatives.hard_negatives(spark.createDataFrame(lone, SCHEMA), anchor).collect() == []


@pytest.mark.parametrize("size", [3, 3000, 1 << 25])
def test_scan_is_exact_and_leaves_rows_out(size):
    """Every number type gives the exact places; most rows are given up before all columns are read."""
    rng = np.random.default_rng(size)
    columns = rng.integers(-size, size, (40, 500)) + np.where(rng.random((1, 500)) < 0.1, size, 0)
    block = negatives.Block(rng.permutation(500), rng.integers(0, 3, 500), columns)
    anchor = rng.integers(-size, size, 40)
    exact = anchor @ columns
    rows = np.arange(500)
    order = np.lexsort((block.ids, -exact))
    own, scores = block.nearest(anchor, rows, 5)
    assert own.tolist() == order[:5].tolist() and scores.tolist() == exact[order[:5]].tolist()
    top = int(exact.max())
    windows = [(top // 2, top * 95 // 100), (-top, top // 3), (top + 1, top + 9)]
    for (low, high), (own, scores) in zip(windows, block.in_windows(anchor, rows, windows, 3)):
        fits = [i for i in order if low <= exact[i] <= high][:3]
        assert own.tolist() == fits and scores.tolist() == exact[fits].tolist()
    kept = []
    block.scan(anchor, rows, lambda low, high: kept.append(len(low)) or high >= np.sort(low)[-5])
    assert kept[-1] < 250 and kept == sorted(kept, reverse=True)


def test_scores_beyond_64_bits_are_an_error():
    with pytest.raises(OverflowError):
        negatives.exact_kind(np.array([1 << 40] * 4), np.array([1 << 40] * 4))
