"""Hard negatives by a vertical scan.

Rows are kept in blocks of columns, one per dimension, with each column's least and greatest value. An anchor
reads the columns in the descending order of its own magnitudes. What the unread columns can still add lies
between two sums that are the same for the whole block, so each row's score has a window that closes as columns
are read; rows whose window can't reach a place any more leave the bitmap, and those left have exact scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docledger.llm.common import Scratch, ship

BLOCK_ROWS = 1 << 14
CHUNK_ANCHORS = 256
#: Columns read before the bitmap is looked at again.
STRIDE = 8

BLOCK = "block long, dim int, labels array<long>, n int, ids binary, row_labels binary, columns binary"
CHUNK = "chunk long, dim int, label long, n int, ids binary, vectors binary"
FOUND = "chunk long, i int, positive_score long, score long, vec_id long"


def whole_numbers(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component; null for a vector with a null or non-finite component."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    doubles = vector.cast("array<double>")
    return F.when(~F.exists(doubles, bad), F.transform(doubles, lambda x: F.floor(x * factor)))


def exact_kind(anchor_size: np.ndarray, column_size: np.ndarray) -> type:
    """The fastest number type in which every sum of these products is exact."""
    most = sum(int(a) * int(c) for a, c in zip(anchor_size, column_size))
    for kind, bits in ((np.float32, 24), (np.float64, 53), (np.int64, 63)):
        if most < 1 << bits:
            return kind
    raise OverflowError("a score of these vectors may not fit a 64-bit number")


class Block:
    """Columns of some rows of one dimension."""

    def __init__(self, ids: np.ndarray, label: np.ndarray, columns: np.ndarray):
        self.ids, self.label, self.columns = ids, label, columns
        self.low, self.high = columns.min(axis=1), columns.max(axis=1)
        self.size = np.maximum(np.abs(self.low), np.abs(self.high))
        self.kinds: dict[type, np.ndarray] = {}

    def scan(self, anchor: np.ndarray, rows: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
        """Rows that `keep` does not give up, and their exact scores.

        `keep(low, high)` sees bounds of the scores of the rows left, and says which of them stay.
        """
        kind = exact_kind(np.abs(anchor), self.size)
        if kind not in self.kinds:
            self.kinds[kind] = self.columns.astype(kind)
        columns = self.kinds[kind]
        order = np.argsort(-np.abs(anchor), kind="stable")
        least, most = anchor * self.low, anchor * self.high
        least, most = np.minimum(least, most)[order], np.maximum(least, most)[order]
        # What the columns from a place on add at least, and at most.
        below = np.append(np.cumsum(least[::-1])[::-1], 0)
        above = np.append(np.cumsum(most[::-1])[::-1], 0)
        weights = anchor.astype(kind)
        alive = rows
        whole = len(alive) == columns.shape[1]
        partial = np.zeros(len(alive), np.int64)
        for start in range(0, len(order), STRIDE):
            some = order[start : start + STRIDE]
            held = columns[some] if whole else columns[some[:, None], alive]
            partial = partial + (weights[some] @ held).astype(np.int64)
            read = min(start + STRIDE, len(order))
            stays = keep(partial + below[read], partial + above[read])
            if not stays.all():
                alive, partial, whole = alive[stays], partial[stays], False
                if not len(alive):
                    break
        return alive, partial

    def nearest(self, anchor: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k rows of highest score, ties by smaller id."""

        def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            if len(low) <= k:
                return np.ones(len(low), bool)
            return high >= np.partition(low, len(low) - k)[len(low) - k]

        alive, scores = self.scan(anchor, rows, keep)
        first = np.lexsort((self.ids[alive], -scores))[:k]
        return alive[first], scores[first]

    def in_windows(self, anchor: np.ndarray, rows: np.ndarray, windows: list[tuple[int, int]], k: int) -> list:
        """For each window (low, high) of scores the k rows of highest score in it."""

        def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            stays = np.zeros(len(low), bool)
            for least, most in windows:
                possible = (high >= least) & (low <= most)
                surely = low[(low >= least) & (high <= most)]
                if len(surely) >= k:
                    possible &= high >= np.partition(surely, len(surely) - k)[len(surely) - k]
                stays |= possible
            return stays

        alive, scores = self.scan(anchor, rows, keep)
        found = []
        for least, most in windows:
            inside = (scores >= least) & (scores <= most)
            own, value = alive[inside], scores[inside]
            first = np.lexsort((self.ids[own], -value))[:k]
            found.append((own[first], value[first]))
        return found


def _packed_ints(values: np.ndarray) -> bytes:
    """Whole numbers in the narrowest type, named by the first byte."""
    for kind in ("<i2", "<i4"):
        narrow = values.astype(kind)
        if (narrow == values).all():
            return kind[-1:].encode() + narrow.tobytes()
    return b"8" + values.astype("<i8").tobytes()


def _ints(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[:1].decode()}", offset=1).astype(np.int64)


def _groups(batches: Iterator[pa.RecordBatch], most: int, keys: int) -> Iterator[tuple]:
    """Rows (dim, label, vec_id, vector) cut where one of the first `keys` columns changes or after `most` rows."""
    held: list[tuple] = []
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(3)]
        flat = batch.column(3).flatten().to_numpy(zero_copy_only=False)
        at = 0
        for dim, label, name in zip(*columns):
            if held and (len(held) >= most or held[-1][:keys] != (dim, label)[:keys]):
                yield held
                held = []
            held.append((dim, label, name, flat[at : at + dim]))
            at += dim
    if held:
        yield held


def _arrays(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.array([r[2] for r in rows], np.int64)
    label = np.array([r[1] for r in rows], np.int64)
    return ids, label, np.stack([r[3] for r in rows]).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    for rows in _groups(batches, BLOCK_ROWS, 1):
        ids, label, vectors = _arrays(rows)
        row = {
            "block": number, "dim": rows[0][0], "labels": np.unique(label).tolist(), "n": len(rows),
            "ids": ids.tobytes(), "row_labels": label.tobytes(), "columns": _packed_ints(vectors.T.ravel()),
        }
        number += 1
        yield pa.RecordBatch.from_pylist([row], schema=BLOCK_SCHEMA)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    for rows in _groups(batches, CHUNK_ANCHORS, 2):
        ids, label, vectors = _arrays(rows)
        row = {
            "chunk": number, "dim": rows[0][0], "label": int(label[0]), "n": len(rows),
            "ids": ids.tobytes(), "vectors": _packed_ints(vectors.ravel()),
        }
        number += 1
        yield pa.RecordBatch.from_pylist([row], schema=CHUNK_SCHEMA)


_LONGS = pa.list_(pa.int64())
BLOCK_SCHEMA = pa.schema(
    [("block", pa.int64()), ("dim", pa.int32()), ("labels", _LONGS), ("n", pa.int32())]
    + [(name, pa.binary()) for name in ("ids", "row_labels", "columns")]
)
CHUNK_SCHEMA = pa.schema(
    [("chunk", pa.int64()), ("dim", pa.int32()), ("label", pa.int64()), ("n", pa.int32())]
    + [("ids", pa.binary()), ("vectors", pa.binary())]
)
FOUND_SCHEMA = pa.schema(
    [("chunk", pa.int64()), ("i", pa.int32())] + [(n, pa.int64()) for n in ("positive_score", "score", "vec_id")]
)
_HELD: dict[int, Block] = {}


def _block(row: dict) -> Block:
    """A block's columns; the one met last stays unpacked."""
    if row["block"] not in _HELD:
        _HELD.clear()
        columns = _ints(row["columns"]).reshape(row["dim"], row["n"])
        ids, label = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["row_labels"], np.int64)
        _HELD[row["block"]] = Block(ids, label, columns)
    return _HELD[row["block"]]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Block, np.ndarray, np.ndarray]]:
    """Each pair of a chunk of anchors and a block, unpacked."""
    _HELD.clear()
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            anchors = _ints(row["vectors"]).reshape(row["anchors"], row["dim"])
            yield row, _block(row), np.frombuffer(row["anchor_ids"], np.int64), anchors


def _found(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, FOUND_SCHEMA)], schema=FOUND_SCHEMA
    )


def _meet(blocks: DataFrame, chunks: DataFrame, cells: int, keys: list[str]) -> DataFrame:
    """Each chunk beside each block with the same keys.

    Every anchor is a stated query and meets all rows. Blocks are dealt to `cells` and chunks, which are
    small, are copied to each cell, so a hot label or dimension is spread over all of them. The copies are
    dealt by a shuffle: the planner sees the stored chunks only and would broadcast all copies through the driver.
    """
    dealt = blocks.withColumn("cell", F.pmod(F.xxhash64("block"), F.lit(cells)).cast("int"))
    copied = chunks.withColumnsRenamed({"ids": "anchor_ids", "n": "anchors"}).withColumn(
        "cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))
    )
    on = [*keys, "cell"]
    # Counted, so that adaptive execution doesn't put many cells, small but long to scan, into one task.
    return dealt.repartition(cells, *on).hint("merge").join(copied.repartition(cells, *on), on)


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 3,
    percent: tuple[int, int] = (50, 95),
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of `anchors`.

    A row takes part with an id, a label (a whole number) and a vector without null or non-finite components; an anchor meets
    rows of its own number of dimensions. Rows with the anchor's id are not other rows; of repeated rows each
    is a candidate of its own, and equal anchors are one anchor. Scores are exact; vectors whose scores may
    pass 64 bits end the job with an error. An anchor without positives, and a positive without a
    negative in its window, have no row; an empty table gives none. Other columns are left out.
    """
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark, "negatives")
    cells = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.select(
        F.col(label).cast("long").alias("label"),
        F.col(vec_id).cast("long").alias("vec_id"),
        whole_numbers(F.col(vector)).alias("vector"),
        anchors.alias("is_anchor"),
    ).where("label is not null and vec_id is not null and vector is not null")
    rows = rows.select(F.size("vector").alias("dim"), "label", "vec_id", "vector", "is_anchor")
    fields = ["dim", "label", "vec_id", "vector"]
    # A hot label is cut by the ids' hash.
    dealt = rows.select(*fields).repartitionByRange(cells, "dim", "label", F.xxhash64("vec_id"))
    blocks = scratch.keep(dealt.sortWithinPartitions("dim", "label").mapInArrow(_blocks, BLOCK), "blocks")
    asked = rows.where("is_anchor").select(*fields).distinct()
    asked = asked.repartitionByRange(cells, "dim", "label", F.xxhash64("vec_id")).sortWithinPartitions("dim", "label")
    chunks = scratch.keep(asked.mapInArrow(_chunks, CHUNK), "chunks")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block, ids, anchor in _met(batches):
            out = []
            same = np.flatnonzero(block.label == row["label"])
            for i in range(len(ids)):
                others = same[block.ids[same] != ids[i]]
                own, scores = block.nearest(anchor[i], others, positives)
                out += [(row["chunk"], i, s, s, v) for s, v in zip(scores.tolist(), block.ids[own].tolist())]
            yield _found(out)

    pair = ["block", "dim", "n", "ids", "row_labels", "columns", "chunk", "label", "anchors", "anchor_ids", "vectors"]
    by_label = _meet(blocks.withColumn("label", F.explode("labels")), chunks, cells, ["dim", "label"])
    near = by_label.select(*pair).mapInArrow(nearest, FOUND)
    order = Window.partitionBy("chunk", "i").orderBy(F.desc("score"), "vec_id")
    best = near.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= positives)
    best = scratch.keep(best.select("chunk", "i", "turn", "score", "vec_id"), "positives")

    least, most = percent
    asked_of = best.groupBy("chunk").agg(F.collect_list(F.struct("i", "score")).alias("wanted"))
    # Two flat arrays: each chunk is copied to every cell, and an array of structs takes three times their bytes.
    asked_of = asked_of.select("chunk", F.col("wanted.i").alias("wanted_i"), F.col("wanted.score").alias("wanted_score"))

    def windowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block, _, anchor in _met(batches):
            out = []
            others = np.flatnonzero(block.label != row["label"])
            wanted: dict[int, set[int]] = {}
            for i, score in zip(row["wanted_i"], row["wanted_score"]):
                if least * score <= most * score:
                    wanted.setdefault(i, set()).add(score)
            for i, scores in wanted.items() if len(others) else ():
                ordered = sorted(scores)
                windows = [(-(-least * s // 100), most * s // 100) for s in ordered]
                for s, (own, value) in zip(ordered, block.in_windows(anchor[i], others, windows, negatives)):
                    out += [(row["chunk"], i, s, v, n) for v, n in zip(value.tolist(), block.ids[own].tolist())]
            yield _found(out)

    every = _meet(blocks, chunks.hint("merge").join(asked_of, "chunk"), cells, ["dim"])
    held = every.select(*pair, "wanted_i", "wanted_score").mapInArrow(windowed, FOUND)
    order = Window.partitionBy("chunk", "i", "positive_score").orderBy(F.desc("score"), "vec_id")
    held = held.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    taken = held.select(
        "chunk", "i", F.col("positive_score").alias("score"), "rank",
        F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"),
    )
    names = chunks.mapInArrow(_anchor_names, "chunk long, i int, anchor_id long")
    # Stored places take a tenth of their size in a broadcast.
    named = best.hint("merge").join(taken, ["chunk", "i", "score"]).hint("merge").join(names, ["chunk", "i"])
    return named.select(
        "anchor_id",
        F.col("vec_id").alias("positive_id"),
        "rank",
        "negative_id",
        F.col("score").alias("positive_score"),
        "negative_score",
    )


def _anchor_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = np.frombuffer(row["ids"], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["chunk"]] * len(ids), pa.int64()), pa.array(range(len(ids)), pa.int32()), pa.array(ids)],
                names=["chunk", "i", "anchor_id"],
            )
