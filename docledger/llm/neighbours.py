"""Nearest neighbours through stable projections.

Vectors are projected on a few Gaussian directions: for a vector at distance d, the squared projected
distance over d squared is chi-square distributed. A kd-tree over the projections gives its leaves in
the order of projected distance; their vectors are verified by true distance, until the chi-square test
says that a vector nearer than the k-th found would have come up already with the wanted probability.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docledger.llm.common import Scratch, ship, slices

DIRECTIONS = 8
CONFIDENCE = 0.99
LEAF = 64
#: Vectors of one tree, and queries that meet a tree in one task, about.
BLOCK_ROWS = 20_000
BLOCK_QUERIES = 2_000
SEED = 29

INDEX = "block int, dim int, ids binary, vectors binary, low binary, high binary, nodes binary"


def chi_square(x: float, freedom: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    half, term, total = x / 2, 1.0, 1.0
    for i in range(1, freedom // 2):
        term *= half / i
        total += term
    return 1 - math.exp(-half) * total


def directions(dim: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed + dim).standard_normal((dim, DIRECTIONS))


class Tree:
    """A kd-tree over projected vectors. A node is (left, right, start, end); a leaf has no children."""

    def __init__(self, ids, vectors, low, high, nodes):
        self.ids, self.vectors, self.low, self.high, self.nodes = ids, vectors, low, high, nodes

    @staticmethod
    def build(ids: np.ndarray, vectors: np.ndarray, most_equal: int) -> Tree:
        """Of equal vectors the `most_equal` smallest ids stay: no others can be among the nearest."""
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        new = np.concatenate([[True], (vectors[1:] != vectors[:-1]).any(axis=1)])
        rank = np.arange(len(ids)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        ids, vectors = ids[rank < most_equal], vectors[rank < most_equal]
        points = vectors @ directions(vectors.shape[1])
        order, nodes, low, high = np.arange(len(ids)), [], [], []
        waiting = [(0, len(ids), -1, 0)]
        while waiting:
            start, end, parent, side = waiting.pop()
            own = points[order[start:end]]
            low.append(own.min(axis=0))
            high.append(own.max(axis=0))
            if parent >= 0:
                nodes[parent][side] = len(nodes)
            nodes.append([-1, -1, start, end])
            wide = high[-1] - low[-1]
            if end - start > LEAF and wide.max() > 0:
                middle = (end - start) // 2
                cut = np.argpartition(own[:, wide.argmax()], middle)
                order[start:end] = order[start:end][cut]
                here = len(nodes) - 1
                waiting += [(start, start + middle, here, 0), (start + middle, end, here, 1)]
        return Tree(ids[order], vectors[order], np.array(low), np.array(high), np.array(nodes, np.int64))

    def row(self, block: int) -> dict:
        raw = {n: getattr(self, n).tobytes() for n in ("ids", "vectors", "low", "high", "nodes")}
        return {"block": block, "dim": self.vectors.shape[1], **raw}

    @staticmethod
    def of(row: dict) -> Tree:
        read = lambda name, kind, width: np.frombuffer(row[name], kind).reshape(-1, width)
        return Tree(
            np.frombuffer(row["ids"], np.int64),
            read("vectors", np.float64, row["dim"]),
            read("low", np.float64, DIRECTIONS),
            read("high", np.float64, DIRECTIONS),
            read("nodes", np.int64, 4),
        )

    def gap(self, point: np.ndarray, nodes: list[int]) -> np.ndarray:
        """Squared projected distance from a point to the boxes of nodes."""
        out = np.maximum(self.low[nodes] - point, 0) + np.maximum(point - self.high[nodes], 0)
        return (out * out).sum(axis=1)

    def nearest(self, own: int, vector: np.ndarray, k: int, confidence: float) -> list[tuple[float, int]]:
        """(distance, id) of the k nearest found, without the rows of the own id."""
        point = vector @ directions(len(vector))
        heap = [(float(self.gap(point, [0])[0]), 0)]
        best_d, best_id = np.zeros(0), np.zeros(0, np.int64)
        while heap:
            gap, node = heapq.heappop(heap)
            if len(best_d) == k:
                worst = best_d[-1] ** 2
                if (gap > 0 if worst == 0 else chi_square(gap / worst, DIRECTIONS) >= confidence):
                    break
            left, right, start, end = self.nodes[node]
            if left >= 0:
                for child, g in zip((left, right), self.gap(point, [left, right])):
                    heapq.heappush(heap, (float(g), int(child)))
                continue
            away = self.vectors[start:end] - vector
            d = np.sqrt((away * away).sum(axis=1))
            ids = self.ids[start:end]
            keep = ids != own
            if len(best_d) == k:
                keep &= d <= best_d[-1]
            if not keep.any():
                continue
            best_d, best_id = np.concatenate([best_d, d[keep]]), np.concatenate([best_id, ids[keep]])
            order = np.lexsort((best_id, best_d))[:k]
            best_d, best_id = best_d[order], best_id[order]
        return list(zip(best_d.tolist(), best_id.tolist()))


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, vector) in double precision; a row repeated in full counts once."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    v = F.col("vector")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("id").isNotNull() & fine & F.exists(v, lambda x: x != 0)).distinct()


def build_index(vectors: DataFrame, k: int, block_rows: int = BLOCK_ROWS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A tree for each block of rows; blocks are dealt by hash, so equal vectors spread over all."""
    rows = usable(vectors, vec_id, vector)
    blocks = max(1, -(-vectors.count() // block_rows))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)).cast("int"))
    dealt = dealt.withColumn("dim", F.size("vector"))

    def built(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        row = Tree.build(ids, flat.reshape(len(ids), -1), k + 1).row(table.column("block")[0].as_py())
        return pa.Table.from_pylist([row], schema=schema)

    schema = pa.schema(
        [("block", pa.int32()), ("dim", pa.int32())]
        + [(n, pa.binary()) for n in ("ids", "vectors", "low", "high", "nodes")]
    )
    return dealt.groupBy("block", "dim").applyInArrow(built, INDEX)


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    confidence: float = CONFIDENCE,
    block_rows: int = BLOCK_ROWS,
    block_queries: int = BLOCK_QUERIES,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of all `vectors` for each row of `queries`.

    Euclidean distance in double precision, ties to the smaller id; rows with the query's own id are
    no candidates. A neighbour is missed with a probability of at most 1 - `confidence` over the
    directions. Rows whose id is null, or whose vector is null, all zeros or empty, or holds a null or
    non-finite component, take no part; a row repeated in full counts once; vectors of another
    length than the query's are no candidates; empty tables give no rows; other columns are ignored.

    Every block of queries meets every tree in a task of its own: trees are as many as the data needs,
    and neither side has to fit in a task or the driver.
    """
    ship(vectors.sparkSession)
    scratch = Scratch(vectors.sparkSession, "neighbours")
    index = scratch.keep(build_index(vectors, k, block_rows, vec_id, vector), "index")
    asked = usable(queries, vec_id, vector).withColumn("dim", F.size("vector"))
    lots = max(1, -(-queries.count() // block_queries))
    trees = index.select("block", "dim")
    lot = F.pmod(F.xxhash64("id"), F.lit(lots)).cast("int")
    asked = asked.withColumn("lot", lot).join(trees, "dim")
    empty = F.lit(None).cast("binary")
    tree_rows = index.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1)))).select(
        "block", "dim", "lot", F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<double>").alias("vector"),
        "ids", "vectors", "low", "high", "nodes",
    )
    query_rows = asked.select(
        "block", "dim", "lot", "id", "vector", *[empty.alias(n) for n in ("ids", "vectors", "low", "high", "nodes")]
    )
    key = ["block", "dim", "lot"]
    dealt = tree_rows.unionByName(query_rows).repartition(*key).sortWithinPartitions(*key, F.col("id").asc_nulls_first())

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in slices(batches, 256):
            found: list[tuple[int, int, float]] = []
            for row in batch.to_pylist():
                if row["id"] is None:
                    tree = Tree.of(row)
                    continue
                query = np.array(row["vector"])
                found += [(row["id"], other, d) for d, other in tree.nearest(row["id"], query, k, confidence)]
            columns = list(zip(*found)) or [[], [], []]
            kinds = (pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], names=["query_id", "vec_id", "score"]
            )

    near = dealt.mapInArrow(searched, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
