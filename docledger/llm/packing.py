"""Packing token sequences by non-negative least squares.

Documents longer than a window give whole windows and a rest. Rests of about equal length share a bin. All
combinations of up to three bins that fill a window are columns of a matrix; non-negative least squares finds
how often to repeat each so that together they use up the histogram of the rests. The counts are rounded, what
they leave is packed greedily, bin by bin, and what even that would pad is laid end to end and cut at windows,
the last one at powers of two. The histogram has a bounded number of bins, so the plan is made on the driver;
documents find their place from their rank in their bin, without a group of all equal lengths.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docledger.llm.common import Scratch, ship, slices

WINDOW = 2048
#: A combination that the greedy step may use leaves at most this part of a window empty.
WASTE = 64
#: Rests whose lengths are added up in one group.
POOL_GROUP = 1 << 14

PIECE = (
    "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, part int, bin int, turn long"
)


# ---- ids of whole texts ----

#: How a byte-level tokenizer file cuts texts, and the bytes that it writes as they are.
CUTS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: Longer runs of white space go to the library, as the faster matcher may not take them.
LONG_SPACE = re.compile(r"\s{10000}")


def byte_ranks(rules: dict) -> dict[bytes, int] | None:
    """Token bytes and ids of a tokenizer file whose ids are the order of its merges, else None.

    Only plain byte-level pair encoding will do: no normalizer, prefix space or post-processor, added tokens
    that stand for themselves alone, and one merge for each token, in the order of ids.
    """
    first, model = rules.get("pre_tokenizer") or {}, rules.get("model") or {}
    plain = first.get("type") == "ByteLevel" and not first.get("add_prefix_space") and first.get("use_regex", True)
    others = [rules.get(name) for name in ("normalizer", "post_processor", "truncation", "padding")]
    others += [model.get(name) for name in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix")]
    others += [model.get(name) for name in ("fuse_unk", "byte_fallback", "ignore_merges")]
    others += [token.get(name) for token in rules.get("added_tokens", []) for name in ("lstrip", "rstrip", "single_word")]
    if not plain or any(others) or model.get("type") != "BPE":
        return None
    hidden = [b for b in range(256) if b not in set(PRINTED)]
    byte_of = {chr(b): b for b in PRINTED} | {chr(256 + i): b for i, b in enumerate(hidden)}
    merged = ["".join(m.split(" ")) if isinstance(m, str) else "".join(m) for m in model["merges"]]
    order = [model["vocab"][token] for token in merged]
    if order != list(range(256, 256 + len(order))) or len(model["vocab"]) != 256 + len(order):
        return None
    return {bytes(map(byte_of.__getitem__, token)): i for token, i in model["vocab"].items()}


class Encoder:
    """Ids of whole texts as a tokenizers file gives them.

    A file of plain byte-level rules is run by tiktoken, which gives the same ids some times faster; texts
    that hold an added token, and all texts of other files, are encoded by the tokenizers library itself.
    """

    _made: dict = {}

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        ranks = byte_ranks(rules)
        self.added = [token["content"] for token in rules.get("added_tokens", [])]
        self.fast = ranks and tiktoken.Encoding("file", pat_str=CUTS, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text."""
        odd = any(token in text for token in self.added) or (len(text) >= 10_000 and LONG_SPACE.search(text))
        if self.fast and not odd:
            ids = self.fast.encode_ordinary(text)
        else:
            ids = self.library.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()


# ---- the plan ----


def bin_of(length: int, window: int = WINDOW) -> int:
    """The upper end of a length's bin; bins are at most 1/64 of their lengths wide."""
    width = 1 << max(0, (length - 1).bit_length() - 7)
    return min(window, -(-length // width) * width)


def combinations(bins: np.ndarray, window: int) -> np.ndarray:
    """Rows of up to three places in `bins` (-1: none), ascending, that fill a window to 1/256."""
    spare = window // 256
    found = [(int(i), -1, -1) for i in np.flatnonzero(bins >= window - spare)]
    for i, a in enumerate(bins):
        last = int(np.searchsorted(bins, window - a, "right")) - 1
        if last >= i and bins[last] + a >= window - spare:
            found.append((i, last, -1))
        second = np.arange(i, len(bins))
        third = np.searchsorted(bins, window - a - bins[second], "right") - 1
        fits = (third >= second) & (third >= 0)
        second, third = second[fits], third[fits]
        full = a + bins[second] + bins[third] >= window - spare
        found += [(i, int(j), int(k)) for j, k in zip(second[full], third[full])]
    return np.array(found, np.int64).reshape(-1, 3)


def least_squares(columns: np.ndarray, wanted: np.ndarray, rounds: int = 600) -> np.ndarray:
    """Non-negative repeats of the columns whose sum comes nearest to `wanted` (active sets)."""
    size = len(wanted)
    scale = max(float(wanted.max(initial=0)), 1.0)
    target = wanted / scale
    padded = np.where(columns < 0, size, columns)
    repeats = np.zeros(len(columns))
    active: list[int] = []
    matrix = np.zeros((size + 1, 0))
    for _ in range(rounds):
        residual = np.append(target - (matrix @ repeats[active])[:size], 0.0)
        gain = residual[padded].sum(axis=1)
        gain[active] = 0
        best = int(gain.argmax()) if len(gain) else -1
        if best < 0 or gain[best] < 1e-7:
            break
        column = np.zeros((size + 1, 1))
        np.add.at(column[:, 0], padded[best], 1.0)
        column[size] = 0
        active, matrix = [*active, best], np.hstack([matrix, column])
        while active:
            gram = matrix.T @ matrix
            gram[np.diag_indices(len(active))] += 1e-9
            solved = np.linalg.solve(gram, matrix[:size].T @ target)
            if (solved > 0).all():
                repeats[active] = solved
                break
            # Back along the way to the solution until the first repeat is zero; that column leaves.
            now, low = repeats[active], solved <= 0
            step = (now[low] / np.maximum(now[low] - solved[low], 1e-300)).min()
            now = now + step * (solved - now)
            stays = (now > 1e-12) & ~(low & (now <= 1e-9))
            repeats[active] = np.where(stays, now, 0)
            active, matrix = [a for a, s in zip(active, stays) if s], matrix[:, stays]
    return repeats * scale


class Slots(NamedTuple):
    """Ranks from `first` on of a bin: `count` rests, `times` in each sequence, from `sequence` and `place` on."""

    bin: int
    first: int
    count: int
    times: int
    sequence: int
    place: int


class Plan:
    """Where the rests of each bin go: into sequences by rank, and from a rank on end to end."""

    def __init__(self, histogram: dict[int, int], window: int = WINDOW):
        self.window, self.sequences = window, 0
        self.bins = np.array(sorted(histogram), np.int64)
        self.left = np.array([histogram[b] for b in self.bins.tolist()], np.int64)
        self.used = np.zeros(len(self.bins), np.int64)
        self.slots: list[Slots] = []
        if not len(self.bins):
            return
        columns = combinations(self.bins, window)
        repeats = np.rint(least_squares(columns, self.left)).astype(np.int64) if len(columns) else np.zeros(0, np.int64)
        for p in np.argsort(-repeats, kind="stable").tolist():
            items: dict[int, int] = {}
            for b in columns[p].tolist():
                if b >= 0:
                    items[b] = items.get(b, 0) + 1
            self._repeat(items, int(repeats[p]))
        self._greedy()

    def _repeat(self, items: dict[int, int], times: int) -> int:
        """Use a combination as often as wanted and as its bins allow."""
        times = min(times, *(int(self.left[b]) // n for b, n in items.items()))
        if times <= 0:
            return 0
        place = 0
        for b, n in sorted(items.items(), reverse=True):
            slot = Slots(int(self.bins[b]), int(self.used[b]), n * times, n, self.sequences, place)
            self.slots.append(slot)
            self.left[b] -= n * times
            self.used[b] += n * times
            place += n
        self.sequences += times
        return times

    def _greedy(self) -> None:
        """Combinations of any depth, longest first; bins that would pad too much stay for the end."""
        open_bins = self.left > 0
        while open_bins.any():
            first = int(np.flatnonzero(open_bins)[-1])
            space, items = self.window - int(self.bins[first]), {first: 1}
            for b in range(first, -1, -1):
                own = int(self.left[b]) - items.get(b, 0)
                n = min(own, space // int(self.bins[b]))
                if n > 0:
                    items[b] = items.get(b, 0) + n
                    space -= n * int(self.bins[b])
            if space * WASTE > self.window:
                open_bins[first] = False
            else:
                self._repeat(items, int(self.left[first]))
                open_bins &= self.left > 0

    def place(self, bins: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and place in it of rests by bin and rank; -1 for those laid end to end."""
        if not self.slots:
            return np.full(len(bins), -1), np.zeros(len(bins), np.int64)
        table = np.array(sorted(self.slots), np.int64).T
        key = lambda b, r: (b.astype(np.int64) << 44) | r
        at = np.maximum(np.searchsorted(key(table[0], table[1]), key(bins, ranks), "right") - 1, 0)
        own, first, count, times, sequence, place = table[:, at]
        inside = (own == bins) & (ranks >= first) & (ranks < first + count)
        turn = ranks - first
        return np.where(inside, sequence + turn // times, -1), np.where(inside, place + turn % times, 0)


# ---- the pieces ----


def _pieces(docs: DataFrame, tokenizer: str, window: int, end_id: int, doc_id: str, text: str) -> DataFrame:
    """Whole windows and rest of each document, numbered in their task and bin."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        from pyspark import TaskContext

        encoder, part = Encoder.of(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        turns = [0] * (window + 1)
        bins = [0, *(bin_of(n, window) for n in range(1, window + 1))]
        for batch in slices(batches):
            rows = []
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                code = encoder.encode(body or "") + end
                total = len(code) // 4
                for start in range(0, total, window):
                    length = min(window, total - start)
                    ids = code[4 * start : 4 * (start + length)]
                    own = bins[length]
                    rows.append((name, start, length, ids, zlib.crc32(ids), total, part, own, turns[own]))
                    turns[own] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    schema = pa.schema(
        [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())]
        + [("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int32()), ("bin", pa.int32())]
        + [("turn", pa.int64())]
    )
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, PIECE)


def _tail(total: int, window: int) -> list[int]:
    """Where the sequences of the last, open window begin: it is cut into powers of two."""
    starts, at = [], total // window * window
    while at < total:
        starts.append(at)
        at += 1 << (total - at).bit_length() - 1
    return starts


def _end_to_end(pool: DataFrame, total: int, first_sequence: int, window: int) -> DataFrame:
    """Rests laid one behind the other by bin and rank, cut at windows and in the last one at powers of two."""
    pool = pool.withColumn("pool", F.call_function("div", F.col("rank"), F.lit(POOL_GROUP)))
    sums = pool.groupBy("bin", "pool").agg(F.sum("length").alias("n"))
    # One row for POOL_GROUP rests.
    before = Window.orderBy("bin", "pool").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("bin", "pool", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("pool_start"))
    inside = Window.partitionBy("bin", "pool").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    laid = pool.withColumn("within", F.coalesce(F.sum("length").over(inside), F.lit(0))).join(starts, ["bin", "pool"])
    laid = laid.withColumn("at", F.col("pool_start") + F.col("within"))
    tail = F.lit(_tail(total, window)).cast("array<bigint>")
    ends = F.col("at") + F.col("length")
    boundary = (F.call_function("div", F.col("at"), F.lit(window)) + 1) * window
    cuts = F.array_sort(
        F.array_distinct(F.filter(F.concat(F.array(boundary), tail), lambda x: (x > F.col("at")) & (x < ends)))
    )
    spans = F.arrays_zip(
        F.concat(F.array("at"), cuts).alias("from"), F.concat(cuts, F.array(ends)).alias("to")
    )
    cut = laid.withColumn("span", F.explode(spans))
    start, end = F.col("span.from"), F.col("span.to")
    skipped = start - F.col("at")
    in_tail = F.filter(tail, lambda x: x <= start)
    full = total // window
    return cut.select(
        "doc_id",
        (F.col("start") + skipped).alias("start"),
        (end - start).alias("length"),
        F.expr("substring(ids, cast(4 * (span.from - at) + 1 as int), cast(4 * (span.to - span.from) as int))").alias("ids"),
        "doc_tokens",
        (
            F.lit(first_sequence)
            + F.when(F.size(in_tail) == 0, F.call_function("div", start, F.lit(window))).otherwise(full + F.size(in_tail) - 1)
        ).cast("long").alias("sequence_id"),
        F.when(F.size(in_tail) == 0, start % window).otherwise(start - F.array_max(in_tail)).alias("offset"),
    )


def pack(
    docs: DataFrame,
    tokenizer: str,
    window: int = WINDOW,
    end_id: int = 1,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Pieces of all documents and their places: doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset.

    `ids` holds a piece's ids as little-endian 32-bit numbers. A null text is empty and gives the end id
    alone; a document whose id is null or repeated is packed like any other; an empty table gives no rows.
    Only rests that would pad, and documents longer than a window, are cut. Other columns are left out.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "packing")
    pieces = scratch.keep(_pieces(docs, tokenizer, window, end_id, doc_id, text), "pieces")
    counts = scratch.keep(pieces.groupBy("part", "bin").agg(F.count("*").alias("n")), "counts")
    # A row for each bin, of which there are fewer than tokens in a window.
    histogram = {row["bin"]: row["n"] for row in counts.groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    plan = Plan(histogram, window)
    before = Window.partitionBy("bin").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("part", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(firsts, ["part", "bin"]).withColumn("rank", F.col("first") + F.col("turn"))

    @F.pandas_udf("sequence long, place long")
    def placed(bins: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        sequence, place = plan.place(bins.to_numpy(), ranks.to_numpy())
        return pd.DataFrame({"sequence": sequence, "place": place})

    found = ranked.withColumn("placed", placed("bin", "rank"))
    pooled = _pooled(plan)
    own = found.where(~pooled)
    # A full window is a sequence by itself.
    alone = own.where(F.col("bin") == window).withColumn("offset", F.lit(0).cast("long"))
    earlier = Window.partitionBy("placed.sequence").orderBy("placed.place").rowsBetween(Window.unboundedPreceding, -1)
    shared = own.where(F.col("bin") != window).withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0)))
    names = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    placed_rows = alone.unionByName(shared).withColumn("sequence_id", F.col("placed.sequence")).select(*names)
    if not plan.left.any():
        return placed_rows
    total = ranked.where(pooled).agg(F.sum("length")).first()[0]
    laid = _end_to_end(ranked.where(pooled), total, plan.sequences, window)
    return placed_rows.unionByName(laid.withColumn("ids_crc32", F.crc32("ids")).select(*names))


def _pooled(plan: Plan) -> Column:
    """Whether a rest's rank lies beyond those that have a place."""
    used = dict(zip(plan.bins.tolist(), plan.used.tolist()))
    if not used:
        return F.lit(False)
    pairs = [F.lit(value) for both in used.items() for value in both]
    return F.col("rank") >= F.element_at(F.create_map(*pairs), F.col("bin"))


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """(sequence_id, n_ids, ids) of packed pieces: ids padded to the window, but not at a power of two."""
    by_sequence = pieces.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("held")
    )
    n = F.aggregate("held", F.lit(0).cast("long"), lambda s, x: s + x["length"])
    ids = F.array_join(F.transform("held", lambda x: F.hex(x["ids"])), "")
    joined = by_sequence.select("sequence_id", n.alias("n_ids"), ids.alias("ids"))
    power = F.col("n_ids").bitwiseAND(F.col("n_ids") - 1) == 0
    pad = F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), (F.lit(window) - F.col("n_ids")).cast("int"))
    return joined.withColumn("ids", F.unhex(F.when(power, F.col("ids")).otherwise(F.concat("ids", pad))))


def default_tokenizer() -> str:
    """The public vocabulary file of the registered query, found where it is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
