"""Benchmark decontamination: Wu-Manber search for many word windows at once.

The symbols of the search are words. Windows of one length make a `Searcher`: a table of shifts per
block of words skips the positions where no window can end, a bucket per suffix block (split by the
first block) names the windows that may end there, and a direct comparison confirms each.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.llm.common import ALNUM, Scratch, bytes_of, free_name, ship

WINDOW = 13
#: Bytes of benchmark text that one set of search tables holds; more text takes further passes.
PASS_BYTES = 16 << 20


def words(text: bytes) -> list[bytes]:
    """Words of letters and digits; only A-Z change case."""
    return text.translate(ALNUM).split()


class Searcher:
    """Wu-Manber tables for windows of one length."""

    def __init__(self, length: int, windows: dict[tuple[bytes, ...], list[str]]):
        self.length, self.block = length, min(2, length)
        self.far = length - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = defaultdict(lambda: defaultdict(list))
        for window, items in windows.items():
            for end in range(self.block, length + 1):
                key = self.key(window, end)
                self.shift[key] = min(self.shift.get(key, self.far), length - end)
            prefix = self.key(window, self.block)
            self.buckets[self.key(window, length)][prefix].append((list(window), items))

    def key(self, symbols, end: int):
        return symbols[end - 1] if self.block == 1 else (symbols[end - 2], symbols[end - 1])

    def find(self, text: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """Start and items of every occurrence."""
        length, shift, far, block = self.length, self.shift, self.far, self.block
        end, size = length, len(text)
        while end <= size:
            key = text[end - 1] if block == 1 else (text[end - 2], text[end - 1])
            step = shift.get(key, far)
            if step:
                end += step
                continue
            start = end - length
            prefix = text[start] if block == 1 else (text[start], text[start + 1])
            for window, items in self.buckets[key].get(prefix, ()):
                if text[start:end] == window:
                    yield start, items
            end += 1


def searchers(items: Iterable[tuple[str, bytes]], window: int) -> list[Searcher]:
    by_length: dict = defaultdict(lambda: defaultdict(list))
    for item, text in items:
        found = words(text)
        length = min(window, len(found))
        if not length:
            continue
        for w in {tuple(found[i : i + length]) for i in range(len(found) - length + 1)}:
            by_length[length][w].append(item)
    return [Searcher(n, windows) for n, windows in sorted(by_length.items())]


def search(tables: list[Searcher], text: bytes) -> tuple[int, list[int], set[str]]:
    """Words of the text, the hit ones as [start, end, start, end, ...] spans, items that occur."""
    found, items, hits = words(text), set(), []
    for table in tables:
        for start, names in table.find(found):
            hits.append((start, start + table.length))
            items.update(names)
    return len(found), merged(hits), items


def merged(hits: list[tuple[int, int]]) -> list[int]:
    spans: list[int] = []
    for start, end in sorted(hits):
        if spans and start <= spans[-1]:
            spans[-1] = max(spans[-1], end)
        else:
            spans += [start, end]
    return spans


def find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """Every row and column of `docs` with n_words, hit_spans, n_hit, items and contaminated.

    hit_spans are word positions [start, end, ...] inside any occurrence of `window` consecutive words
    of an item (or of all its words, if it has fewer); items are the ids, as strings in order.
    contaminated: at least one word in 20 is hit. The search tables go to the executors: they are
    built from at most `pass_bytes` of item text; a larger benchmark takes several passes whose
    results are joined row by row.

    A null or wordless text has no hits, an item without words never occurs, one without an id
    marks its words but has no name to be listed, equal items all count, an empty benchmark leaves all documents clean. Rows are never grouped, so repeated rows and
    null ids are kept. Columns of `docs` with the names of the results are replaced.
    """
    ship(docs.sparkSession)
    found, known = free_name(docs, "found"), free_name(docs, "known")
    result = "struct<n_words: long, hit_spans: array<int>, items: array<string>>"
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), bytes_of(item_text).alias("body"))
    scratch, kept, waiting, size = Scratch(docs.sparkSession, "decontaminate"), None, [], 0
    for row in items.toLocalIterator():
        if waiting and size + len(row.body) > pass_bytes:  # the driver, too, holds the text of one pass only
            done = scratch.keep(_searched(docs, waiting, text, window, found, known, result), "pass")
            if kept is not None:
                scratch.drop(kept)
            docs = kept = done
            waiting, size = [], 0
        waiting.append((row.id, bytes(row.body)))
        size += len(row.body)
    return _finished(_searched(docs, waiting, text, window, found, known, result), found)


def _searched(docs, items, text, window, found, known, result) -> DataFrame:
    # The key tells a worker which tables it has built already.
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, items))

    @F.pandas_udf(result)
    def scan(bodies: pd.Series) -> pd.DataFrame:
        tables = tables_of(shared, window)
        rows = [search(tables, body) for body in bodies]
        return pd.DataFrame(
            {
                "n_words": [r[0] for r in rows],
                "hit_spans": [r[1] for r in rows],
                "items": [sorted(r[2] - {None}) for r in rows],
            }
        )

    if found not in docs.columns:
        return docs.withColumn(found, scan(bytes_of(text)))

    @F.pandas_udf("array<int>")
    def union(first: pd.Series, second: pd.Series) -> pd.Series:
        pairs = [[*zip(a[::2], a[1::2]), *zip(b[::2], b[1::2])] for a, b in zip(first, second)]
        return pd.Series([merged(p) for p in pairs])

    twice = docs.withColumnRenamed(found, known).withColumn(found, scan(bytes_of(text)))
    both = F.struct(
        F.col(f"{found}.n_words").alias("n_words"),
        union(F.col(f"{known}.hit_spans"), F.col(f"{found}.hit_spans")).alias("hit_spans"),
        F.array_sort(F.array_union(f"{known}.items", f"{found}.items")).alias("items"),
    )
    return twice.withColumn(found, both).drop(known)


_TABLES: dict = {}


def tables_of(shared, window: int) -> list[Searcher]:
    """The tables of this worker, built once for each broadcast."""
    key, items = shared.value
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = searchers(items, window)
    return _TABLES[key]


def _finished(docs: DataFrame, found: str) -> DataFrame:
    spans = F.col(f"{found}.hit_spans")
    hit = F.aggregate(
        F.transform(spans, lambda x, i: F.when(i % 2 == 1, x.cast("long")).otherwise(-x.cast("long"))),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )
    done = docs.withColumns(
        {
            "n_words": F.col(f"{found}.n_words"),
            "hit_spans": spans,
            "n_hit": hit,
            "items": F.col(f"{found}.items"),
        }
    )
    share = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return done.withColumn("contaminated", share).drop(found)


def report(found: DataFrame) -> DataFrame:
    """The digest of the registered query."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def sha256_of(items: Iterable[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
