"""Phrase collocations, counted in burst tries.

Each task counts the windows of up to four words that start at its words in a trie: a node's children hang by
word id, and a child is first a hash container of packed rests of windows, which bursts into a node when it
grows large. When a task holds too many windows its largest subtrees leave as sorted runs, cut by prefix
partition (language and first three words), so that no partition depends on how frequent a word or pair is.
Each prefix partition merges its runs and gives exact counts of all phrases that are frequent enough; scores
and containment are joins over those.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docledger.llm.common import Scratch, bytes_of, ship, slices

WORDS = 4
#: Bits of a word's id in a task; the ids of three words are one 63-bit key.
ID_BITS = 21
ID_MASK = (1 << ID_BITS) - 1
#: A container with more rests than this bursts; a task with more windows than this spills subtrees.
BURST = 1 << 14
HELD_WINDOWS = 1_000_000
#: Bytes of distinct words of a task after which it spills everything and numbers words anew.
HELD_WORD_BYTES = 48 << 20
#: Bytes of text counted at a time.
TEXT_BYTES = 1 << 20
#: Prefix partitions for each shuffle partition.
PARTITION_FACTOR = 2
#: Shares in which the phrases of a language are ranked before all together.
LANG_SHARES = 64
UNKNOWN_LANG = "und"

#: A-Z in lower case, tab as space, and every end of a piece as a full stop.
PIECES = bytes(
    b + 32 if 65 <= b <= 90 else 0x2E if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b for b in range(256)
)
RUN = "part int, run binary"
COUNT = "lang string, words array<string>, f long"


class WordIds(dict):
    """Ids of words from 1 on, given when a word is first looked up; the end of a piece is 0."""

    def __init__(self) -> None:
        super().__init__({b".": 0})
        self.size = 0

    def __missing__(self, word: bytes) -> int:
        self.size += len(word)
        self[word] = found = len(self)
        return found


class Node(dict):
    """Next word -> container or node."""

    def size(self) -> int:
        return sum(len(child) if type(child) is dict else child.size() for child in self.values())


class Trie:
    """Windows of one language: first word -> container or node -> ... of rests packed in integers."""

    def __init__(self) -> None:
        self.children: dict[int, dict | Node] = {}

    def add(self, words: np.ndarray, starts: int) -> int:
        """Count the windows at the first `starts` words, where 0 ends a piece; the number that are new."""
        words = np.concatenate([words, np.zeros(WORDS - 1, np.int64)])
        a, b, c, d = (words[i : starts + i] for i in range(WORDS))
        c = np.where(b == 0, 0, c)
        d = np.where(c == 0, 0, d)
        rest = (b << 2 * ID_BITS) | (c << ID_BITS) | d
        a, rest = a[a > 0], rest[a > 0]
        order = np.argsort(a, kind="stable")
        a, rest = a[order], rest[order]
        cuts = np.flatnonzero(np.diff(a, prepend=-1)).tolist()
        firsts, rests, held = a[cuts].tolist(), rest.tolist(), 0
        children = self.children
        for first, start, end in zip(firsts, cuts, [*cuts[1:], len(rests)]):
            child = children.get(first)
            if child is None:
                child = children[first] = {}
            held += self._count(children, first, child, rests[start:end], 2)
        return held

    def _count(self, parent: dict, word: int, child: dict | Node, rests: list[int], depth: int) -> int:
        """Count rests below a child; the number of windows that are new."""
        if type(child) is dict:
            before, get = len(child), child.get
            for rest in rests:
                child[rest] = get(rest, 0) + 1
            new = len(child) - before
            if len(child) > BURST and depth:
                parent[word] = self._burst(child, depth)
            return new
        shift, new, i = depth * ID_BITS, 0, 0
        low = (1 << shift) - 1
        rests.sort()
        while i < len(rests):
            following, start = rests[i] >> shift, i
            while i < len(rests) and rests[i] >> shift == following:
                i += 1
            below = child.get(following)
            if below is None:
                below = child[following] = {}
            new += self._count(child, following, below, [rest & low for rest in rests[start:i]], depth - 1)
        return new

    @staticmethod
    def _burst(container: dict, depth: int) -> Node:
        """A node with a container for each next word of the rests."""
        shift = depth * ID_BITS
        low = (1 << shift) - 1
        node = Node()
        for rest, n in container.items():
            node.setdefault(rest >> shift, {})[rest & low] = n
        return node

    def flat(self, first: int) -> dict:
        """The rests of a first word and their counts."""
        child = self.children[first]
        return child if type(child) is dict else self._flat(child, 2)

    def _flat(self, node: Node, depth: int) -> dict:
        out = {}
        for word, child in node.items():
            above = word << depth * ID_BITS
            below = child if type(child) is dict else self._flat(child, depth - 1)
            out.update({above | rest: n for rest, n in below.items()})
        return out


def _with_prefixes(a: np.ndarray, rest: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted entries (a, b, c, d) of a run: windows of three words and more, and totals of pairs and words."""
    order = np.lexsort((rest, a))
    a, rest, n = a[order], rest[order], n[order]
    b, c, d = rest >> 2 * ID_BITS, (rest >> ID_BITS) & ID_MASK, rest & ID_MASK
    new_word = np.diff(a, prepend=-1) != 0
    new_pair = new_word | (np.diff(b, prepend=-1) != 0)
    at_word, at_pair = np.flatnonzero(new_word), np.flatnonzero(new_pair)
    at_long, is_pair = np.flatnonzero(c), b[at_pair] > 0
    counts = [np.add.reduceat(n, at_word), np.add.reduceat(n, at_pair)[is_pair], n[at_long]]
    at_pair = at_pair[is_pair]
    # A word's total comes before its pairs, a pair's before its windows.
    order = np.argsort(np.concatenate([3 * at_word, 3 * at_pair + 1, 3 * at_long + 2]), kind="stable")
    words, pairs = len(at_word), len(at_word) + len(at_pair)
    keys = np.stack([x[np.concatenate([at_word, at_pair, at_long])] for x in (a, b, c, d)])
    keys[1:, :words] = 0
    keys[2:, words:pairs] = 0
    return keys[:, order], np.concatenate(counts)[order]


def _packed(lang: str, names: list[bytes], keys: np.ndarray, counts: np.ndarray) -> bytes:
    """A sorted run: its language, its own words in byte order, ranks of words by column, counts."""
    kind = "<u2" if len(names) <= 1 << 16 else "<u4"
    name = lang.encode()
    # No word holds a full stop, so it parts the words.
    head = b".".join(names)
    sizes = np.array([len(name), len(head), len(names), len(counts)], "<i8").tobytes()
    body = b"".join([sizes, name, head, keys.astype(kind).tobytes(), counts.astype("<i8").tobytes()])
    return zstandard.ZstdCompressor(level=1).compress(body)


def _unpacked(run: bytes) -> tuple[str, list[bytes], np.ndarray, np.ndarray]:
    body = zstandard.ZstdDecompressor().decompress(run)
    name, head, words, entries = np.frombuffer(body, "<i8", 4).tolist()
    at = 32 + name + head
    lang, names = body[32 : 32 + name].decode(), body[32 + name : at].split(b".")
    kind = np.dtype("<u2" if words <= 1 << 16 else "<u4")
    keys = np.frombuffer(body, kind, WORDS * entries, at).reshape(WORDS, entries)
    counts = np.frombuffer(body, "<i8", entries, at + kind.itemsize * WORDS * entries)
    return lang, names, keys, counts


class Counting:
    """The tries of one task, and the runs that leave them."""

    def __init__(self, parts: int):
        self.parts = parts
        self.start()

    def start(self) -> None:
        self.ids = WordIds()
        self.tries: dict[str, Trie] = {}
        self.held = 0

    def add(self, lang: str, texts: list[bytes]) -> Iterator[tuple[int, bytes]]:
        """Count texts, a bounded number of bytes at a time; the runs that this drives out."""
        body = b".".join(texts).translate(PIECES).replace(b".", b" . ")
        at, carried = 0, []
        while at < len(body):
            end = body.find(b" ", at + TEXT_BYTES)
            end = len(body) if end < 0 else end
            tokens = carried + body[at:end].split()
            # Windows that reach beyond these words start with the next.
            starts = len(tokens) if end == len(body) else max(len(tokens) - WORDS + 1, 0)
            found = np.fromiter(map(self.ids.__getitem__, tokens), np.int64, len(tokens))
            self.held += self.tries.setdefault(lang, Trie()).add(found, starts)
            at, carried = end, tokens[starts:]
            if len(self.ids) > ID_MASK - TEXT_BYTES or self.ids.size > HELD_WORD_BYTES:
                yield from self.spill(0)
                self.start()
            elif self.held > HELD_WINDOWS:
                yield from self.spill(HELD_WINDOWS // 4)

    def spill(self, leave: int) -> Iterator[tuple[int, bytes]]:
        """The largest subtrees as runs, until so many windows are left."""
        largest = [
            (len(child) if type(child) is dict else child.size(), lang, word)
            for lang, trie in self.tries.items()
            for word, child in trie.children.items()
        ]
        largest.sort(reverse=True)
        leaving: dict[str, list[int]] = {}
        for size, lang, word in largest:
            if self.held <= leave:
                break
            leaving.setdefault(lang, []).append(word)
            self.held -= size
        words = list(self.ids)
        words[0] = b""
        order = sorted(range(len(words)), key=words.__getitem__)
        words = [words[i] for i in order]
        # From here on a word's number is its place in byte order; the empty one stays 0.
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        hashes = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
        used = np.zeros(len(words), bool)
        for lang, firsts in leaving.items():
            trie = self.tries[lang]
            taken = [trie.flat(word) for word in firsts]
            sizes = list(map(len, taken))
            total = sum(sizes)
            rest = np.fromiter(chain.from_iterable(taken), np.int64, total)
            n = np.fromiter(chain.from_iterable(map(dict.values, taken)), np.int64, total)
            del taken
            for word in firsts:
                del trie.children[word]
            b, c, d = place[rest >> 2 * ID_BITS], place[(rest >> ID_BITS) & ID_MASK], place[rest & ID_MASK]
            rest = (b << 2 * ID_BITS) | (c << ID_BITS) | d
            keys, counts = _with_prefixes(place[np.repeat(np.array(firsts, np.int64), sizes)], rest, n)
            part = self._parts(lang, hashes, keys)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order], prepend=-1)).tolist()
            rank = np.zeros(len(words), np.int64)
            for start, end in zip(cuts, [*cuts[1:], len(order)]):
                own = order[start:end]
                entries = keys[:, own]
                used[entries] = True
                names = np.flatnonzero(used)
                used[names] = False
                rank[names] = np.arange(len(names))
                yield int(part[own[0]]), _packed(lang, [words[i] for i in names.tolist()], rank[entries], counts[own])

    def _parts(self, lang: str, hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Prefix partition of each entry: by its language and first three words, whatever the task."""
        mixed = np.full(keys.shape[1], zlib.crc32(lang.encode()), np.uint64)
        for word in keys[: WORDS - 1]:
            mixed = (mixed ^ hashes[word]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        return (mixed % np.uint64(self.parts)).astype(np.int64)


def merged(runs: Iterable[bytes], least: int) -> Iterator[tuple[str, list[str], int]]:
    """Runs of one prefix partition to (lang, words, count): frequent phrases, and no words for all words of a language."""
    by_lang: dict[str, list] = {}
    for run in runs:
        lang, *held = _unpacked(run)
        by_lang.setdefault(lang, []).append(held)
    for lang, held in by_lang.items():
        names = sorted(set(chain.from_iterable(words for words, _, _ in held)))
        rank = {word: i for i, word in enumerate(names)}
        own = [np.fromiter(map(rank.__getitem__, words), np.int64, len(words))[keys] for words, keys, _ in held]
        keys, counts = np.concatenate(own, axis=1), np.concatenate([n for *_, n in held])
        del own, held
        order = np.lexsort(((keys[2] << 32) | keys[3], (keys[0] << 32) | keys[1]))
        keys, counts = keys[:, order], counts[order]
        new = np.zeros(len(counts), bool)
        none = 0 if names[0] == b"" else -1
        for length in range(1, WORDS + 1):
            # Entries of fewer than three words are totals of their own; longer ones add up to their prefixes.
            new |= np.diff(keys[length - 1], prepend=-2) != 0
            own_length = (keys[length - 1] != none) & ((length == WORDS) | (length == 3) | (keys[min(length, 3)] == none))
            starts = np.flatnonzero(new)
            sums = np.add.reduceat(np.where(own_length, counts, 0), starts)
            if length == 1:
                yield lang, [], int(sums.sum())
            for at, f in zip(starts[sums >= least].tolist(), sums[sums >= least].tolist()):
                yield lang, [names[i].decode() for i in keys[:length, at].tolist()], f


def phrase_counts(docs: DataFrame, least: int, scratch: Scratch, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, words, f): exact counts of all phrases of up to four words that occur `least` times or more.

    The row with no words holds, summed, the occurrences of all words of its language.
    """
    ship(docs.sparkSession)
    parts = PARTITION_FACTOR * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = Counting(parts)
        for batch in slices(batches, 4096, TEXT_BYTES):
            texts: dict[str, list[bytes]] = {}
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts.setdefault(name, []).append(body)
            for name, bodies in texts.items():
                yield from _rows(counting.add(name, bodies))
        yield from _rows(counting.spill(0))

    def merged_group(key: tuple, rows: pa.Table) -> pa.Table:
        found = merged((run.as_py() for chunk in rows.column("run").chunks for run in chunk), least)
        return pa.Table.from_pylist([{"lang": n, "words": w, "f": f} for n, w, f in found], schema=COUNT_SCHEMA)

    bodies = docs.select(F.coalesce(F.col(lang), F.lit(UNKNOWN_LANG)).alias("lang"), bytes_of(text).alias("text"))
    runs = bodies.mapInArrow(counted, RUN)
    return scratch.keep(runs.groupBy("part").applyInArrow(merged_group, COUNT), "counts")


RUN_SCHEMA = pa.schema([("part", pa.int32()), ("run", pa.binary())])
COUNT_SCHEMA = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("f", pa.int64())])


def _rows(runs: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Runs as record batches of a few MB."""
    parts: list[int] = []
    held: list[bytes] = []
    for part, run in runs:
        parts.append(part)
        held.append(run)
        if len(held) >= 64:
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(held, pa.binary())], schema=RUN_SCHEMA)
            parts, held = [], []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(held, pa.binary())], schema=RUN_SCHEMA)


def _wide(column: Column | str) -> Column:
    """A number whose products can't pass its type."""
    return F.col(column).cast("decimal(20,0)") if isinstance(column, str) else column.cast("decimal(20,0)")


def collocations(
    docs: DataFrame,
    least: int = 30,
    per_lang: int = 2000,
    contained_percent: int = 80,
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of 2 to 4 words of each language.

    A null text is empty and a null language `und`, together with rows that say so themselves; a language
    without a frequent phrase has no row, and an empty table gives none. Repeated rows count as often as they
    occur; ties go to the more frequent phrase, then to the smaller in bytes. A text of any length is
    counted whole; other columns are left out, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    counts = phrase_counts(docs, least, scratch, text, lang)
    totals = counts.where(F.size("words") == 0).groupBy("lang").agg(F.sum("f").alias("n"))
    phrases = counts.where(F.size("words") > 0)
    known = phrases.select("lang", F.array_join("words", " ").alias("part"), F.col("f").alias("part_f"))
    candidates = phrases.where(F.size("words") > 1).select(
        "lang", "words", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a")
    )
    # Both parts of a frequent phrase are at least as frequent, so the counts hold them all.
    cuts = candidates.select(
        "lang", "words", "phrase", "a", F.explode(F.expr("sequence(1, size(words) - 1)")).alias("k")
    )
    sides = cuts.select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.expr("slice(words, k + 1, size(words) - k)"), " ").alias("rest"),
    )
    left = known.withColumnsRenamed({"part": "first", "part_f": "l"})
    right = known.withColumnsRenamed({"part": "rest", "part_f": "r"})
    joined = sides.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    score = F.call_function("div", _wide("a") * F.lit(2_000_000), _wide("l") + _wide("r"))
    best = (
        joined.withColumn("score", score)
        .groupBy("lang", "phrase", "a")
        .agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("cut"))
        .select("lang", "phrase", "a", "cut.*")
    )
    inner = F.expr(
        "flatten(transform(sequence(2, size(words) - 1), w -> transform(sequence(1, size(words) - w + 1), "
        "i -> array_join(slice(words, i, w), ' '))))"
    )
    held = (
        candidates.where(F.size("words") > 2)
        .select("lang", F.explode(inner).alias("phrase"), "a")
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("longer"))
    )
    alone = F.col("longer").isNull() | (_wide("longer") * 100 < _wide("a") * contained_percent)
    kept = best.join(held, ["lang", "phrase"], "left").where(alone)
    # A language may have most phrases: each of its shares is cut to the wanted number first.
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    dealt = kept.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(LANG_SHARES)))
    turn = F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))
    best = dealt.withColumn("turn", turn).where(F.col("turn") <= per_lang)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    ranked = best.withColumn("rank", rank).where(F.col("rank") <= per_lang)
    # One row per language.
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
