"""Language identification by prediction by partial matching.

Each language has a byte context tree up to `ORDER` bytes deep, learned from all training texts and
then frozen. The code length of a byte is -log2 of its share in the longest known context; a byte that
is new there pays the context's escape (method C: as likely as all its distinct bytes together) and
is coded in the context one byte shorter, down to a uniform byte. The language whose tree codes the whole
text in the fewest bits wins.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.llm.common import free_name, ship, slices

ORDER = 3
#: Bytes of the frozen trees held at a time; larger ones are cut to parts, and nothing is left out.
MODEL_BYTES = 64 << 20
#: Bytes coded at a time.
PIECE = 1 << 19
NO_LANGUAGE = "und"
GRAM_COUNTS = "lang string, gram long, n long"


def grams(data: np.ndarray) -> np.ndarray:
    """Keys of all runs of ORDER + 1 bytes."""
    size = len(data) - ORDER
    keys = np.zeros(max(size, 0), np.uint32)
    for i in range(ORDER + 1):
        keys = (keys << np.uint32(8)) | data[i : i + size]
    return keys


def pieces(text: bytes) -> Iterator[np.ndarray]:
    """A text behind ORDER zero bytes, cut to bounded pieces that repeat their context."""
    padded = np.frombuffer(b"\0" * ORDER + text, np.uint8)
    for start in range(0, max(len(text), 1), PIECE):
        yield padded[start : start + PIECE + ORDER]


def count_grams(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """How often each run of ORDER + 1 bytes occurs in each language, over all texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            keys = np.concatenate([p[0] for p in parts])
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], np.concatenate([p[1] for p in parts])[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            return keys[first], np.add.reduceat(n, first)

        def rows() -> Iterator[pa.RecordBatch]:
            for name, parts in held.items():
                keys, n = merged(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(keys)), pa.array(keys.astype(np.int64)), pa.array(n)],
                    names=["lang", "gram", "n"],
                )

        for batch in slices(batches):
            waiting: dict[str, list] = {}
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                waiting.setdefault(name, []).extend(grams(p) for p in pieces(body) if len(p) > ORDER)
            for name, keys in waiting.items():
                if keys:
                    held.setdefault(name, []).append(np.unique(np.concatenate(keys), return_counts=True))
            size += sum(len(p[-1][0]) for p in held.values() if p)
            if size > 4_000_000:  # merge, and hand on what does not shrink
                held = {name: [merged(parts)] for name, parts in held.items()}
                size = sum(len(p[0][0]) for p in held.values())
                if size > 2_000_000:
                    yield from rows()
                    held, size = {}, 0
        yield from rows()

    ship(docs.sparkSession)
    body = F.lower(F.col(text)).cast("binary")
    chosen = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string"), body)
    partial = chosen.mapInArrow(counted, GRAM_COUNTS)
    return partial.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Frozen context trees of all languages, as code lengths in bits by known run of bytes."""

    def __init__(self, langs: list[str], keys: np.ndarray, counts: np.ndarray):
        """keys: sorted runs of ORDER + 1 bytes; counts: a column for each language."""
        self.langs = langs
        #: Runs of this range are coded here, others by other parts.
        self.low, self.high = 0, 1 << 32
        self.keys: list[np.ndarray] = []
        self.bits: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.escapes: list[np.ndarray] = []
        levels = [(keys.astype(np.uint32), counts.astype(np.int64))]
        for order in range(ORDER - 1, -1, -1):  # shorter runs: drop the first byte
            longer, n = levels[0]
            short = longer & np.uint32((1 << (8 * (order + 1))) - 1)
            unique, place = np.unique(short, return_inverse=True)
            total = np.zeros((len(unique), n.shape[1]), np.int64)
            np.add.at(total, place, n)
            levels.insert(0, (unique, total))
        for order, (known, n) in enumerate(levels):
            context, place = np.unique(known >> np.uint32(8), return_inverse=True)
            seen = np.zeros((len(context), n.shape[1]), np.int64)
            kinds = np.zeros_like(seen)
            np.add.at(seen, place, n)
            np.add.at(kinds, place, (n > 0).astype(np.int64))
            whole = np.maximum(seen + kinds, 1)
            escape = np.where(kinds > 0, -np.log2(np.maximum(kinds, 1) / whole), 0.0)
            shorter = self.cost(known & np.uint32((1 << (8 * order)) - 1), order - 1)
            coded = -np.log2(np.maximum(n, 1) / whole[place])
            self.bits.append(np.where(n > 0, coded, escape[place] + shorter).astype(np.float32))
            self.keys.append(known)
            self.contexts.append(context)
            self.escapes.append(escape.astype(np.float32))

    def parts(self, room: int) -> Iterator[Model]:
        """The model cut by ranges of its longest runs, `room` of them in each; shorter ones are in all parts."""
        known, context = self.keys[-1], self.contexts[-1]
        for start in range(0, len(known), room):
            part = copy.copy(self)
            part.low = int(known[start]) if start else 0
            part.high = int(known[start + room]) if start + room < len(known) else 1 << 32
            part.keys = [*self.keys[:-1], known[start : start + room].copy()]
            part.bits = [*self.bits[:-1], self.bits[-1][start : start + room].copy()]
            first = np.searchsorted(context, part.low >> 8)
            last = np.searchsorted(context, (part.high - 1) >> 8, side="right")
            part.contexts = [*self.contexts[:-1], context[first:last].copy()]
            part.escapes = [*self.escapes[:-1], self.escapes[-1][first:last].copy()]
            yield part

    def cost(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Code lengths of the last byte of each run, a column for each language."""
        if order < 0:
            return np.full((len(keys), len(self.langs)), 8.0, np.float32)
        known = self.keys[order]
        if not len(known):
            return self.cost(keys, order - 1)
        place = np.searchsorted(known, keys)
        place[place == len(known)] = 0
        hit = known[place] == keys
        out = self.bits[order][place]
        if not hit.all():
            new = keys[~hit]
            context = new >> np.uint32(8)
            at = np.searchsorted(self.contexts[order], context)
            at[at == len(self.contexts[order])] = 0
            escape = np.where((self.contexts[order][at] == context)[:, None], self.escapes[order][at], 0)
            out[~hit] = escape + self.cost(new & np.uint32((1 << (8 * order)) - 1), order - 1)
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each whole text in each language."""
        out = np.zeros((len(texts), len(self.langs)))
        waiting: list[np.ndarray] = []
        owners: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            for piece in pieces(text):
                if len(piece) > ORDER:
                    waiting.append(grams(piece))
                    owners.append(i)
                    size += len(waiting[-1])
                if size >= PIECE:
                    self._add(out, waiting, owners)
                    waiting, owners, size = [], [], 0
        self._add(out, waiting, owners)
        return out

    def _add(self, out: np.ndarray, waiting: list[np.ndarray], owners: list[int]) -> None:
        if waiting:
            starts = np.cumsum([0, *[len(w) for w in waiting[:-1]]])
            runs = np.concatenate(waiting)
            if self.low or self.high < 1 << 32:
                bits = np.zeros((len(runs), len(self.langs)))
                inside = (runs >= self.low) & (runs < self.high)
                bits[inside] = self.cost(runs[inside])
            else:
                bits = self.cost(runs).astype(np.float64)
            np.add.at(out, owners, np.add.reduceat(bits, starts, axis=0))


class Parts:
    """Trees beyond the bytes held at a time: one language after the other, each in parts, all counts kept."""

    def __init__(self, langs: list[str]):
        self.langs = langs
        self.stored: list[tuple[int, Broadcast]] = []

    @property
    def keys(self) -> list[np.ndarray]:
        """Runs of the first part, by their order."""
        return self.stored[0][1].value.keys

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each whole text in each language; one part is in memory at a time."""
        out = np.zeros((len(texts), len(self.langs)))
        for lang, held in self.stored:
            out[:, lang] += held.value.lengths(texts)[:, 0]
            held.__dict__.pop("_value", None)  # it is read again from its local file
        return out


def learn(docs: DataFrame, lang: str = "lang", text: str = "text", model_bytes: int = MODEL_BYTES) -> Model | Parts:
    """The frozen trees of all languages of the table; no language, if no row has text and lang.

    The counts cover every text, and none is left out. Trees of more than `model_bytes` are built language by
    language and cut to parts with so many of the longest runs; the runs of up to ORDER bytes of a language
    (2^24 at most) are in each of its parts. The driver holds the tree of one language then.
    """
    counts = count_grams(docs, lang, text).persist()
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    room = max(1, model_bytes // (4 + 4 * max(len(langs), 1)))
    if counts.select("gram").distinct().count() > room:
        model = Parts(langs)
        for i, name in enumerate(langs):
            arrow = counts.where(F.col("lang") == name).select("gram", "n").toArrow()
            keys, n = arrow.column("gram").to_numpy(), arrow.column("n").to_numpy()
            order = np.argsort(keys)
            whole = Model([name], keys[order], n[order][:, None])
            model.stored += [(i, docs.sparkSession.sparkContext.broadcast(part)) for part in whole.parts(room)]
        counts.unpersist()
        return model
    found = counts.select("gram", F.array_position(F.lit(langs), F.col("lang")).alias("l"), "n") if langs else counts.select("gram", F.lit(1).alias("l"), "n")
    arrow = found.toArrow()
    counts.unpersist()
    keys, place = np.unique(arrow.column("gram").to_numpy(), return_inverse=True)
    n = np.zeros((len(keys), len(langs)), np.int64)
    if langs:
        n[place, arrow.column("l").to_numpy().astype(np.int64) - 1] = arrow.column("n").to_numpy()
    return Model(langs, keys, n)


def has_letter(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: Model | Parts, text: str = "text") -> DataFrame:
    """Every row and column of `docs` with lang_pred and score.

    score is the posterior of the language, all equally likely before. A text that is null or has no
    letter, and any text if the model has no language, gets `und` and 0. Ties go to the first
    language by name. Rows are judged one by one; columns of `docs` named as the results are replaced.
    """
    ship(docs.sparkSession)
    found = free_name(docs, "found")
    shared = model if isinstance(model, Parts) else docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang: string, score: double>")
    def judged(bodies: pd.Series) -> pd.DataFrame:
        trees = shared if isinstance(shared, Parts) else shared.value
        names, scores = [None] * len(bodies), [0.0] * len(bodies)
        rows = [i for i, b in enumerate(bodies) if b is not None] if trees.langs else []
        if rows:
            bits = trees.lengths([bodies.iloc[i] for i in rows])
            best = bits.argmin(axis=1)
            spare = np.exp2(np.clip(bits.min(axis=1, keepdims=True) - bits, -1000, 0)).sum(axis=1)
            for i, b, s in zip(rows, best, spare):
                names[i], scores[i] = trees.langs[b], float(1 / s)
        return pd.DataFrame({"lang": pd.Series(names, dtype=object), "score": scores})

    body = F.when(has_letter(text), F.lower(F.col(text)).cast("binary"))
    done = docs.withColumn(found, judged(body))
    lang = F.coalesce(F.col(f"{found}.lang"), F.lit(NO_LANGUAGE))
    return done.withColumns({"lang_pred": lang, "score": F.col(f"{found}.score")}).drop(found)


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold kept from learning; a null id counts as an empty one."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0
