"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on each document. Expectation-maximisation over the
counts of vote patterns estimates how often each labeller votes how on good and on bad documents, with no
true label. The posterior of a document's votes is its label for a linear scorer over hashed features of
words. Two facets are judged apart: form (is it running text?) and tone (does it insult?).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from operator import eq
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.llm.common import bytes_of, free_name, ship

GOOD, BAD, NONE = "g", "b", "-"
#: Hashed features, and documents that the scorers are fitted on (about so many, chosen by hash, and never
#: more than twice as many), each with its whole text.
FEATURES = 1 << 16
FIT_ROWS = 12_000
#: The feature that counts words equal to the word before.
REPEATED = 0
ROUNDS = 60

# Very common words of English, German, French and Spanish.
COMMON = frozenset(
    w.encode()
    for w in (
        "the of and to in is that it for was with as on be at by this had are but from or which not "
        "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an "
        "le la les de des et un une du en que qui dans pour pas est sur au avec ce il elle "
        "el los las y que en se del por con para una no su lo como más"
    ).split()
)
# English insults.
INSULTS_PERSON = frozenset(
    b"idiot idiots moron morons clown clowns loser losers imbecile fool fools dumbass jerk jerks retard scumbag bastard".split()
)
INSULTS_OTHER = frozenset(
    b"stupid pathetic worthless disgusting trash scum garbage filth filthy vermin dumb crap shit fuck fucking asshole bitch".split()
)

MARKS = re.compile(rb"[#$%&*!?~^|<>=+_@]{2,}")
AROUND = b".,;:!?#$%&*()\"'|"
FORM = (
    "symbols", "marked_words", "capitals", "line_words", "common_words", "sentences", "word_length", "variety",
    "repeated_words", "growth_of_words",
)
TONE = ("insulted_person", "insult", "insult_density")


def _by(value: float, good: float, bad: float) -> str:
    """good and bad are bounds; the value votes beyond either, and says nothing between."""
    if good < bad:
        return GOOD if value <= good else BAD if value >= bad else NONE
    return GOOD if value >= good else BAD if value <= bad else NONE


class Words:
    """What is known of words, remembered for words used lately."""

    def __init__(self, most: int = 100_000):
        self.most, self.held = most, {}

    def new(self, word: bytes) -> tuple[bytes, int, int, int, int]:
        """The bare word, its flags and length, and the hashed features of the word and its shape."""
        other = word.translate(None, LETTERS)
        if not other:
            bare = word.lower()
            flags = KNOWN.get(bare, 0)
        else:
            bare = word.strip(AROUND).lower()
            if not bare or len(other) > 1 and MARKS.search(word):
                flags = KNOWN.get(bare, 0) & ~COMMON_WORD | MARKED
            else:
                flags = KNOWN.get(bare, 0) | (ENDS if word[-1:] in b".!?" else 0)
        found = (bare, flags, len(bare), crc32(bare) % FEATURES, crc32(word[-6:].translate(SHAPE), 1) % FEATURES)
        if len(word) < 48:
            if len(self.held) >= self.most:
                self.held.clear()
            self.held[word] = found
        return found


_WORDS = Words()


def described(body: bytes, hashed: bool = True) -> tuple[str, str, np.ndarray, np.ndarray]:
    """Votes on form and tone, a letter for each labeller, and hashed features of unit length together."""
    words = body.split()
    n = len(words)
    if not n:
        return NONE * len(FORM), NONE * len(TONE), np.zeros(0, np.int64), np.zeros(0)
    counts, new = Counter(words), _WORDS.new
    known = [found or new(word) for word, found in zip(counts, map(_WORDS.held.get, counts))]
    k = np.fromiter(counts.values(), np.int64, len(counts))
    flags = np.bincount([x[1] for x in known], weights=k, minlength=32)
    common, marked, ends, person, other = (float(flags[BITS[i]].sum()) for i in range(5))
    length = float(np.dot([x[2] for x in known], k))
    kinds = len({x[0] for x in known})
    equal = sum(map(eq, words, words[1:]))
    upper, lower = len(body.translate(None, NOT_UPPER)), len(body.translate(None, NOT_LOWER))
    lines = [x for x in body.split(b"\n") if x.strip()]
    short = sum(1 for x in lines if len(x) < 200 and len(x.split()) <= 2)
    form = (
        _by(len(body.translate(None, NOT_SYMBOL)) / len(body), 0.01, 0.05),
        _by(marked / n, 0.02, 0.2),
        _by(upper / (upper + lower), 0.15, 0.5) if upper + lower >= 10 else NONE,
        _by(short / len(lines), 0.5, 0.75) if len(lines) >= 6 else NONE,
        _by(common / n, 0.06, 0.01) if n >= 30 else NONE,
        _by(ends / n, 0.02, 0.002) if n >= 30 else NONE,
        _by(length / n, 12, 20) if n >= 10 else NONE,
        (_by(kinds / n, 0.2, 0.08) if n >= 50 else _by(kinds / n, 0.65, 0.45) if n >= 12 else NONE) if n < 3000 else NONE,
        _by(equal / n, 0.05, 0.3) if n >= 8 else NONE,
        _by(math.log(kinds) / math.log(n), 0.78, 0.65) if n >= 12 else NONE,
    )
    tone = (
        BAD if person else GOOD,
        BAD if other else GOOD,
        GOOD if not person + other else BAD if (person + other) * 200 >= n or person + other >= 2 else NONE,
    )
    if not hashed:
        return "".join(form), "".join(tone), np.zeros(0, np.int64), np.zeros(0)
    shapes: dict[int, int] = {}
    for x, times in zip(known, counts.values()):
        shapes[x[4]] = shapes.get(x[4], 0) + times
    at = np.array([REPEATED, *(x[3] for x in known), *shapes], np.int64)
    x = np.sqrt(np.array([equal, *counts.values(), *shapes.values()], float))
    return "".join(form), "".join(tone), at, x / max(np.sqrt((x * x).sum()), 1e-9)


def votes(body: bytes) -> tuple[str, str]:
    return described(body, hashed=False)[:2]


def features(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    return described(body)[2:]


_ALL = bytes(range(256))
#: Flags, by the bits that they set.
BITS = [np.array([f for f in range(32) if f >> bit & 1]) for bit in range(5)]
COMMON_WORD, MARKED, ENDS, INSULTS_A, INSULTS_B = 1, 2, 4, 8, 16
KNOWN = {w: COMMON_WORD for w in COMMON} | {w: INSULTS_A for w in INSULTS_PERSON} | {w: INSULTS_B for w in INSULTS_OTHER}
LETTERS = bytes(b for b in _ALL if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
#: Letters by case, digits as one; everything else stays.
SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in _ALL)
NOT_UPPER = bytes(b for b in _ALL if not 65 <= b <= 90)
NOT_LOWER = bytes(b for b in _ALL if not 97 <= b <= 122)
NOT_SYMBOL = bytes(b for b in _ALL if b not in b"#$%&*~^|<>=+_@{}[]\\")


class LabelModel:
    """Two classes with independent labellers, each voting good, bad or nothing."""

    def __init__(self, names: tuple[str, ...], patterns: dict[str, int], rounds: int = ROUNDS):
        self.names = names
        keys = sorted(patterns)
        cast = np.zeros((len(keys), len(names), 2))  # no vote is no evidence
        for i, key in enumerate(keys):
            for j, vote in enumerate(key):
                if vote != NONE:
                    cast[i, j, "gb".index(vote)] = 1
        n = np.array([patterns[k] for k in keys], float)
        # At the start a labeller seldom finds fault with good text and finds two faults in five of bad text, as
        # each knows one kind of fault. This also names the classes.
        self.rates = np.empty((2, len(names), 2))
        self.rates[0], self.rates[1] = [0.95, 0.05], [0.6, 0.4]
        self.prior = np.array([0.85, 0.15])
        for _ in range(rounds if len(keys) else 0):
            bad = self._bad(cast)
            for c, weight in ((0, n * (1 - bad)), (1, n * bad)):
                counts = np.einsum("i,ijk->jk", weight, cast) + [[0.5, 0.5]]
                self.rates[c] = counts / counts.sum(axis=1, keepdims=True)
                self.prior[c] = weight.sum() + 1
            self.prior /= self.prior.sum()
        self.bad_of = dict(zip(keys, self._bad(cast).tolist())) if keys else {}

    def _bad(self, cast: np.ndarray) -> np.ndarray:
        log = np.einsum("ijk,cjk->ic", cast, np.log(self.rates)) + np.log(self.prior)
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))

    def accuracies(self) -> dict[str, float]:
        """How often a labeller that votes is right, by the model."""
        right = self.prior @ np.stack([self.rates[0, :, 0], self.rates[1, :, 1]])
        return {n: float(r) for n, r in zip(self.names, right)}


class Scorer:
    """A logistic model over hashed features, fitted to soft labels."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    @staticmethod
    def fit(rows: list[tuple[np.ndarray, np.ndarray]], bad: np.ndarray, epochs: int = 12, seed: int = 5) -> Scorer:
        weights, bias, squares = np.zeros(FEATURES), 0.0, np.full(FEATURES, 1e-6)
        if not rows:
            return Scorer(weights, bias)
        balance = np.where(bad > 0.5, 0.5 / max(np.mean(bad > 0.5), 1e-3), 0.5 / max(np.mean(bad <= 0.5), 1e-3))
        chance = np.random.default_rng(seed)
        for epoch in range(epochs):
            for i in chance.permutation(len(rows)):
                at, x = rows[i]
                p = 1 / (1 + np.exp(-np.clip(weights[at] @ x + bias, -30, 30)))
                step = (p - bad[i]) * min(balance[i], 10.0)
                gradient = step * x
                squares[at] += gradient * gradient
                weights[at] -= 0.3 * gradient / np.sqrt(squares[at])
                bias -= 0.02 * step
        return Scorer(weights, bias)

    def bad(self, at: np.ndarray, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[at] @ x + self.bias, -30, 30))))


class QualityModel:
    """Label models and scorers of both facets."""

    def __init__(self, labels: dict[str, LabelModel], scorers: dict[str, Scorer]):
        self.labels, self.scorers = labels, scorers


def _voted(docs: DataFrame, text: str, name: str) -> DataFrame:
    @F.pandas_udf("struct<form: string, tone: string>")
    def run(bodies: pd.Series) -> pd.DataFrame:
        found = [votes(b) for b in bodies]
        return pd.DataFrame({"form": [v[0] for v in found], "tone": [v[1] for v in found]})

    return docs.withColumn(name, run(bytes_of(text)))


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS) -> QualityModel:
    """Label models from the votes on all documents; scorers from about `fit_rows` documents chosen by hash.

    There are at most 3 ** labellers patterns of votes, so their counts have a fixed bound. Empty
    tables give models that find nothing bad.
    """
    ship(docs.sparkSession)
    body = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"))
    voted = _voted(body, "text", "v").groupBy("v.form", "v.tone").agg(F.count("*").alias("n")).collect()
    patterns = {"form": Counter(), "tone": Counter()}
    for row in voted:
        patterns["form"][row.form] += row.n
        patterns["tone"][row.tone] += row.n
    labels = {"form": LabelModel(FORM, patterns["form"]), "tone": LabelModel(TONE, patterns["tone"])}

    @F.pandas_udf("struct<at: array<int>, x: array<float>>")
    def hashed(bodies: pd.Series) -> pd.DataFrame:
        found = [features(b) for b in bodies]
        return pd.DataFrame({"at": [a.astype(np.int32) for a, _ in found], "x": [x.astype(np.float32) for _, x in found]})

    # The hash is spread evenly, so this share of its range holds about `fit_rows` rows; the limit holds
    # where rows repeat. It counts feature rows, not texts.
    share = min(1.0, fit_rows / max(sum(patterns["form"].values()), 1))
    chosen = F.pmod(F.xxhash64("id", F.length("text")), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    sample = _voted(body.where(chosen), "text", "v").select("v", hashed(bytes_of("text")).alias("f")).limit(2 * fit_rows)
    # Arrow keeps the rows as flat arrays; each row is a view of them, without a copy.
    held = sample.select("v.form", "v.tone", "f.at", "f.x").toArrow()
    rows = []
    for both in zip(held.column("at").chunks, held.column("x").chunks):
        flat = [c.values.to_numpy(zero_copy_only=False) for c in both]
        ends = [c.offsets.to_numpy().tolist() for c in both]
        rows += [(flat[0][a:b], flat[1][c:d]) for a, b, c, d in zip(ends[0], ends[0][1:], ends[1], ends[1][1:])]
    marks = {facet: [labels[facet].bad_of[v] for v in held.column(facet).to_pylist()] for facet in ("form", "tone")}
    return QualityModel(labels, {k: Scorer.fit(rows, np.array(v)) for k, v in marks.items()})


def judge(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """Every row and column of `docs` with votes, posteriors, scores and `keep`.

    form_bad and tone_bad are posteriors of the votes, form_score and tone_score the linear scorers' chance of
    bad. A document is rejected when the mean of a facet's posterior and score is above one half, so that
    the scorer decides where the votes leave doubt, or when it has no word at all (null, empty or
    white space). Rows are judged one by one; result columns replace those
    of the same name.
    """
    spark = docs.sparkSession
    ship(spark)
    found = free_name(docs, "judged")
    shared = spark.sparkContext.broadcast(model)
    fields = "form: string, tone: string, form_bad: double, tone_bad: double, form_score: double, tone_score: double, words: boolean"

    @F.pandas_udf(f"struct<{fields}>")
    def run(bodies: pd.Series) -> pd.DataFrame:
        known, rows = shared.value, []
        for body in bodies:
            form, tone, at, x = described(body)
            bad = [known.labels[k].bad_of.get(v, known.labels[k].prior[1]) for k, v in (("form", form), ("tone", tone))]
            rows.append((form, tone, *bad, known.scorers["form"].bad(at, x), known.scorers["tone"].bad(at, x), bool(body.strip())))
        return pd.DataFrame(rows, columns=["form", "tone", "form_bad", "tone_bad", "form_score", "tone_score", "words"])

    done = docs.withColumn(found, run(bytes_of(text)))
    value = lambda n: F.col(f"{found}.{n}")
    rejected = F.lit(False)
    for facet in ("form", "tone"):
        rejected = rejected | (value(f"{facet}_bad") + value(f"{facet}_score") > 1)
    names = ("form_bad", "tone_bad", "form_score", "tone_score")
    return done.withColumns(
        {
            "votes": F.concat(value("form"), value("tone")),
            **{n: F.round(value(n), 6) for n in names},
            "keep": value("words") & ~rejected,
        }
    ).drop(found)
