"""Collocations beside a plain count of all phrases."""

import random
import re
from collections import Counter, defaultdict

import pytest

from docledger.llm import collocations


def plain_counts(rows):
    counts = defaultdict(Counter)
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts[lang or "und"][tuple(words[i : i + k])] += 1
    return counts


def plain_collocations(rows, least, top=2000):
    out = set()
    for lang, f in plain_counts(rows).items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in candidates.items():
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            inside = any(
                100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                for q, b in candidates.items()
                if len(q) > len(p)
            )
            if not inside:
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return out


def corpus(seed=3, n=300):
    rnd = random.Random(seed)
    words = ["a", "B", "é", "über", "x-1", "<b>", "ÀB", "c\x00d"]
    rows = []
    for _ in range(n):
        text = ""
        for _ in range(rnd.randint(0, 60)):
            text += rnd.choice(words) + rnd.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "\r\n", ";", "\x0b"])
        rows.append((rnd.choice(["en", "en", "de", None, "und"]), text))
    rows += [("en", None), ("en", ""), ("fr", " .;\n"), (None, "once only"), ("en", "a B é " * 30_000)]
    return rows + rows[:20]


def test_collocations(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, text string, n int, Phrase int").repartition(5)
    got = collocations.collocations(docs, least=30)
    assert set(map(tuple, got.collect())) == plain_collocations(rows, 30)
    assert got.dtypes == [
        ("lang", "string"), ("rank", "bigint"), ("phrase", "string"), ("a", "bigint"), ("l", "bigint"),
        ("r", "bigint"), ("n", "bigint"), ("score", "bigint"),
    ]


def test_ties_and_the_longest_list(spark):
    rows = [("en", " ".join([f"w{i}", f"v{i}"])) for i in range(40)] * 2
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = collocations.collocations(docs, least=2, per_lang=7).orderBy("rank").collect()
    assert set(map(tuple, got)) == plain_collocations(rows, 2, 7) and len(got) == 7


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(empty).collect() == []
    assert collocations.collocations(spark.createDataFrame([("en", None)], "lang string, text string")).collect() == []


@pytest.mark.parametrize("burst, held, size, word_bytes", [(4, 10_000, 1 << 20, 1 << 20), (2, 50, 64, 1 << 20), (8, 500, 300, 40)])
def test_bursts_and_spills_keep_all_counts(monkeypatch, burst, held, size, word_bytes):
    """Runs of several tasks, merged per partition, hold what a plain count holds, however often subtrees leave."""
    monkeypatch.setattr(collocations, "BURST", burst)
    monkeypatch.setattr(collocations, "HELD_WINDOWS", held)
    monkeypatch.setattr(collocations, "TEXT_BYTES", size)
    monkeypatch.setattr(collocations, "HELD_WORD_BYTES", word_bytes)
    rows = [(lang, (text or "")[:3000]) for lang, text in corpus(8, 120)]
    runs = defaultdict(list)
    for task in (rows[:50], rows[50:]):
        counting = collocations.Counting(7)
        for lang, text in task:
            for part, run in counting.add(lang or "und", [text.encode()]):
                runs[part].append(run)
        for part, run in counting.spill(0):
            runs[part].append(run)
    got, totals = Counter(), Counter()
    for held_runs in runs.values():
        for lang, words, f in collocations.merged(held_runs, 2):
            if words:
                assert (lang, *words) not in got
                got[(lang, *words)] = f
            else:
                totals[lang] += f
    counts = plain_counts(rows)
    assert got == Counter({(lang, *p): c for lang, f in counts.items() for p, c in f.items() if c >= 2})
    assert totals == Counter({lang: sum(c for p, c in f.items() if len(p) == 1) for lang, f in counts.items() if f})
