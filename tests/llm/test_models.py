"""Language identification, neighbours and the quality model."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
from conftest import SF_DIR
from pyspark.sql import functions as F

from docledger.llm import language, neighbours, quality
from docledger.llm.queries import QUERIES


def plain_lengths(training, text):
    """Prediction by partial matching, one byte and one context at a time."""
    out = {}
    for lang, bodies in training.items():
        counts = defaultdict(Counter)
        for body in bodies:
            padded = b"\0\0\0" + body
            for i in range(3, len(padded)):
                for order in range(4):
                    counts[padded[i - order : i]][padded[i]] += 1
        padded, bits = b"\0\0\0" + text, 0.0
        for i in range(3, len(padded)):
            for order in range(3, -2, -1):
                if order < 0:
                    bits += 8
                    break
                seen = counts.get(padded[i - order : i])
                if not seen:
                    continue
                whole = sum(seen.values()) + len(seen)
                if padded[i] in seen:
                    bits -= math.log2(seen[padded[i]] / whole)
                    break
                bits -= math.log2(len(seen) / whole)
        out[lang] = bits
    return out


TRAINING = {"aa": ["abra cadabra abra", "bar abra"], "zz": ["zyx xyzzy zzz", "xyz"], "éé": ["été déjà vu"]}


def learned(spark):
    rows = [(lang, text, 1) for lang, texts in TRAINING.items() for text in texts]
    rows += [(None, "nothing", 1), ("aa", None, 1)]
    return language.learn(spark.createDataFrame(rows, "lang string, text string, score int").repartition(3))


def test_code_lengths_are_exact(spark):
    model = learned(spark)
    assert model.langs == ["aa", "zz", "éé"]
    texts = [b"", b"abra", b"zzz abra", "déjà q".encode(), bytes(range(256)), b"xyzzy " * 500, b"abc" * (language.PIECE // 2)]
    training = {k: [t.encode() for t in v] for k, v in TRAINING.items()}
    for text, got in zip(texts, model.lengths(texts)):
        short = text if len(text) < 5000 else None
        if short is not None:
            assert np.allclose(got, [plain_lengths(training, short)[x] for x in model.langs], rtol=1e-4, atol=1e-3)
    half = model.lengths([texts[-1], texts[-1][: len(texts[-1]) // 2]])
    assert np.allclose(half[0], 2 * half[1], rtol=1e-3)


def test_identify(spark):
    rows = [(1, "abra bar", "q"), (2, "XYZZY", "q"), (3, None, "q"), (4, "123 --", "q"), (5, "", "q"), (1, "abra bar", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    got = sorted((r.doc_id, r.lang_pred) for r in language.identify(docs, learned(spark)).collect())
    assert got == [(1, "aa"), (1, "aa"), (2, "zz"), (3, "und"), (4, "und"), (5, "und")]
    nothing = language.learn(spark.createDataFrame([], "lang string, text string"))
    assert {(r.lang_pred, r.score) for r in language.identify(docs, nothing).collect()} == {("und", 0.0)}
    assert language.identify(docs.limit(0), nothing).count() == 0


def test_a_small_model_still_codes(spark):
    rows = [(lang, text) for lang, texts in TRAINING.items() for text in texts]
    model = language.learn(spark.createDataFrame(rows, "lang string, text string"), model_bytes=16 * 10)
    assert len(model.keys[-1]) == 10 and np.isfinite(model.lengths([b"abra xyz"])).all()


def test_parts_code_as_the_whole(spark):
    rows = [(lang, text) for lang, texts in TRAINING.items() for text in texts] + [("aa", "abra cadabra abra bar ")] * 50
    docs = spark.createDataFrame(rows, "lang string, text string")
    whole = language.learn(docs)
    texts = [b"abra xyz", "été déjà vu".encode(), b"xyzzy q", b"", bytes(range(256))]
    asked = spark.createDataFrame([(t,) for t in ("abra xyz", "été déjà vu", "zyx", "?", None)], "text string")
    for size in (16, 160, 16 * 30):
        model = language.learn(docs, model_bytes=size)
        assert np.allclose(model.lengths(texts), whole.lengths(texts), rtol=1e-4, atol=1e-3)
        got, wanted = ([tuple(r) for r in language.identify(asked, m).select("lang_pred", "score").collect()] for m in (model, whole))
        assert [g[0] for g in got] == [w[0] for w in wanted] and np.allclose([g[1] for g in got], [w[1] for w in wanted], atol=1e-4)


def test_language_of_held_out_documents(spark):
    found = QUERIES["op10_language"](spark, SF_DIR).where("held_out")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang")
    rows = found.join(docs, "doc_id").collect()
    assert len(rows) > 20 and sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)


def plain_neighbours(rows, k=10):
    fine = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in fine:
        if q % 100 == 0:
            near = sorted((math.dist(v, w), i) for i, w in fine if i != q and len(w) == len(v))
            out[q] = near[:k]
    return out


def test_neighbours(spark):
    rnd = np.random.default_rng(7)
    rows = [(i, rnd.standard_normal(12).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[100][1]) for i in range(40)]  # equal vectors: the smallest ids win
    rows += [(2000, None), (2100, []), (2200, [0.0] * 12), (2300, [math.nan] * 12), (2400, [math.inf] + [1.0] * 11)]
    rows += [(2500, [None] + [1.0] * 11), (None, [1.0] * 12), (2600, [1.0, 2.0]), (2700, [1.0, 3.0]), (5, rows[5][1])]
    table = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got = defaultdict(list)
    found = neighbours.nearest(table, table.where("vec_id % 100 = 0"), block_rows=300, block_queries=5)
    for r in found.orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    wanted = plain_neighbours(rows)
    assert set(got) == set(wanted)
    total = sum(map(len, wanted.values()))
    same = sum(len({i for _, i in got[q]} & {i for _, i in wanted[q]}) for q in wanted)
    assert all(len(got[q]) == len(wanted[q]) for q in wanted) and same >= 0.95 * total
    assert [i for _, i in got[100]] == list(range(1000, 1010)) and got[2600][0][1] == 2700
    assert all(a <= b for q in got for a, b in zip(got[q], got[q][1:]))
    assert neighbours.nearest(table.limit(0), table.limit(0)).count() == 0


def test_recall_on_the_embeddings(spark):
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").select("vec_id", "embedding").collect()
    wanted = plain_neighbours([tuple(r) for r in rows])
    got = defaultdict(set)
    for r in QUERIES["op8_neighbours"](spark, SF_DIR).collect():
        got[r.query_id].add(r.vec_id)
    hits = sum(len(got[q] & {i for _, i in near}) for q, near in wanted.items())
    assert hits >= 0.9 * sum(map(len, wanted.values()))


def test_chi_square():
    assert abs(neighbours.chi_square(7.344, 8) - 0.5) < 1e-3 and abs(neighbours.chi_square(20.09, 8) - 0.99) < 1e-3


def test_label_model_finds_accuracies():
    rnd = random.Random(8)
    right = (0.95, 0.9, 0.85, 0.8)
    patterns, truth = Counter(), []
    for _ in range(20_000):
        bad = rnd.random() < 0.2
        cast = ""
        for r in right:
            if rnd.random() < 0.2:
                cast += quality.NONE
            else:
                cast += quality.BAD if bad == (rnd.random() < r) else quality.GOOD
        patterns[cast] += 1
        truth.append((cast, bad))
    model = quality.LabelModel(tuple("abcd"), patterns)
    assert all(abs(a - r) < 0.03 for a, r in zip(model.accuracies().values(), right))
    assert abs(model.prior[1] - 0.2) < 0.03
    assert sum((model.bad_of[c] > 0.5) == b for c, b in truth) > 0.93 * len(truth)


def test_quality_of_labelled_documents(spark):
    rows = QUERIES["op5_quality"](spark, SF_DIR.replace("sf0.001", "sf0.01")).select("doc_id", "keep", "form_bad", "tone_bad")
    labels = spark.read.parquet(f"{SF_DIR.replace('sf0.001', 'sf0.01')}/labels.parquet")
    found = rows.join(labels, "doc_id").collect()
    bad = [r for r in found if r.quality == 0]
    clean = [r for r in found if r.quality == 1 and r.toxic == 0]
    assert sum(not r.keep for r in bad) >= 0.9 * len(bad)
    assert sum(r.keep for r in clean) >= 0.98 * len(clean)


def test_scorers_are_fitted_on_whole_texts(spark, monkeypatch):
    fitted = []
    fit = quality.Scorer.fit
    monkeypatch.setattr(quality.Scorer, "fit", staticmethod(lambda rows, bad: fitted.append(rows) or fit(rows, bad)))
    text = "the cat is on the mat " * 500 + "you idiot, you pathetic moron " * 50
    quality.learn(spark.createDataFrame([("1", text)], "doc_id string, text string"))
    at, x = quality.features(text.encode())
    (got_at, got_x), = fitted[0]
    assert len(fitted) == 2 and got_at.tolist() == at.tolist() and np.allclose(got_x, x, atol=1e-6)


def test_quality_of_odd_rows(spark):
    prose = "This is the text of a page, and it has been written for a reader. It is not long. "
    rows = [(1, prose * 3, 1.0), (2, None, 1.0), (3, "", 1.0), (4, " \n\t", 1.0), (5, prose * 3000, 1.0), (None, prose, 1.0), (1, prose * 3, 1.0)]
    rows += [(6, "buy### now%%% &&& *** $$$ ### " * 30, 1.0), (7, "word " * 400, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form_bad double")
    got = quality.judge(docs, quality.learn(docs)).collect()
    assert len(got) == len(rows)
    kept = {r.doc_id for r in got if r.keep}
    assert {1, None} <= kept and not kept & {2, 3, 4}
    none = docs.limit(0)
    assert quality.judge(none, quality.learn(none)).count() == 0
    assert all(r.keep for r in quality.judge(docs.where(F.col("doc_id") == 1), quality.learn(none)).collect())
