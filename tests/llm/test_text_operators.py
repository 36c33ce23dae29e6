"""Decontamination, mixing and token files against plain versions."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docledger.llm import decontaminate, mixing, tokens
from docledger.llm.common import Scratch

DOCS = "doc_id long, text string, source string, n_words string, SIZE int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain_report(docs, items):
    out = []
    for doc_id, text in docs:
        words, hit, names = plain_words(text), set(), set()
        for name, body in items:
            own = plain_words(body)
            n = min(13, len(own))
            for i in range(len(own) - n + 1 if n else 0):
                for j in range(len(words) - n + 1):
                    if words[j : j + n] == own[i : i + n]:
                        hit.update(range(j, j + n))
                        names.add(str(name))
        bad = len(hit) > 0 and 20 * len(hit) >= len(words)
        out.append((doc_id, len(words), len(hit), len(names), decontaminate.sha256_of(names), bad))
    return Counter(out)


def corpus():
    rnd = random.Random(3)
    word = lambda: rnd.choice(["Ab", "ab", "c1", "é", "É", "dd", "x"])
    items = [(i, " ".join(word() for _ in range(rnd.choice([1, 2, 5, 13, 14, 20])))) for i in range(8)]
    items += [(90, None), (91, ""), (92, "--- !!"), (93, items[0][1])]
    docs = [(i, " ".join(word() for _ in range(rnd.randint(0, 60)))) for i in range(40)]
    docs += [(i + 100, f"q q {items[i % 8][1].upper()}-{items[(i + 1) % 8][1]}" + " zz" * rnd.randint(0, 400)) for i in range(16)]
    docs += [(200, None), (201, ""), (None, items[5][1]), (None, items[5][1]), (202, "zz " * 30_000 + items[7][1])]
    return docs, items


@pytest.mark.parametrize("pass_bytes", [1 << 20, 30])
def test_decontamination(spark, pass_bytes):
    docs, items = corpus()
    table = spark.createDataFrame([(*d, "s", "old", 1) for d in docs], DOCS)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_benchmark(table, benchmark, pass_bytes=pass_bytes)
    assert {"source", "SIZE", "hit_spans"} <= set(found.columns) and found.columns.count("n_words") == 1
    assert Counter(map(tuple, decontaminate.report(found).collect())) == plain_report(docs, items)


def test_decontamination_of_nothing(spark):
    table = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in decontaminate.find_benchmark(table, none).collect()] == [False]
    assert decontaminate.find_benchmark(table.limit(0), none).count() == 0


def test_shifts_skip_but_never_miss():
    rnd = random.Random(4)
    for _ in range(300):
        n = rnd.randint(1, 5)
        text = [rnd.choice([b"a", b"b"]) for _ in range(rnd.randint(0, 30))]
        windows = {tuple(rnd.choice([b"a", b"b"]) for _ in range(n)): ["w"] for _ in range(3)}
        found = {i for i, _ in decontaminate.Searcher(n, windows).find(text)}
        assert found == {i for i in range(len(text) - n + 1) if tuple(text[i : i + n]) in windows}


def plain_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = Fraction(3, 2) * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        room = total - sum(2 * sizes[s] for s in capped)
        target = {s: room * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if target[s] > 2 * sizes[s]}
        if not over:
            return target | {s: Fraction(2 * sizes[s]) for s in capped}
        capped |= over


def test_mixing(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(600):
        source = rnd.choice(["hot", "hot", "hot", "a", "ä", "B", None, "tiny" if i < 20 else "hot"])
        rows.append((i, rnd.choice([None, "", " w\tv x\n" * rnd.randint(0, 40)]), source, "x", 3))
    rows += [(7, "same row", "a", "x", 3)] * 5 + [(None, "no id", "B", "x", 3)] * 2
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, text, source, *_ in rows:
        sizes[source] += size(text)
    for r in got:
        assert r["size"] == size(r.text) and r.taken <= 2 * r["size"] and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
    for source, target in plain_targets(sizes).items():
        assert taken[source] == round(float(target))
        assert all(abs(r.target - float(target)) < 1e-6 for r in got if r.source == source)
    again = mixing.mix(docs.repartition(7)).collect()
    assert Counter(map(str, got)) == Counter(map(str, again))
    assert mixing.mix(docs.limit(0)).count() == 0
    wordless = mixing.mix(docs.where("text is null or text = ''"))
    assert {r.taken for r in wordless.collect()} == {0}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500), st.data())
def test_codes_give_any_token(ids, data):
    codes = tokens.Dac(*tokens.encode_dac(np.array(ids, np.uint32)))
    assert codes.range(0, len(ids)).tolist() == ids
    if ids:
        i = data.draw(st.integers(0, len(ids) - 1))
        j = data.draw(st.integers(i, len(ids)))
        assert codes[i] == ids[i] and codes.range(i, j).tolist() == ids[i:j]


def test_encoder_is_the_tokenizer():
    encoder = tokens.Encoder.of(tokens.default_tokenizer())
    rnd = random.Random(6)
    parts = [*"ab A'sré́İΣς.,!?*#$%&)(\n\t\r \x1c\x0b1²ⅣßﬁÅ", "<|endoftext|>", "it's", "'ll ", "ऩ", "\U0001f600"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 14))) for _ in range(4000)] + ["w" * 5000, " ".join("abc") * 3000]
    wanted = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder.encode(texts) == wanted


def test_words_of_letters_need_the_model_alone():
    encoder = tokens.Encoder(tokens.default_tokenizer())
    letters = [c for c in map(chr, range(0x530)) if re.match(tokens.LETTERS, c)]
    assert len(letters) > 700 and encoder.joins
    texts = [f"{a}{b} x{b}{a}. {a}\x0b{b}b!?\u00a0{a}" for a, b in zip(letters, letters[7:] + letters[:7])]
    wanted = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    seen, whole = [], encoder._whole
    encoder._whole = lambda words: seen.extend(words) or whole(words)
    assert encoder.encode(texts) == wanted
    seen.clear()
    ids, ends = encoder.ids(pa.array(["Plain words, plain \u0439 words.", None, "", "it's plain"]))
    assert sorted(filter(None, seen)) == [",", ".", "it's"]  # once each, whatever stands beside them
    assert ends[0] == ends[1] == ends[2] < ends[3] == len(ids)
    assert not tokens.joins_letters({"normalizer": None, "pre_tokenizer": None, "model": {"type": "BPE"}})


def test_token_files(spark):
    rows = [(i * 3 % 101, f"Some {i} words, é#{'x ' * (i % 50)}", "b") for i in range(101)]
    rows += [(500, None, "b"), (501, "", "b"), (502, "long " * 20_000, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)
    path = f"{Scratch(spark, 'test').root}/ids"
    tokens.write_tokens(docs, tokens.default_tokenizer(), path, segment_ids=300)
    segments = tokens.read_tokens(spark, path)
    encoder = tokens.Encoder.of(tokens.default_tokenizer()).tokenizer
    ids, wanted = [], []
    for doc_id, text, _ in sorted(rows):
        own = [*encoder.encode(text or "", add_special_tokens=False).ids, 1]
        import zlib

        wanted.append((doc_id, len(ids), len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        ids += own
    assert sorted(map(tuple, tokens.document_tokens(segments).collect())) == wanted
    places = [0, 5, len(ids) - 1, len(ids), -1, None, 5, len(ids) // 2]
    at = tokens.tokens_at(segments, spark.createDataFrame([(p,) for p in places], "position long"))
    assert {(r.position, r.token) for r in at.collect()} == {(p, ids[p]) for p in {0, 5, len(ids) - 1, len(ids) // 2}}
    assert tokens.tokenized(docs.limit(0), tokens.default_tokenizer()).count() == 0


def test_repeated_and_null_ids_are_written(spark):
    docs = spark.createDataFrame([(None, "a"), (4, "b"), (4, "b"), (4, None)], "doc_id long, text string")
    rows = tokens.tokenized(docs, tokens.default_tokenizer()).orderBy(F.col("start")).collect()
    assert [(r.doc_id, r.n_tokens) for r in rows] == [(None, 2), (4, 1), (4, 2), (4, 2)]


def test_items_without_an_id_mark_words_and_have_no_name(spark):
    docs = spark.createDataFrame([(1, "lone wolf pack"), (2, "some other words")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "Lone wolf"), (None, None), (4, "wolf pack")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.report(decontaminate.find_benchmark(docs, items)).collect()}
    assert (got[1]["n_hit"], got[1]["n_items"], got[1]["contaminated"]) == (3, 1, True)
    assert got[1]["items_sha256"] == decontaminate.sha256_of(["4"]) and got[2]["n_hit"] == 0


def test_ids_are_gathered_in_parts(monkeypatch):
    """The whole gather held places of eight bytes for all ids of a batch, several times over."""
    flat, sizes = np.arange(50, dtype=np.uint32), np.array([3, 0, 7, 40])
    which = np.random.default_rng(3).integers(0, 4, 1000)
    expected = np.concatenate([flat[a : a + n] for a, n in zip((np.cumsum(sizes) - sizes)[which], sizes[which])])
    most, ones = [], tokens.np.repeat
    monkeypatch.setattr(tokens, "GATHERED", 64)
    monkeypatch.setattr(tokens.np, "repeat", lambda *a: (most.append(len(a[0])), ones(*a))[1])
    found, lengths = tokens.gather(flat, sizes, which)
    assert found.tolist() == expected.tolist() and lengths.tolist() == sizes[which].tolist()
    assert max(most) == 64
    assert len(tokens.gather(flat, sizes, which[:0])[0]) == 0
