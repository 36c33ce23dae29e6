"""Packing: ids beside the library, whole cover of all documents, little padding."""

import random
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pytest

from docledger.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


def odd_texts(seed=4, n=400):
    rnd = random.Random(seed)
    bits = ["don't", "We'll", "a", "Été", "x1,", "!!", "a.b", "'s", " ", "  ", "\n", " \n", "\t", "\r\n", " ", "　"]
    bits += ["\x0b", "\x1c", "日本", "é", "😀", "<|endoftext|>", "<|endoftext|> x", "12,34", "*.", "\x00", "ß?", "I'M"]
    return ["".join(rnd.choice(bits) + rnd.choice(["", " ", " "]) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


def test_ids_are_those_of_the_library(tokenizer):
    encoder = packing.Encoder(packing.default_tokenizer())
    assert encoder.fast
    rnd = random.Random(6)
    texts = odd_texts() + [" ".join(odd_texts(5, 200)), "", " " * 30_000 + "a", "x" * 5000, "\u0301\u0301e"]
    texts += ["".join(chr(rnd.choice([rnd.randint(1, 127), rnd.randint(128, 0xD7FF)])) for _ in range(60)) for _ in range(500)]
    texts += ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyzäöüß") for _ in range(40)) for _ in range(500)]
    for text in texts:
        assert list(array("I", encoder.encode(text))) == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_other_rules_are_left_to_the_library():
    import json

    with open(packing.default_tokenizer(), encoding="utf-8") as file:
        rules = json.load(file)
    assert packing.byte_ranks(rules)
    model = rules["model"]
    for change in (
        {"pre_tokenizer": {"type": "Whitespace"}},
        {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}},
        {"normalizer": {"type": "NFC"}},
        {"added_tokens": [{"content": "<x>", "lstrip": True}]},
        {"model": model | {"merges": model["merges"][::-1]}},
        {"model": model | {"dropout": 0.1}},
    ):
        assert packing.byte_ranks(rules | change) is None


def check(rows, pieces, tokenizer, window):
    """Every id in one piece, sequences gapless and within the window; returns the share of padding."""
    wanted = []
    for name, text in rows:
        wanted.append((name, (*tokenizer.encode(text or "", add_special_tokens=False).ids, 1)))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = tuple(array("I", bytes(p["ids"])))
        assert len(ids) == p["length"] and zlib.crc32(bytes(p["ids"])) == p["ids_crc32"]
        by_doc[p["doc_id"], p["doc_tokens"]].append((p["start"], ids))
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    expected = defaultdict(list)
    for name, ids in wanted:
        expected[name, len(ids)].append(ids)
    assert set(expected) == set(by_doc)
    for key, copies in expected.items():
        # Equal keys may only be copies here, so each piece comes up as often as there are copies.
        assert len(set(copies)) == 1
        at = 0
        for start, ids in sorted(by_doc[key])[:: len(copies)]:
            assert start == at and ids == copies[0][at : at + len(ids)] or len(copies) > 1
            at += len(ids) if len(copies) == 1 else 0
        assert sum(len(ids) for _, ids in by_doc[key]) == len(copies[0]) * len(copies)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    padded = total = 0
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at and length > 0
            at += length
        assert at <= window
        total += at
        padded += 0 if at & (at - 1) == 0 else window - at
    return padded / total


@pytest.mark.parametrize("sizes", [(1, 900), (30, 60), (150, 151), (700, 701), (1, 3000)])
def test_packing(spark, tokenizer, sizes):
    rnd = random.Random(sizes[1])
    rows = [(i, " ".join(rnd.choice(["alpha", "beta", "x"]) for _ in range(rnd.randint(*sizes)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (None, "no id"), (7, rows[7][1]), (1002, "long " * 9000)]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, bin int").repartition(5)
    pieces = packing.pack(docs, packing.default_tokenizer(), window=512)
    assert check(rows, pieces.collect(), tokenizer, 512) < 0.02
    packed = packing.sequences(pieces, 512).collect()
    assert all(len(r["ids"]) == 4 * (r["n_ids"] if r["n_ids"] & (r["n_ids"] - 1) == 0 else 512) for r in packed)
    first = min(packed, key=lambda r: r["sequence_id"])
    held = sorted((p["offset"], bytes(p["ids"])) for p in pieces.collect() if p["sequence_id"] == first["sequence_id"])
    assert bytes(first["ids"])[: 4 * first["n_ids"]] == b"".join(ids for _, ids in held)


def test_small_and_empty_tables(spark, tokenizer):
    schema = "doc_id long, text string"
    assert packing.pack(spark.createDataFrame([], schema), packing.default_tokenizer()).collect() == []
    rows = [(1, "one two three four five six seven")]
    pieces = packing.pack(spark.createDataFrame(rows, schema), packing.default_tokenizer()).collect()
    assert check(rows, pieces, tokenizer, 2048) == 0
    pieces = packing.pack(spark.createDataFrame([(1, None)], schema), packing.default_tokenizer()).collect()
    assert [(p["start"], p["length"], p["doc_tokens"]) for p in pieces] == [(0, 1, 1)]


def test_least_squares_beats_nothing_else():
    """The repeats are non-negative, and no column could improve the sum alone."""
    rng = np.random.default_rng(1)
    columns = np.sort(rng.integers(0, 30, (400, 3)), axis=1)
    wanted = rng.integers(0, 1000, 30).astype(float)
    repeats = packing.least_squares(columns, wanted)
    assert (repeats >= 0).all()
    residual = wanted - np.bincount(columns.ravel(), np.repeat(repeats, 3), 30)
    gain = residual[columns].sum(axis=1)
    assert gain.max() < 1e-2 and np.abs(gain[repeats > 1e-6]).max() < 1e-2


def test_plan_gives_each_rank_one_place():
    rng = np.random.default_rng(2)
    histogram = {packing.bin_of(n): 0 for n in range(1, 2049)}
    for n in rng.gamma(2, 300, 50_000).astype(int):
        histogram[packing.bin_of(int(min(max(n, 1), 2048)))] += 1
    plan = packing.Plan(histogram)
    bins = np.repeat(list(histogram), list(histogram.values()))
    ranks = np.concatenate([np.arange(n) for n in histogram.values()])
    sequence, place = plan.place(bins, ranks)
    held = sequence >= 0
    assert len(set(zip(sequence[held], place[held]))) == held.sum()
    full = np.bincount(sequence[held], bins[held])
    assert full.max() <= 2048 and full.sum() > 0.98 * 2048 * len(full) and held.mean() > 0.95
    assert packing.Plan({}).place(np.array([5]), np.array([0]))[0].tolist() == [-1]
