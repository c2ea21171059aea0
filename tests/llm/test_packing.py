"""Packing: exact ids, gapless places, and as few sequences as can be."""

import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ingestctl.llm import packing as P
from ingestctl.llm.common import Recent
from tests.conftest import rows

TEXTS = [
    (1, None),
    (1, None),
    (2, ""),
    (3, "Hello, World! it's 2024's text\nand  more\t<|endoftext|> of_it"),
    (4, "word " * 12_000),
    (5, "Ünïcode naïve ΣΑΣ İstanbul é 日本語   end \U0001f600"),
    (None, "no id"),
    (6, "x" * 30_000),
]


def documents(spark, pairs):
    return spark.createDataFrame([(i, t, "a", 1) for i, t in pairs], "doc_id long, text string, piece string, length int")


def check_places(packed):
    places = defaultdict(list)
    for row in packed:
        places[row["sequence_id"]].append((row["offset"], row["length"]))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= P.CAPACITY
    return len(places)


def test_ids_and_places(spark):
    packed = P.pack(documents(spark, TEXTS), P.public_tokenizer()).collect()
    tokenizer = Tokenizer.from_file(P.public_tokenizer())
    expected = []
    for doc, text in TEXTS:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), P.CAPACITY)):
            part = np.array(ids[at : at + P.CAPACITY], dtype="<u4")
            expected.append((doc, piece, at, len(part), zlib.crc32(part.tobytes())))
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert check_places(packed) == -(-sum(r["length"] for r in packed) // P.CAPACITY)


def test_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(P, "PIECES_PER_TASK", 10)
    packed = P.pack(documents(spark, [(i, f"text {i} " * (i % 40)) for i in range(95)]), P.public_tokenizer()).collect()
    assert len(packed) == 95
    assert check_places(packed) <= 10 + sum(r["length"] for r in packed) // P.CAPACITY


def test_empty_table(spark):
    assert rows(P.pack(documents(spark, []), P.public_tokenizer())) == []


def test_words_in_all_encodings():
    tokens, tokenizer = P.WordTokens(P.public_tokenizer()), Tokenizer.from_file(P.public_tokenizer())
    for _, text in TEXTS:
        text = text or ""
        assert np.frombuffer(tokens.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_any_text(text):
    assert np.frombuffer(TOKENS.encode(text), "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_every_character():
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(every), 40_000):
        texts = [f":{c}a{c}1" for c in every[at : at + 40_000]]
        ids = [e.ids for e in TOKENIZER.encode_batch_fast(texts, add_special_tokens=False)]
        wrong = [t for t, i in zip(texts, ids) if np.frombuffer(TOKENS.encode(t), "<u4").tolist() != i]
        assert not wrong, (len(wrong), wrong[:5])


def test_every_pair_of_latin_characters():
    latin = [chr(c) for c in range(256)]
    texts = [a + b for a in latin for b in latin]
    ids = [e.ids for e in TOKENIZER.encode_batch_fast(texts, add_special_tokens=False)]
    wrong = [t for t, i in zip(texts, ids) if np.frombuffer(TOKENS.encode(t), "<u4").tolist() != i]
    assert not wrong, (len(wrong), wrong[:5])


TOKENS, TOKENIZER = P.WordTokens(P.public_tokenizer()), Tokenizer.from_file(P.public_tokenizer())


def test_a_full_cache_forgets_without_harm():
    made = []
    cache = Recent(lambda k: made.append(k) or k * 2, 3)
    for key in [1, 2, 3, 4, 1, 2, 5, 6, 7, 1]:
        assert cache[key] == key * 2
    assert len(cache) <= 3 and len(made) < 10


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_bins(lengths):
    bins, offsets = P.pack_lengths(lengths, 30)
    held = defaultdict(list)
    for length, b, at in zip(lengths, bins, offsets):
        held[b].append((at, length))
    for items in held.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 30
        assert sum(3 * length > 30 for _, length in items) <= 2
    least = max(-(-sum(lengths) // 30), sum(2 * n > 30 for n in lengths))
    assert len(held) <= least * 11 / 9 + 1
