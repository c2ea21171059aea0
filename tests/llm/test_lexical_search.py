"""Ranked search against scoring every document, and against its SQL."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ingestctl.llm import lexical_search as L
from tests.conftest import rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = [
    (1, "The cat sat on the mat. The CAT!"),
    (2, "the dog sat on the log"),
    (2, "the dog sat on the log"),
    (3, None),
    (4, ""),
    (5, "... --- ..."),
    (6, "cat " * 70_000 + "Größe"),
    (None, "the cat and the dog"),
    (None, "the cat and the dog"),
    (7, "größe GRÖSSE grÖße 日本語 naïve\x7fcat_dog"),
    *[(i, f"word{i % 7} word{i % 3} the " + "cat " * (i % 5)) for i in range(8, 60)],
]
ITEMS = [(1, "the cat, the Cat and größe"), (1, "the cat, the Cat and größe"), (2, "unknown"), (3, None), (None, "word1 word2 dog"), (4, "")]


def split(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, best=10):
    counted = [(i, Counter(split(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    result = []
    for item, text in items:
        scored = []
        for i, c in counted:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // n_terms
            score = 0
            for t in set(split(text)) & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        for rank, (score, none, i) in enumerate(sorted(scored)[:best], 1):
            result.append((item, rank, None if none else i, -score))
    return sorted(result, key=repr)


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, term string, block int"),
        spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, rank int, terms string"),
    )


@pytest.mark.parametrize("block, at_a_time, vocabulary", [(16_384, 1_000, 300_000), (5, 2, 0)])
def test_every_document_scored(spark, monkeypatch, block, at_a_time, vocabulary):
    """Also with small blocks of documents and items, and with an index of all terms."""
    monkeypatch.setattr(L, "BLOCK_DOCUMENTS", block)
    monkeypatch.setattr(L, "ITEMS_AT_A_TIME", at_a_time)
    monkeypatch.setattr(L, "VOCABULARY", vocabulary)
    docs, items = frames(spark, DOCS, ITEMS)
    assert rows(L.search(docs, items)) == brute(DOCS, ITEMS)


def test_empty_tables(spark):
    docs, items = frames(spark, DOCS, ITEMS)
    assert rows(L.search(docs.limit(0), items)) == []
    assert rows(L.search(docs, items.limit(0))) == []


def test_text_ids(spark):
    docs = spark.createDataFrame([("b", "cat"), ("a", "cat"), (None, "cat"), ("c", "dog dog")], "name string, body string")
    items = spark.createDataFrame([("q", "cat")], "item_id string, text string")
    assert rows(L.search(docs, items, "name", "body").select("rank", "doc_id")) == [(1, "a"), (2, "b"), (3, None)]


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.dictionaries(st.integers(0, 6), st.integers(1, 4), max_size=5), min_size=1, max_size=60),
    st.lists(st.integers(0, 8), unique=True, max_size=6),
    st.integers(1, 5),
    st.integers(0, 6),
    st.integers(1, 5),
)
def test_best_first(docs, item, best, leaf, wave):
    """Positions, impacts and the search over one block, whatever is scored whole and split at a time."""
    lengths = np.array([sum(d.values()) for d in docs])
    postings = []
    for term in range(7):
        at = [i for i, d in enumerate(docs) if term in d]
        if at:
            tfs = np.array([docs[i][term] for i in at], dtype=np.uint32)
            postings.append((b"%d" % term, np.array(at, dtype=np.uint16).tobytes(), tfs.tobytes()))
    if not postings:
        return
    weights = {b"%d" % t: 300 + 100 * (t % 4) for t in range(7)}
    total, n_terms = int((lengths > 0).sum()), int(lengths.sum())
    lists = L.Lists.of(postings, lengths, weights, total, n_terms)
    scores = []
    for i, d in enumerate(docs):
        m = 10 + (90 * int(lengths[i]) * total) // n_terms
        score = sum(weights[b"%d" % t] * ((10**9 * d[t]) // (1000 * d[t] + 8 * m)) for t in item if t in d)
        if score:
            scores.append((score, i))
    expected = sorted(scores, key=lambda s: (-s[0], s[1]))[:best]
    assert L.best_documents(lists, [b"%d" % t for t in item], best, leaf, wave) == expected
