"""Language-model scores against a plain model that counts escapes one by one."""

import math
import zlib
from collections import Counter, defaultdict

import pytest

from ingestctl.llm import ppm as P
from tests.conftest import rows


def documents(spark, pairs):
    schema = "doc_id long, text string, word int, gram string, n long, score string, row long"
    return spark.createDataFrame([(i, t, 1, "g", 2, "s", 3) for i, t in pairs], schema)


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()


def is_training(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 7 != 2


class PlainModel:
    """Prediction by partial matching with symbol exclusion; contexts are tuples of symbols."""

    def __init__(self, texts, order, contexts):
        self.order, self.after = order, defaultdict(Counter)
        for text in texts:
            marked = [P.START] * order + list(text) + [P.END]
            for i in range(order, len(marked)):
                for k in range(order + 1):
                    self.after[tuple(marked[i - k : i])][marked[i]] += 1

        def rank(context):
            code = 0
            for s in context:
                code = code * P.BASE + s
            return (-sum(self.after[context].values()), len(context), code)

        longer = sorted((c for c in self.after if c), key=rank)
        self.kept = {(), *longer[:contexts]}

    def log(self, text):
        marked, total = [P.START] * self.order + list(text) + [P.END], 0.0
        for i in range(self.order, len(marked)):
            k = max(k for k in range(self.order + 1) if all(tuple(marked[i - j : i]) in self.kept for j in range(k + 1)))
            odds, excluded = 1.0, set()
            while True:
                counts = self.after.get(tuple(marked[i - k : i]), Counter()) if k >= 0 else {}
                if k < 0:
                    odds /= P.SYMBOLS - len(excluded)
                    break
                left = {s: n for s, n in counts.items() if s not in excluded}
                size, kinds = sum(left.values()), len(left)
                escapes = kinds if k or len(counts) < P.SYMBOLS else 0
                if marked[i] in left:
                    odds *= left[marked[i]] / (size + escapes)
                    break
                if size:
                    odds *= escapes / (size + escapes)
                excluded |= set(left)
                k -= 1
            total += math.log10(odds)
        return total


TEXTS = [
    (0, "The cat sat on the mat. THE END"),
    (1, None),
    (2, ""),
    (2, ""),
    (3, "the the the the"),
    (4, "É accents é, É"),
    (5, "  \t\n "),
    (6, "abracadabra abracadabra"),
    (None, "no id at all"),
    (7, "the cat sat on the mat. the end"),
    (8, "zebra quilt xylophone"),
    *((i, f"document {i} is here with the cat") for i in range(9, 30)),
]


@pytest.mark.parametrize(("order", "contexts", "hot"), [(3, 10_000, 1_000), (4, 12, 5), (2, 40, 1)])
def test_scores(spark, order, contexts, hot):
    got = P.score_documents(documents(spark, TEXTS), order=order, contexts=contexts, hot_words=hot).collect()
    training = [lowered(t) for i, t in TEXTS if is_training(i)]
    counts = Counter(w for t in training for w in t.split())
    tokens, kinds = sum(counts.values()) + len(training), len(counts) + 1
    model = PlainModel(training, order, contexts)
    expected = []
    for doc, text in TEXTS:
        words = lowered(text).split()
        logs = [math.log10((counts[w] + 1) / (tokens + kinds + 1)) for w in words]
        base = sum(logs) + math.log10((len(training) + 1) / (tokens + kinds + 1))
        known = sum(counts[w] > 0 for w in words) + 1
        expected.append((doc, not is_training(doc), len(words) + 1, known, tokens, base, model.log(lowered(text))))
    assert len(got) == len(expected)
    order_by = lambda r: repr(tuple(r)[:4]) + f"{r[5]:.6f}"
    for row, plain in zip(sorted(got, key=order_by), sorted(expected, key=order_by)):
        assert tuple(row)[:5] == plain[:5]
        assert row["base_score"] == pytest.approx(plain[5], abs=1e-9)
        assert row["score"] == pytest.approx(plain[6], rel=1e-5, abs=1e-4)


def test_odds_of_all_symbols_add_up():
    import numpy as np

    after = {0: (np.array([97, 98, 256]), np.array([3, 2, 1])), 1: (np.array([98]), np.array([2]))}
    trie = P.build([(0, 0), (1, 97)], after, 1)
    for row in range(2):
        assert sum(10.0 ** trie.logs[row, trie.column[s]] for s in range(P.SYMBOLS)) == pytest.approx(1, abs=1e-5)


def test_long_texts_in_blocks(monkeypatch):
    import numpy as np

    text = b"abcab" * 300
    whole = list(P.count_grams(iter([text, b""]), 2))
    after = {0: (np.array([97, 98, 99]), np.array([2, 2, 1])), 1: (np.array([98]), np.array([2]))}
    trie = P.build([(0, 0), (1, 97)], after, 2)
    score = trie.score(text)
    monkeypatch.setattr(P, "_BLOCK", 64)
    monkeypatch.setattr(P, "_KEPT", 1)
    parts = Counter()
    for codes, counts in P.count_grams(iter([text, b""]), 2):
        parts.update(dict(zip(codes.tolist(), counts.tolist())))
    assert parts == Counter(dict(zip(whole[0][0].tolist(), whole[0][1].tolist())))
    assert trie.score(text) == pytest.approx(score)


def test_without_training_rows(spark):
    held = next(i for i in range(100) if not is_training(i))
    [row] = P.score_documents(documents(spark, [(held, "ab")])).collect()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (2, 0, 0, 0)
    assert row["score"] == pytest.approx(-3 * math.log10(P.SYMBOLS), rel=1e-5)
    assert rows(P.score_documents(documents(spark, []))) == []


@pytest.mark.parametrize(("order", "hot_grams"), [(5, 2_000_000), (4, 30), (3, 1)])
def test_every_context_counts(spark, order, hot_grams):
    import random

    rng = random.Random(3)
    noise = [(i, "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(800))) for i in range(40, 70)]
    texts = [*TEXTS, *noise]
    training = [lowered(t) for i, t in texts if is_training(i)]
    model = PlainModel(training, order, 10**9)
    assert order < 5 or len(model.kept) > 30_000
    got = P.score_documents(documents(spark, texts), order=order, hot_grams=hot_grams).collect()
    assert sorted((repr(r["doc_id"]), round(r["score"], 6)) for r in got) == sorted(
        (repr(i), round(model.log(lowered(t)), 6)) for i, t in texts
    )
