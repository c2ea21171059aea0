"""Quality and toxicity: held-out accuracy, fixed cases, and what the counterfactual term does."""

import tracemalloc
import zlib

import numpy as np
import pytest

from ingestctl.llm import quality as Q, toxicity as T
from tests.conftest import rows

DIR = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, label int, score string, held_out string, word int"


def documents(spark, pairs):
    return spark.createDataFrame([(i, t, 1, "s", "h", 2) for i, t in pairs], SCHEMA)


def labels(spark, triples):
    return spark.createDataFrame(triples, "doc_id long, quality int, toxic int, text string")


@pytest.mark.parametrize(
    ("score", "label", "divisor", "rest", "least"),
    [(Q.score_quality, "quality", 3, 1, 0.97), (T.score_toxicity, "toxic", 5, 0, 0.93)],
)
def test_held_out_accuracy(spark, score, label, divisor, rest, least):
    docs, marks = (spark.read.parquet(f"{DIR}/{name}.parquet") for name in ("documents", "labels"))
    got = score(docs, marks)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    assert got.count() == docs.count()
    found = got.join(marks, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % divisor == rest) for r in found)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    unseen = [r for r in found if r["held_out"]]
    assert sum(r["predicted"] == r[label] for r in unseen) / len(unseen) >= least


CASES = [(1, None), (2, ""), (2, ""), (None, "no id"), (3, "word " * 100_000), (4, "퟿ odd \u0000 text")]


@pytest.mark.parametrize("score", [Q.score_quality, T.score_toxicity])
@pytest.mark.parametrize(
    "marks",
    [
        [],
        [(1, 1, 1, None)],
        [(1, 1, 1, "a"), (2, 0, 0, "b"), (2, 1, 1, "b"), (3, 0, 0, "c"), (3, 0, 0, "c"), (None, 1, 1, "d"), (4, None, None, "e")],
    ],
)
def test_odd_rows(spark, score, marks):
    got = score(documents(spark, CASES), labels(spark, marks)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in CASES)
    assert all(0 <= r["score"] <= 1 for r in got)
    same = {r["score"] for r in got if r["doc_id"] in (1, 2)}
    assert len(same) == 1


def test_the_sample_is_bounded_by_rows(spark):
    from pyspark.sql import functions as F

    from ingestctl.llm.labels import sample, with_texts

    docs = documents(spark, [(1, f"copy {i}") for i in range(200)] + [(i, "other") for i in range(2, 30)])
    chosen = sample(labels(spark, [(i, i % 2, 0, "") for i in range(1, 30)]), "quality", F.lit(False), 100)
    texts = with_texts(chosen, docs, "doc_id", F.col("text")).collect()
    assert sorted(r["doc_id"] for r in texts) == list(range(1, 30))
    assert next(r["text"] for r in texts if r["doc_id"] == 1) == "copy 0"


@pytest.mark.parametrize("score", [Q.score_quality, T.score_toxicity])
def test_empty_table(spark, score):
    assert rows(score(documents(spark, []), labels(spark, [(1, 1, 0, "x")]))) == []


def test_rejected_documents_go(spark):
    docs, marks = (spark.read.parquet(f"{DIR}/{name}.parquet") for name in ("documents", "labels"))
    kept = Q.keep_good(docs, marks)
    assert kept.columns == docs.columns
    good = {r["doc_id"] for r in Q.score_quality(docs, marks).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in kept.collect()} == good and 0 < len(good) < docs.count()


def test_kept_words_score_like_a_text_alone(monkeypatch):
    monkeypatch.setattr(Q, "KEPT_WORDS", 3)
    rng = np.random.default_rng(1)
    model = Q.Model(rng.normal(size=Q.BUCKETS).astype(np.float32), 0.25)
    texts = ["", "one", "two two words", "a b c " * 400]
    at_once = list(Q.Scorer(model).log_odds(texts))
    for text, odds in zip(texts, at_once):
        ids, counts = Q.document_features(text)
        mean = (model.weights[ids] * counts).sum() / max(1, counts.sum())
        assert odds == pytest.approx(model.bias + mean, abs=1e-5)


def _features(sentence):
    words = set(T.WORD.findall(sentence.lower()))
    other = T.counterfactual(words)
    return T.text_features(words), None if other is None else T.text_features(other)


def test_counterfactual_term_frees_neutral_mentions(monkeypatch):
    """Toxic sentences often name one group here; the insult, not the group, must carry the score."""
    toxic = [f"those muslims are vermin {i}" for i in range(60)]
    neutral = [f"those people are fine today {i}" for i in range(50)] + ["jews met today"] * 10
    sentences, marks = toxic + neutral, [1] * 60 + [0] * 60

    def scores(strength):
        monkeypatch.setattr(T, "COUNTERFACTUAL", strength)
        monkeypatch.setattr(T, "L1", 0.1)
        scorer = T.Scorer(T.train([_features(s) for s in sentences], marks))
        return [scorer.log_odds(s) for s in ("muslims opened a school", "christians opened a school", "they are vermin")]

    plain, fair = scores(0.0), scores(4.0)
    assert abs(fair[0] - fair[1]) < abs(plain[0] - plain[1]) / 2
    assert fair[0] < plain[0] and fair[0] < fair[2]


def test_counterfactual_swaps_within_a_kind():
    assert T.counterfactual({"a", "woman"}) == {"a", "man"}
    assert T.counterfactual({"a", "plain", "text"}) is None


def test_swaps_are_of_one_mention_in_one_sentence():
    def changed(gone, new):
        return {tuple(sorted(set(T.word_features(a)) - set(T.word_features(b)))) for a, b in ((gone, new), (new, gone))}

    real, made_up = T.swaps("A woman and a man met. Frauen kamen!")
    assert [share for *_, share in real] == pytest.approx([1 / 3] * 3)
    told = [{gone, new} for gone, new, _ in real]
    assert changed("frauen", "männer") in told
    # beside the man, the woman's swap takes only what is hers, and brings nothing
    assert {(), tuple(sorted(set(T.word_features("woman")) - set(T.word_features("man"))))} in told
    assert len(made_up) == 1
    for text in ("nothing here", "", "..."):
        real, made_up = T.swaps(text)
        assert real == [] and len(made_up) == 1 and made_up == T.swaps(text)[1]
    again, _ = T.swaps("Muslims came. Muslims came. Jews came.")
    assert sorted(share for *_, share in again) == pytest.approx([1 / 3, 2 / 3])


def test_every_language_has_terms():
    for word in ("muslims", "muslime", "musulmans", "musulmanes", "frau", "femme", "mujer", "woman"):
        assert T.FOLLOWING[word] != word


def test_swaps_of_sentences_close_the_gap_between_groups(monkeypatch):
    """With the penalty, neutral sentences about a group that insults often name score like those about another."""
    toxic = [f"Good day. Those muslims are vermin {i}. Bye." for i in range(60)]
    neutral = [f"Good day. Those people are fine {i}. Bye." for i in range(50)] + ["Jews met today."] * 10
    texts, marks = toxic + neutral, [1] * 60 + [0] * 60
    monkeypatch.setattr(T, "L1", 0.1)
    features = [(T.text_features(set(T.WORD.findall(t.lower()))), None) for t in texts]

    def gap(strength):
        monkeypatch.setattr(T, "COUNTERFACTUAL", strength)
        scorer = T.Scorer(T.train(features, marks, [sum(T.swaps(t), []) for t in texts]))
        assert scorer.log_odds("they are vermin") > scorer.log_odds("they are fine")
        return abs(scorer.log_odds("muslims opened a school") - scorer.log_odds("christians opened a school"))

    assert gap(2.0) < gap(0.0) / 2


@pytest.mark.parametrize("strength", [0.0, 2.0])
def test_training_goes_down_the_stated_loss(strength, monkeypatch):
    """Without its L1 and L2 terms, one step equals the gradient of log loss plus half the squared change, by differences."""
    monkeypatch.setattr(T, "COUNTERFACTUAL", strength)
    step = {}

    class Spy(T._Ftrl):
        def weights(self, at):
            return np.linspace(-0.5, 0.7, len(self.z))[at]

        def step(self, at, gradient, weights):
            for i in at:
                step[int(i)] = step.get(int(i), 0.0) + float(gradient)

    monkeypatch.setattr(T, "_Ftrl", Spy)
    monkeypatch.setattr(T, "EPOCHS", 1)
    monkeypatch.setattr(T, "LEAST_TEXTS", 1)
    own = [np.array([1, 2, 3], np.uint32), np.array([2, 4, 5], np.uint32)]
    swapped = [[((1, 3), (4,), 0.5), ((2,), (5, 9), 0.5)], []]
    marks = [1, 0]
    T.train([(o, None) for o in own], marks, swapped)

    def loss(w):
        total = 0.0
        for o, mark in zip(own, marks):
            z = w[[i - 1 for i in o]].sum() + w[5]
            total += np.log1p(np.exp(-z if mark else z))
        for gone, new, share in swapped[0]:
            change = sum(w[i - 1] for i in gone if i < 6) - sum(w[i - 1] for i in new if i < 6)
            total += strength * share * change**2 / 2
        return total

    at = np.linspace(-0.5, 0.7, 6)
    for i in range(6):
        up, down = at.copy(), at.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        assert step.get(i, 0.0) == pytest.approx((loss(up) - loss(down)) / 2e-6, abs=1e-5)


def test_quality_training_takes_features_as_they_came():
    """Six bytes a feature are enough for the driver: no wider copy of all documents is made."""
    rng = np.random.default_rng(1)
    features = [(np.sort(rng.choice(Q.BUCKETS, 20_000, replace=False)).astype("<u2"), rng.integers(1, 9, 20_000).astype("<u4")) for _ in range(400)]
    labels = [i % 2 for i in range(400)]
    wide = [(i.astype(np.int64), c.astype(np.int64)) for i, c in features[:40]]
    assert np.array_equal(Q.train(features[:40], labels[:40], (1.0, 1.0), epochs=1).weights, Q.train(wide, labels[:40], (1.0, 1.0), epochs=1).weights)
    tracemalloc.start()
    Q.train(features, labels, (1.0, 1.0), epochs=1)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 24e6  # the shares of all documents at once take 32 MB more
