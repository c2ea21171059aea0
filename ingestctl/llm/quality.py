"""Quality scores from supervised subword embeddings.

A document is the mean of learned vectors: one for each word, for each of its character
n-grams, and for each pair of neighbouring words, all found by hash. A softmax layer on that
mean gives the classes. Vectors and layer are trained together by stochastic gradient descent
on a bounded sample of labelled documents. For scoring the trained layer is multiplied into
the vectors, so that a word adds one number; a worker keeps the numbers of the words it met.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ingestctl.llm.common import Recent, crc_remainder, whole_text
from ingestctl.llm.labels import Sample, sample, with_texts

BUCKETS = 1 << 16
NGRAMS = (3, 4)
DIMENSION = 16
EPOCHS = 6
RATE = 0.5
#: Bound of the training sample: labelled documents of each class.
PER_CLASS = 1_500
#: Words whose numbers a worker keeps.
KEPT_WORDS = 250_000
_PAIR, _SAME = 0x9E3779B1, 0x7F4A7C15


def grams(word: str) -> list[str]:
    """A word's character n-grams, with its edges marked."""
    edged = f"<{word}>"
    return [edged[i : i + n] for n in NGRAMS for i in range(len(edged) - n + 1)]


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % BUCKETS


def word_features(word: str) -> list[int]:
    """Buckets of the word itself and of its character n-grams."""
    return [bucket(f) for f in (f"={word}", *grams(word))]


def word_hash(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def pair_features(hashes: np.ndarray) -> np.ndarray:
    """Buckets of the pairs of neighbouring words; a word followed by itself is one feature for all words."""
    first, second = hashes[:-1].astype(np.uint64), hashes[1:].astype(np.uint64)
    mixed = (first * np.uint64(_PAIR) + second) % np.uint64((1 << 31) - 1)
    mixed[first == second] = _SAME
    return (mixed % np.uint64(BUCKETS)).astype(np.int64)


def document_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a whole text and how often each occurs."""
    words = text.split()
    ids: list[int] = []
    times: list[int] = []
    for word, n in Counter(words).items():
        found = word_features(word)
        ids += found
        times += [n] * len(found)
    counts = np.bincount(np.array(ids, dtype=np.int64), times, BUCKETS).astype(np.int64)
    if len(words) > 1:
        pairs = pair_features(np.array([word_hash(w) for w in words], dtype=np.uint64))
        counts += np.bincount(pairs, minlength=BUCKETS)
    found = np.flatnonzero(counts)
    return found, counts[found]


@dataclass(frozen=True)
class Model:
    """What a feature adds to the log odds of label 1, before the mean is taken; and the constant."""

    weights: np.ndarray
    bias: float


def train(
    features: list[tuple[np.ndarray, np.ndarray]],
    labels: list[int],
    class_weight: tuple[float, float],
    dimension: int = DIMENSION,
    epochs: int = EPOCHS,
    rate: float = RATE,
) -> Model:
    """Stochastic gradient descent, one document at a time, with a rate that falls to zero."""
    if not labels or len(set(labels)) < 2:
        constant = 0.0 if not labels else (4.0 if labels[0] else -4.0)
        return Model(np.zeros(BUCKETS, dtype=np.float32), constant)
    rng = np.random.default_rng(7)
    vectors = rng.uniform(-1 / dimension, 1 / dimension, (BUCKETS, dimension)).astype(np.float32)
    layer, bias = np.zeros((2, dimension), dtype=np.float32), np.zeros(2, dtype=np.float32)
    steps, done = epochs * len(labels), 0
    for _ in range(epochs):
        for i in rng.permutation(len(labels)):
            step = rate * (1 - done / steps) * min(4.0, class_weight[labels[i]])
            done += 1
            ids, counts = features[i]
            share = (counts / max(1, counts.sum())).astype(np.float32)
            mean = share @ vectors[ids]
            logits = layer @ mean + bias
            odds = np.exp(logits - logits.max())
            error = odds / odds.sum()
            error[labels[i]] -= 1
            back = error @ layer
            layer -= step * np.outer(error, mean)
            bias -= step * error
            # a share is small in a long text; scaled up, each document moves its vectors alike
            vectors[ids] -= step * np.outer(share / max(share.max(initial=0), 1e-6), back)
    return Model((vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0]))


class Scorer:
    """Scores whole texts with a trained model; keeps what it knows about words."""

    def __init__(self, model: Model):
        self.model, self.at = model, {}
        self.of_gram = Recent(lambda gram: float(model.weights[bucket(gram)]), KEPT_WORDS // 2)
        self.sums = np.zeros(1024)
        self.sizes = np.zeros(1024, dtype=np.int64)
        self.hashes = np.zeros(1024, dtype=np.uint64)

    def _index(self, word: str) -> int:
        i = self.at[word] = len(self.at)
        if i == len(self.sums):
            self.sums, self.sizes, self.hashes = (np.append(a, np.zeros_like(a)) for a in (self.sums, self.sizes, self.hashes))
        found = grams(word)
        self.sums[i] = self.model.weights[bucket(f"={word}")] + sum(map(self.of_gram.__getitem__, found))
        self.sizes[i], self.hashes[i] = len(found) + 1, word_hash(word)
        return i

    def log_odds(self, texts: list[str]) -> Iterator[float]:
        get = self.at.get
        for text in texts:
            if len(self.at) > KEPT_WORDS:
                self.at.clear()
            own = np.array([i if (i := get(w)) is not None else self._index(w) for w in text.split()], dtype=np.int64)
            if not len(own):
                yield self.model.bias
                continue
            total, n = self.sums[own].sum(), self.sizes[own].sum() + len(own) - 1
            if len(own) > 1:
                total += self.model.weights[pair_features(self.hashes[own])].sum(dtype=np.float64)
            yield float(total / n) + self.model.bias


def fit(docs: DataFrame, chosen: Sample, id_column: str = "doc_id", text_column: str = "text") -> Model:
    """Features of the sampled documents are made in tasks; the driver gets at most 2 x ``per_class`` of them."""

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [document_features(t) for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].astype(str),
                    "label": batch["label"],
                    "ids": [i.astype("<u2").tobytes() for i, _ in found],
                    "counts": [c.astype("<u4").tobytes() for _, c in found],
                }
            )

    rows = (
        with_texts(chosen, docs, id_column, whole_text(text_column))
        .mapInPandas(featurise, "doc_id string, label int, ids binary, counts binary")
        .toPandas()
        .sort_values(["doc_id", "ids"])
    )
    # as they came: 6 bytes a feature
    features = [(np.frombuffer(i, "<u2"), np.frombuffer(c, "<u4")) for i, c in zip(rows["ids"], rows["counts"])]
    return train(features, rows["label"].tolist(), (chosen.weight(0), chosen.weight(1)))


def score_column(text: Column, model: Model) -> Column:
    """The probability of label 1."""

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for texts in batches:
            odds = np.fromiter(scorer.log_odds(texts.tolist()), np.float64, len(texts))
            yield pd.Series(1 / (1 + np.exp(-np.clip(odds, -50, 50))))

    return scores(text)


def held_out(id_column: str = "doc_id") -> Column:
    """Ids that no label is learned from."""
    return crc_remainder(id_column, 3) == 1


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
    per_class: int = PER_CLASS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Labels are learned from ids that are not held out, at most ``per_class`` of each class;
    contradicting and null labels are left out, repeated ones count once. Null texts count as
    empty; an empty text scores the constant of the model. Without labels of both classes the
    score is constant. Other columns are ignored; an empty table gives an empty result.
    """
    chosen = sample(labels, label_column, held_out(), per_class)
    model = fit(docs, chosen, id_column, text_column)
    scored = docs.select(
        F.col(id_column).alias("doc_id"),
        held_out(id_column).alias("held_out"),
        score_column(whole_text(text_column), model).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, text_column: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with all their columns."""
    chosen = sample(labels, options.get("label_column", "quality"), held_out(), options.get("per_class", PER_CLASS))
    model = fit(docs, chosen, options.get("id_column", "doc_id"), text_column)
    return docs.where(score_column(whole_text(text_column), model) >= 0.5)
