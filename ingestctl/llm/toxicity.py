"""Toxicity scores that do not lean on who is mentioned.

A logistic model over the words of a text and their character n-grams (each counted once per
text). In every sentence of a labelled text that mentions a group, each mention by itself is
swapped for another one of its kind, and the squared change of the score is part of the loss; so
the terms themselves get no weight of their own, and neutral mentions stay neutral. As mentions
are rare, one sentence of each text gets a made-up one, whose swap is penalised alike, so that
character n-grams that terms share with insults do not mark the terms either. Weights
that carry no evidence are driven to zero, which leaves a short list to send to the tasks.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ingestctl.llm.common import crc_remainder, whole_text
from ingestctl.llm.labels import Sample, sample, with_texts

#: Words of one kind may be swapped for one another; English, German, French and Spanish, in lower case.
IDENTITY_TERMS = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual"),
    ("woman", "man"),
    ("women", "men"),
    ("female", "male"),
    ("immigrant", "native", "foreigner"),
    ("immigrants", "natives", "foreigners"),
    ("disabled", "deaf", "blind"),
    ("transgender", "cisgender"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "katholiken", "atheisten"),
    ("muslimisch", "christlich", "jüdisch", "hinduistisch", "buddhistisch", "katholisch"),
    ("schwarze", "weiße", "asiatische", "afrikanische", "europäische"),
    ("schwul", "lesbisch", "bisexuell", "heterosexuell"),
    ("frau", "mann"),
    ("frauen", "männer"),
    ("weiblich", "männlich"),
    ("einwanderer", "einheimische", "ausländer", "flüchtlinge"),
    ("behinderte", "gehörlose", "blinde"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "catholiques", "athées"),
    ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "catholique", "athée"),
    ("noirs", "blancs", "asiatiques", "africains", "européens"),
    ("homosexuel", "lesbienne", "bisexuel", "hétérosexuel"),
    ("femme", "homme"),
    ("femmes", "hommes"),
    ("immigrés", "étrangers", "réfugiés"),
    ("handicapés", "sourds", "aveugles"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "católicos", "ateos"),
    ("musulmán", "cristiano", "judío", "hindú", "budista", "católico", "ateo"),
    ("negros", "blancos", "asiáticos", "africanos", "europeos"),
    ("homosexual", "lesbiana", "bisexual", "heterosexual"),
    ("mujer", "hombre"),
    ("mujeres", "hombres"),
    ("inmigrantes", "extranjeros", "refugiados"),
    ("discapacitados", "sordos", "ciegos"),
)
#: Bound of the training sample: labelled documents of each class.
PER_CLASS = 2_000
NGRAMS = (4, 5)
#: A feature counts if it occurs in so many sampled texts.
LEAST_TEXTS = 3
EPOCHS = 8
COUNTERFACTUAL = 2.0
RATE, L1, L2 = 1.0, 4.0, 1.0
#: Words whose features a worker keeps.
KEPT_WORDS = 300_000
WORD = re.compile(r"\w+")
SENTENCE_END = re.compile(r"[.!?\n]+")


def word_features(word: str) -> list[int]:
    """32-bit hashes of a word and of its character n-grams, with its start and end marked."""
    edged = f"<{word}>"
    grams = [edged[i : i + n] for n in NGRAMS for i in range(len(edged) - n + 1)]
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) for g in [f"={word}", *grams]]


def text_features(words: set[str]) -> np.ndarray:
    return np.array(sorted({f for w in words for f in word_features(w)}), dtype=np.uint32)


def _following(kinds: tuple[tuple[str, ...], ...]) -> dict[str, str]:
    """The term that takes each term's place; a term of several kinds belongs to its first."""
    found: dict[str, str] = {}
    for kind in kinds:
        for i, term in enumerate(kind):
            found.setdefault(term, kind[(i + 1) % len(kind)])
    return found


FOLLOWING = _following(IDENTITY_TERMS)


def counterfactual(words: set[str], kinds: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> set[str] | None:
    """The words with every identity term swapped for the next one of its kind; None without such a term."""
    following = _following(kinds)
    if words.isdisjoint(following):
        return None
    return {following.get(w, w) for w in words}


#: Feature numbers that go and those that come by a swap, and the share of a text's swaps that do just this.
Swap = tuple[tuple[int, ...], tuple[int, ...], float]


def _swap(words: list[str], at: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    before = {f for w in set(words) for f in word_features(w)}
    after = {f for w in {*words[:at], FOLLOWING[words[at]], *words[at + 1 :]} for f in word_features(w)}
    return tuple(sorted(before - after)), tuple(sorted(after - before))


def swaps(text: str) -> tuple[list[Swap], list[Swap]]:
    """What swapping one mention in one sentence changes: for each mention there is, and for a made-up one.

    The made-up mention goes to the front of the first sentence with words; which term it is
    depends on the text alone. Mentions that change the same features are one swap.
    """
    found: Counter = Counter()
    first: list[str] = []
    for sentence in SENTENCE_END.split(text.lower()):
        words = WORD.findall(sentence)
        first = first or words
        if not FOLLOWING.keys().isdisjoint(words):
            found.update(_swap(words, i) for i, w in enumerate(words) if w in FOLLOWING)
    total = sum(found.values())
    terms = list(FOLLOWING)
    term = terms[zlib.crc32(text.encode("utf-8", "surrogatepass")) % len(terms)]
    return [(*swap, n / total) for swap, n in sorted(found.items())], [(*_swap([term, *first], 0), 1.0)]


@dataclass(frozen=True)
class Model:
    """Nonzero weights by feature hash, and the constant."""

    weights: dict[int, float]
    bias: float


class _Ftrl:
    """Per-coordinate steps with an L1 and an L2 term (follow the regularised leader)."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        kept = -(z - np.sign(z) * L1) / ((1 + np.sqrt(n)) / RATE + L2)
        return np.where(np.abs(z) <= L1, 0.0, kept)

    def step(self, at: np.ndarray, gradient: np.ndarray | float, weights: np.ndarray) -> None:
        n = self.n[at]
        self.n[at] = n + gradient**2
        self.z[at] += gradient - (np.sqrt(self.n[at]) - np.sqrt(n)) / RATE * weights


def train(
    texts: list[tuple[np.ndarray, np.ndarray | None]], labels: list[int], swapped: list[list[Swap]] | None = None
) -> Model:
    """``texts``: the features of each text and of its counterfactual, if it has one as a whole; ``swapped``: the
    swaps of each text's sentences.

    Both classes weigh what their sampled texts weigh; the sample holds them in like numbers, so
    that the rare class is not drowned.
    """
    if not labels or len(set(labels)) < 2:
        constant = 0.0 if not labels else (4.0 if labels[0] else -4.0)
        return Model({}, constant)
    seen = Counter()
    for own, other in texts:
        seen.update(own.tolist())
        if other is not None:
            seen.update(other.tolist())
    known = np.array(sorted(f for f, n in seen.items() if n >= LEAST_TEXTS), dtype=np.uint32)

    def indexed(features: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.isin(known, features, assume_unique=True))

    pairs = [(indexed(own), None if other is None else indexed(other)) for own, other in texts]
    changes: list[list[tuple[np.ndarray, np.ndarray, float]]] = [[] for _ in texts]
    for i, (own, other) in enumerate(pairs):
        if other is not None:
            changes[i].append((np.setdiff1d(own, other), np.setdiff1d(other, own), 1.0))
    for i, own_swaps in enumerate(swapped or []):
        sides = [(*(indexed(np.array(side, dtype=np.uint32)) for side in (gone, new)), share) for gone, new, share in own_swaps]
        changes[i] += [(gone, new, share) for gone, new, share in sides if len(gone) or len(new)]
    learner, rng = _Ftrl(len(known) + 1), np.random.default_rng(7)
    constant = len(known)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(labels)):
            own = pairs[i][0]
            at = np.append(own, constant)
            weights = learner.weights(at)
            score = 1 / (1 + np.exp(-np.clip(weights.sum(), -50, 50)))
            learner.step(at, score - labels[i], weights)
            for gone, new, share in changes[i]:
                gone_weights, new_weights = learner.weights(gone), learner.weights(new)
                change = COUNTERFACTUAL * share * (gone_weights.sum() - new_weights.sum())
                learner.step(gone, change, gone_weights)
                learner.step(new, -change, new_weights)
    final = learner.weights(np.arange(len(known) + 1))
    kept = np.flatnonzero(final[:-1])
    return Model(dict(zip(known[kept].tolist(), final[kept].tolist())), float(final[-1]))


class Scorer:
    def __init__(self, model: Model):
        self.model, self.hits = model, {}

    def _hits(self, word: str) -> tuple[int, ...]:
        if len(self.hits) > KEPT_WORDS:
            self.hits.clear()
        weights = self.model.weights
        self.hits[word] = found = tuple(f for f in word_features(word) if f in weights)
        return found

    def log_odds(self, text: str) -> float:
        get, found = self.hits.get, set()
        for word in set(WORD.findall(text.lower())):
            hits = get(word)
            if hits is None:
                hits = self._hits(word)
            if hits:
                found.update(hits)
        return self.model.bias + sum(self.model.weights[f] for f in sorted(found))


SWAP_FIELDS = ("gone", "new", "share")


def fit(docs: DataFrame, chosen: Sample, id_column: str = "doc_id", text_column: str = "text") -> Model:
    """Features are made in tasks; the driver gets those of at most 2 x ``per_class`` texts."""

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [text_features(set(WORD.findall(text.lower()))).astype("<u4").tobytes() for text in batch["text"]]
            both = [[dict(zip(SWAP_FIELDS, swap)) for side in swaps(text) for swap in side] for text in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype(str), "label": batch["label"], "own": own, "swaps": both})

    rows = (
        with_texts(chosen, docs, id_column, whole_text(text_column))
        .mapInPandas(featurise, "doc_id string, label int, own binary, swaps array<struct<gone:array<long>,new:array<long>,share:double>>")
        .toPandas()
        .sort_values(["doc_id", "own"])
    )
    texts = [(np.frombuffer(own, "<u4"), None) for own in rows["own"]]
    swapped = [[tuple(swap[name] for name in SWAP_FIELDS) for swap in found] for found in rows["swaps"]]
    return train(texts, rows["label"].tolist(), swapped)


def score_column(text: Column, model: Model) -> Column:
    """The probability of label 1."""

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for texts in batches:
            odds = np.fromiter(map(scorer.log_odds, texts), np.float64, len(texts))
            yield pd.Series(1 / (1 + np.exp(-np.clip(odds, -50, 50))))

    return scores(text)


def held_out(id_column: str = "doc_id") -> Column:
    """Ids that no label is learned from."""
    return crc_remainder(id_column, 5) == 0


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
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
