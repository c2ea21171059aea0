"""Secret scans: fixed patterns, and a linear-chain conditional random field for what they miss.

Texts are cut into tokens, each tagged as the beginning of a secret, its inside or outside.
The tags' scores come from the token's shape, the neighbouring words and the kind of file, and
from which tag follows which. The field is trained on what the patterns find in a bounded
sample, with the words around a secret hidden in some copies and the looks of particular kinds
in others, so that what secrets have in common counts by itself. As the patterns know few
alphabets, copies of the same places hold made-up secrets of others, and made-up names, numbers
and links that merely look alike and are no secrets. Most tokens are outside by more than any change of tag could gain; between those, the
best tags are found by the Viterbi algorithm, which is the same as finding them over the whole
text.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ingestctl.llm.common import Recent, whole_text
from ingestctl.scratch import materialise

# The base patterns, in their listed order, with the least length of what they find.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "crf")

OUTSIDE, BEGIN, INSIDE = 0, 1, 2
#: Bounds of the training sample: texts with a base span, texts without, windows of each text.
WITH_SECRET, WITHOUT, WINDOWS_PER_TEXT = 300, 100, 4
#: Tokens that a worker keeps, per generation; two generations are kept.
KEPT_WORDS = 200_000
#: Tokens on either side of the middle of a training window.
REACH = 10
#: The same for copies with something made up in the middle.
NARROW = 4
EPOCHS, RATE, L2 = 3, 0.2, 1e-4
#: The score of an inside tag without a beginning before it.
NEVER = -12.0
#: A token is a word, or words joined by signs that occur within secrets; other signs stand alone.
_TOKEN = re.compile(r"\w+(?:[+/.\-]+\w+)*|[^\w\s]")
#: Where a token turns from one kind of character to another, but for a capital at its start.
_TURN = re.compile(r"[a-z](?=[A-Z0-9])|[A-Z](?=[0-9])|[0-9](?=[A-Za-z])|(?<=.)[A-Z](?=[a-z])")
#: Parts of a token that look like words in a name.
_WORDLIKE = re.compile(r"[A-Z]?[a-z]{2,}")
_PATTERNS = {
    "assign": re.compile(ASSIGN, re.ASCII | re.IGNORECASE),
    "access": re.compile(f"AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}", re.ASCII),
    "hex": re.compile(f"[0-9a-f]{{{LEAST['hex']},}}", re.ASCII),
}


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, start of the secret itself), in order of start, then of kind as listed."""
    found = []
    if "=" in text or ":" in text:
        found += [
            (m.start(), m.end(), "assign", m.start(2))
            for m in _PATTERNS["assign"].finditer(text)
            if m.end(2) - m.start(2) >= LEAST["assign"]
        ]
    for kind in ("access", "hex") if "AKIA" in text else ("hex",):
        found += [(m.start(), m.end(), kind, m.start()) for m in _PATTERNS[kind].finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _shape(token: str) -> str:
    kinds = "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in token)
    return re.sub(r"(.)\1+", r"\1+", kinds)


def _case(token: str) -> str:
    return "lower" if token.islower() else "upper" if token.isupper() else "title" if token.istitle() else "mixed"


def own_key(token: str) -> tuple:
    """What a token's own characters say; tokens with the same key are alike."""
    size = len(token)
    length = min(12, size) if size < 16 else 12 + min(5, size // 8)
    if token.isalpha():
        case = _case(token)
        turns = min(5, 8 * len(_TURN.findall(token)) // size) if size > 7 and case == "mixed" else 0
        return ("letters", length, case, turns, token.isascii())
    if size == 1:
        return ("sign", token if token.isascii() else "")
    digits = sum(c.isdigit() for c in token)
    shares = [n / size for n in Counter(token).values()]
    entropy = -math.fsum(p * math.log2(p) for p in shares)
    shape = _shape(token)
    return (
        "mixture",
        length,
        min(4, 5 * digits // size),
        min(6, 8 * len(_TURN.findall(token)) // size),
        int(2 * entropy + 1e-9),
        shape if len(shape) <= 6 else "",
        token[:4] if size >= 16 and token[:4].isalpha() else "",
        size >= 8 and not token.strip("0123456789abcdef"),
        size >= 12 and 2 <= digits < size,
        min(3, token.count(".")),
        _case(token),
        4 * sum(map(len, _WORDLIKE.findall(token))) // size,
    )


def _features_of(key: tuple) -> list[tuple]:
    return [("own", key[0]), *((key[0], i, value) for i, value in enumerate(key[1:])), ("own", key[0], key[1])]


def near_key(token: str) -> tuple:
    """What a token says to its neighbours: its word, unless it is long, and what kind it is."""
    kind = "letters" if token.isalpha() else "digits" if token.isdigit() else "sign" if len(token) == 1 else "mixture"
    return (token.lower() if len(token) <= 12 else "", kind)


def near_features(token: str, place: str) -> list[tuple]:
    word, kind = near_key(token)
    return [(place, "word", word), (place, "kind", kind)]


FILE_FEATURES = ("file signs", "file lines")


def file_features(text: str) -> list[tuple]:
    """What the text as a whole says: how much of it is the signs, and how long the lines, of a settings file."""
    size = max(1, len(text))
    signs = sum(text.count(c) for c in "=:{}\"'")
    lines = text.count("\n") + 1
    values = (int(math.log2(1 + 1000 * signs / size)), min(10, int(math.log2(size / lines + 1))))
    return list(zip(FILE_FEATURES, values))


PLACES = {"before": -1, "before that": -2, "after": 1}


#: What a training window may hide: nothing, the neighbouring words, or those and the looks of particular secrets.
HIDE = ("nothing", "words", "looks")
#: Places of shape, head, hex digits and case in the key of a mixture.
_LOOKS = {("mixture", i) for i in (4, 5, 6, 9)}


def window_features(tokens: list[str], file: list[tuple], hide: str = "nothing") -> list[list[tuple]]:
    """The features of each token of a short run."""
    result = []
    for i, token in enumerate(tokens):
        own = _features_of(own_key(token))
        found = [f for f in own if hide != "looks" or f[:2] not in _LOOKS] + file
        for place, step in PLACES.items():
            j = i + step
            if 0 <= j < len(tokens):
                near = near_features(tokens[j], place)
                found += near if hide == "nothing" else near[1:]
        result.append(found)
    return result


@dataclass(frozen=True)
class Model:
    """Scores of each known feature for each tag, and of each tag before the next."""

    index: dict[tuple, int]
    weights: np.ndarray
    follow: np.ndarray

    def sum(self, features: list[tuple]) -> np.ndarray:
        known = [i for f in features if (i := self.index.get(f)) is not None]
        return self.weights[known].sum(axis=0)


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(windows: Iterable[tuple[list[list[tuple]], list[int]]]) -> Model:
    """Gradient ascent on the log likelihood of the tags of each window (forward-backward).

    Windows are taken one by one and kept as numbers alone, as their features are many times as large.
    """
    seen: dict[tuple, int] = {}
    placed = []
    for features, tags in windows:
        found = [seen.setdefault(f, len(seen)) for own in features for f in own]
        ends = np.cumsum([len(own) for own in features])[:-1]
        placed.append((np.array(found, dtype=np.int32), ends.astype(np.int32), np.array(tags, dtype=np.int8)))
    index = {f: i for i, f in enumerate(sorted(seen, key=repr))}
    place = np.fromiter((index[f] for f in seen), np.int32, len(seen))
    weights, follow = np.zeros((len(index), 3)), np.zeros((3, 3))
    follow[OUTSIDE, INSIDE] = NEVER
    rng, step_sum = np.random.default_rng(7), np.full(len(index), 1e-3)
    for _ in range(EPOCHS):
        for w in rng.permutation(len(placed)):
            found, ends, tags = placed[w]
            features, n = np.split(place[found], ends), len(tags)
            scores = np.array([weights[f].sum(axis=0) for f in features])
            forward, backward = scores.copy(), np.zeros((n, 3))
            forward[0, INSIDE] += NEVER
            for i in range(1, n):
                forward[i] += _log_sum(forward[i - 1][:, None] + follow, 0)
            for i in range(n - 2, -1, -1):
                backward[i] = _log_sum(follow + (scores[i + 1] + backward[i + 1])[None, :], 1)
            whole = _log_sum(forward[-1], 0)
            change = -np.exp(forward + backward - whole)
            change[np.arange(n), tags] += 1
            both = np.exp(forward[:-1, :, None] + follow[None] + (scores[1:] + backward[1:])[:, None, :] - whole)
            follow -= RATE / 4 * both.sum(axis=0)
            np.add.at(follow, (tags[:-1], tags[1:]), RATE / 4)
            follow[OUTSIDE, INSIDE] = NEVER
            for i in np.flatnonzero(np.abs(change).max(axis=1) > 1e-3):
                at = features[i]
                step_sum[at] += (change[i] ** 2).sum()
                weights[at] += RATE * change[i] / np.sqrt(step_sum[at])[:, None] - L2 * weights[at]
    return Model(index, weights, follow)


def viterbi(scores: np.ndarray, follow: np.ndarray) -> list[int]:
    """The best tags of a run that has outside tokens before and after it."""
    best = scores[0] + follow[OUTSIDE]
    back = []
    for own in scores[1:]:
        paths = best[:, None] + follow
        back.append(paths.argmax(axis=0))
        best = paths.max(axis=0) + own
    tag = int((best + follow[:, OUTSIDE]).argmax())
    tags = [tag]
    for choice in reversed(back):
        tag = int(choice[tag])
        tags.append(tag)
    return tags[::-1]


class Tagger:
    """Finds secrets in whole texts; keeps what it knows about the tokens it met."""

    def __init__(self, model: Model):
        self.model, self.rows = model, {}
        self.at = Recent(self._index, KEPT_WORDS)
        allowed = np.delete(model.follow.ravel(), 3 * OUTSIDE + INSIDE)
        self.margin = 3 * float(allowed.max() - allowed.min())
        # What a transition of a secret can have above those of the outside tokens that would replace it.
        self.edge = max(0.0, float(allowed[1:].max() - model.follow[OUTSIDE, [OUTSIDE, BEGIN]].min()))
        self.words = {f[2] for f in model.index if f[1] == "word"}
        # one row for all tokens that are alike: their own scores, then those they give their neighbours, by place
        self.table = np.zeros((1024, 3 * (1 + len(PLACES))))

    def _index(self, token: str) -> int:
        own, (word, kind) = own_key(token), near_key(token)
        key = (own, word if word in self.words else None, kind)
        i = self.rows.get(key)
        if i is None:
            i = self.rows[key] = len(self.rows)
            if i == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            sums = [self.model.sum(_features_of(own))]
            sums += [self.model.sum(near_features(token, place)) for place in PLACES]
            self.table[i] = np.concatenate(sums)
        return i

    def spans(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of each run of tokens tagged as one secret."""
        tokens = _TOKEN.findall(text)
        if not tokens:
            return []
        ids = np.fromiter(map(self.at.__getitem__, tokens), np.int64, len(tokens))
        known = self.table
        scores = known[ids, 0:3] + self.model.sum(file_features(text))
        for p, step in enumerate(PLACES.values(), 1):
            theirs = known[ids, 3 * p : 3 * p + 3]
            if abs(step) >= len(ids):
                continue
            if step < 0:
                scores[-step:] += theirs[:step]
            else:
                scores[:-step] += theirs[step:]
        # Putting a token outside, and the next one to the beginning of a secret if it was inside one, changes
        # three transitions and the next one's score; a token that gains more than that by itself is outside.
        next_loses = np.append(np.maximum(0, scores[1:, INSIDE] - scores[1:, BEGIN]), 0.0)
        gain = scores[:, OUTSIDE] - scores[:, 1:].max(axis=1)
        open_ = gain < self.margin + next_loses
        # A secret of n tokens has n + 1 transitions; if each token gains twice an edge by being outside, there is none.
        likely = np.flatnonzero(gain < 2 * self.edge)
        if not len(likely):
            return []
        edges = np.flatnonzero(np.diff(np.concatenate([[False], open_, [False]])))
        begins, ends = edges[::2], edges[1::2]
        runs = np.unique(np.searchsorted(begins, likely, side="right") - 1)
        tagged: list[tuple[int, int]] = []  # (token, tag)
        for a, b in zip(begins[runs].tolist(), ends[runs].tolist()):
            tagged += [(a + i, tag) for i, tag in enumerate(viterbi(scores[a:b], self.model.follow)) if tag != OUTSIDE]
        if not tagged:
            return []
        places = [m.span() for m in _TOKEN.finditer(text)]
        found: list[list[int]] = []
        before = -2
        for i, tag in tagged:
            if tag == INSIDE and before == i - 1:
                found[-1][1] = places[i][1]
            else:
                found.append(list(places[i]))
            before = i
        return [tuple(s) for s in found]


def all_spans(text: str, tagger: Tagger) -> list[tuple[int, int, str]]:
    """Base spans, and the tagger's that reach beyond them: (start, end, kind) by start, then kind as listed.

    A span of the tagger takes in the signs + / = - that touch it, which belong to many encodings.
    """
    base = [s[:3] for s in base_spans(text)]
    covered: list[list[int]] = []
    for start, end, _ in base:
        if covered and start <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], end)
        else:
            covered.append([start, end])
    starts = [start for start, _ in covered]
    more = []
    for start, end in tagger.spans(text):
        i = bisect_right(starts, start) - 1
        if i >= 0 and end <= covered[i][1]:
            continue
        while start and text[start - 1] in "+/-":
            start -= 1
        while end < len(text) and text[end] in "+/=-":
            end += 1
        more.append((start, end, "crf"))
    return sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))


_SMALL, _LARGE, _DIGITS = string.ascii_lowercase, string.ascii_uppercase, string.digits
#: What may stand before a made-up secret, beside what stood there.
LEADS = ([], [], ["password", "is"], ["token", ":"], ["key", "="], ["use", "the", "secret"], ["login", "with"], ["Bearer"])


def _mixed(rng: random.Random, alphabets: tuple[str, ...], size: int) -> str:
    """Signs of all alphabets, each at least once, in any order but with a letter or digit first."""
    signs = [rng.choice(a) for a in alphabets] + rng.choices("".join(alphabets), k=max(0, size - len(alphabets)))
    rng.shuffle(signs)
    first = next(i for i, c in enumerate(signs) if c.isalnum())
    signs[0], signs[first] = signs[first], signs[0]
    return "".join(signs)


def made_up_secret(rng: random.Random) -> str:
    """A secret of an alphabet that the patterns do not know: keys with and without a prefix, encoded bytes, passwords."""
    kind, size = rng.randrange(6), rng.randint(16, 44)
    if kind == 0:
        prefix = "".join(_mixed(rng, (_SMALL,), rng.randint(2, 6)) + rng.choice("_-.") for _ in range(rng.randint(1, 2)))
        return prefix + _mixed(rng, (_SMALL, _LARGE, _DIGITS), size)
    if kind == 1:
        return _mixed(rng, (_SMALL, _LARGE, _DIGITS), size)
    if kind == 2:
        return _mixed(rng, (_SMALL, _LARGE, _DIGITS, "+/"), size) + "=" * rng.randrange(3)
    if kind == 3:
        return _mixed(rng, (_SMALL, _LARGE, _DIGITS, "-_"), size)
    if kind == 4:
        return _mixed(rng, (_LARGE, _DIGITS), size) if rng.random() < 0.5 else _mixed(rng, (_SMALL, _DIGITS), size)
    word = _mixed(rng, (_SMALL,), rng.randint(3, 7)) if rng.random() < 0.5 else ""
    return word + _mixed(rng, (_SMALL, _LARGE, _DIGITS), rng.randint(8, 12))


def look_alike(rng: random.Random, words: list[str]) -> str:
    """A name, number or link made of ``words`` that is no secret."""
    some = [rng.choice(words) for _ in range(rng.randint(2, 4))]
    number = str(rng.randint(0, 10 ** rng.randint(1, 6)))
    kind = rng.randrange(11)
    if kind == 0:
        return some[0] + "".join(w.title() for w in some[1:]) + (number[:2] if rng.random() < 0.3 else "")
    if kind == 1:
        return "".join(w.title() for w in some) + (number[:2] if rng.random() < 0.5 else "")
    if kind == 2:
        return "_".join([*some, number])
    if kind == 3:
        return f"www.{some[0]}.com/{'-'.join(some)}/{number}"
    if kind == 4:
        return f"{'-'.join(some)}-{rng.randint(1990, 2030)}.{rng.choice(['html', 'pdf', 'png', 'csv', 'mp4'])}"
    if kind == 5:
        return "-".join("".join(rng.choices("0123456789abcdef", k=n)) for n in (8, 4, 4, 4, 12))
    if kind == 6:
        return "".join(rng.choices("0123456789abcdef", k=rng.randint(6, 10)))
    if kind == 7:
        return f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}T{rng.randint(0, 23):02}:{number[:2]}"
    if kind == 8:
        return f"v{rng.randint(0, 9)}.{rng.randint(0, 30)}.{number[:2]}-{rng.choice(['beta', 'rc', 'alpha'])}{rng.randint(0, 9)}"
    if kind == 9:
        return f"{_mixed(rng, (_LARGE,), rng.randint(1, 4))}{rng.choice(['', '-'])}{number}{rng.choice(['', 'X', '-B'])}"
    return "".join(w.upper() for w in some[:2]) + rng.choice(["", number])


def training_windows(text: str) -> list[tuple[list[str], list[int], list[int]]]:
    """Short runs of tokens around secrets and around other tokens with digits: (tokens, tags, file features).

    Copies follow in which something made up takes the middle's place: a secret anywhere, a
    look-alike where no secret was. What is made up depends on the text alone.
    """
    places = [m.span() for m in _TOKEN.finditer(text)]
    if not places:
        return []
    tags = [OUTSIDE] * len(places)
    secrets = sorted({(s[3], s[1]) for s in base_spans(text)})
    starts = np.array([a for a, _ in places])
    middles = []
    covered = -1
    for a, b in secrets:
        if a < covered:
            continue
        covered = b
        first = int(np.searchsorted(starts, a, side="right")) - 1
        last = int(np.searchsorted(starts, b, side="left"))
        middles.append(first)
        for i in range(max(0, first), last):
            tags[i] = BEGIN if i == first else INSIDE
    others = [i for i, (a, b) in enumerate(places) if tags[i] == OUTSIDE and any(c.isdigit() for c in text[a:b])]
    middles = middles[: WINDOWS_PER_TEXT // 2] + others[: WINDOWS_PER_TEXT // 2] + [len(places) // 2]
    file = [value for _, value in file_features(text)]
    windows = []
    rng = random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    for middle in middles[:WINDOWS_PER_TEXT]:
        a, b = max(0, middle - REACH), middle + REACH + 1
        tokens = [text[x:y] for x, y in places[a:b]]
        windows.append((tokens, tags[a:b], file))
        first, last = middle, middle + 1
        while last < len(tags) and tags[last] == INSIDE:
            last += 1
        before, after = slice(max(0, first - NARROW), first), slice(last, last + NARROW)
        left, right = ([text[x:y] for x, y in places[s]] for s in (before, after))
        words = [t.lower() for t in tokens if t.isalpha() and 1 < len(t) < 12] or ["item"]
        made = [(made_up_secret(rng), rng.choice(LEADS), [BEGIN, INSIDE])]
        if tags[middle] == OUTSIDE:
            made += [(look_alike(rng, words), [], [OUTSIDE, OUTSIDE]) for _ in range(2)]
        for new, lead, (begin, inside) in made:
            parts = _TOKEN.findall(new)
            new_tags = [begin] + [inside] * (len(parts) - 1)
            windows.append(
                (left + lead + parts + right, tags[before] + [OUTSIDE] * len(lead) + new_tags + tags[after], file)
            )
    return windows


def fit(docs: DataFrame, text_column: str = "text", with_secret: int = WITH_SECRET, without: int = WITHOUT) -> Model:
    """Trains on windows of at most ``with_secret`` + ``without`` texts, chosen by a hash of the text.

    Only the windows reach the driver, a few per text.
    """
    texts = docs.select(whole_text(text_column).alias("text")).withColumn("order", F.xxhash64(F.lit("sample"), "text"))
    text = F.col("text")
    assigns = (text.contains("=") | text.contains(":")) & text.rlike(f"(?i){ASSIGN}")
    likely = assigns | text.rlike(f"{ACCESS}|[0-9a-f]{{16}}")
    keys = materialise(texts.select("order", likely.alias("likely")), "keys")
    chosen = [
        row["order"]
        for flag, most in ((True, with_secret), (False, without))
        for row in keys.where(F.col("likely") == flag).select("order").distinct().orderBy("order").limit(most).collect()
    ]
    if not chosen:
        return train([])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(order, *w) for order, text in zip(batch["order"], batch["text"]) for w in training_windows(text)]
            yield pd.DataFrame(rows, columns=["order", "tokens", "tags", "file"])

    sampled = texts.where(F.col("order").isin(chosen)).mapInPandas(
        cut, "order long, tokens array<string>, tags array<int>, file array<int>"
    )
    rows = sampled.distinct().toPandas()
    rows["words"] = rows["tokens"].map("\x00".join)

    def windows() -> Iterator[tuple[list[list[tuple]], list[int]]]:
        for row in rows.sort_values(["order", "words"]).itertuples():
            file = [(name, int(value)) for name, value in zip(FILE_FEATURES, row.file)]
            for hide in HIDE:
                yield window_features(list(row.tokens), file, hide), [int(t) for t in row.tags]

    return train(windows())


def _written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", model: Model | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    ``spans`` lists kind:start:end by start, then kind, in code points with the end left out;
    the field's own finds have the kind crf. ``base_sha256`` is the digest of the same list of
    the patterns' finds alone. Null texts count as empty; repeated rows come out as often as
    they go in. Other columns are ignored; an empty table gives an empty result.
    """
    model = model or fit(docs, text_column)

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(model)
        for texts in batches:
            rows = []
            for text in texts:
                spans = all_spans(text, tagger)
                base = [s for s in spans if s[2] != "crf"]
                counts = [sum(s[2] == kind for s in base) for kind in KINDS[:3]]
                rows.append((*counts, hashlib.sha256(_written(base).encode()).hexdigest(), _written(spans)))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col(id_column).alias("doc_id"), scanned(whole_text(text_column)).alias("found")).select("doc_id", "found.*")


MASK = "[SECRET]"


def masked_column(text: Column, model: Model) -> Column:
    """The text with every span replaced by a mark; overlapping spans are one."""

    @F.pandas_udf("string")
    def masked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tagger = Tagger(model)
        for texts in batches:
            result = []
            for text in texts:
                parts, at = [], 0
                spans = all_spans(text, tagger)
                for i, (start, end, _) in enumerate(spans):
                    if start >= at or i == 0:
                        parts += [text[at:start], MASK]
                    at = max(at, end)
                result.append("".join([*parts, text[at:]]) if spans else text)
            yield pd.Series(result, dtype=object)

    return masked(text)


def mask_secrets(
    docs: DataFrame, text_column: str = "text", length_column: str = "n_chars", model: Model | None = None
) -> DataFrame:
    """All rows of ``docs`` with their secrets masked; the length is brought up to date where something was masked.

    Null and empty texts and their lengths stay as they are; repeated rows come out as often as
    they go in, an empty table gives an empty result, and other columns are kept.
    """
    model = model or fit(docs, text_column)
    own = docs.select(F.struct("*").alias("whole"), masked_column(whole_text(text_column), model).alias("masked"))
    old = {name: F.col("whole")[name] for name in docs.columns}
    changed = F.col("masked") != F.coalesce(old[text_column].cast("string"), F.lit(""))
    length = F.length("masked").cast(docs.schema[length_column].dataType)
    new = old | {
        text_column: F.when(changed, F.col("masked")).otherwise(old[text_column]),
        length_column: F.when(changed, length).otherwise(old[length_column]),
    }
    return own.select(*(value.alias(name) for name, value in new.items()))
