"""Spelling variants: a trie over counts of letter groups, searched with one surplus and one deficit.

Letters fall into a few groups, and a word's counts of them, group after group, are its path in
a trie. One inserted letter raises one count by one, a deleted one lowers one, a replaced one
does both or neither. So a depth-first search that may spend one surplus and one deficit on its
way down reaches every word one edit away; the words of the leaves it ends in are verified.

Of two near words whose counts differ, one has the larger count in the first group that tells
them apart. A search that spends its surplus before its deficit is only the other word's, so it
finds such a pair once, for both words; words with the same counts find each other.

Nodes with many words are inner nodes; below them lie subtries of a bounded size, each built in
the task it belongs to. A word goes once to the subtrie it lies in, and as a question to all
that its search reaches from the inner nodes. Only the inner nodes are known everywhere: there
are at most ``LEVELS / subtrie_words`` of them for each word.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import ne

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ingestctl.llm.common import whole_text
from ingestctl.scratch import materialise

#: Production contract: every 97th word of a document, by its checksum, loses a letter.
DROP_EVERY = 97
MIN_LENGTH, MIN_COUNT, RATIO = 5, 3, 2
#: Letter groups, by code point modulo their number; one more level counts all other characters.
GROUPS = 13
LEVELS = GROUPS + 1
#: Words of one subtrie: some 20 MB in a Python worker.
SUBTRIE_WORDS = 10_000
#: Words that a task counts before it hands the counts on.
COUNTED_WORDS = 200_000
WORDS_PER_TASK = 10_000
#: Leaves with more words are looked up by the half of a word that one edit leaves as it is.
LEAF_WORDS = 4

_LETTERS = [c for c in (*range(97, 123), *range(0xC0, 0x100))]
#: Latin-1 bytes with letters in lower case (A-Z only) and a space for everything else.
_TO_RUNS = bytes(b + 32 if 65 <= b <= 90 else b if b in _LETTERS else 32 for b in range(256))


def letter_runs(text: str) -> Counter[bytes]:
    """Counts of the runs of a-z and U+00C0 to U+00FF, A-Z in lower case, as Latin-1 bytes."""
    return Counter(text.encode("latin-1", "replace").translate(_TO_RUNS).split())


def word_counts(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    drop_every: int | None = DROP_EVERY,
) -> DataFrame:
    """(word, n): the words of all texts with at least ``min_length`` letters and ``min_count`` occurrences.

    With ``drop_every``, a word loses a letter in the documents where that number divides
    crc32(id:word). Null texts have no words; a row without an id has the empty id; every repeated row counts.
    """
    source = docs.select(
        F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("doc_id"), whole_text(text_column).alias("text")
    )

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[bytes] = Counter()

        def told() -> pd.DataFrame:
            long_enough = [(word.decode("latin-1"), n) for word, n in counts.items() if len(word) >= min_length]
            return pd.DataFrame(long_enough, columns=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                runs = letter_runs(text)
                if drop_every:
                    start = zlib.crc32(f"{doc_id}:".encode("utf-8", "surrogatepass"))
                    for run, n in list(runs.items()):
                        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
                        if h % drop_every == 0:
                            del runs[run]  # before the counting of the shorter word, which may be another run
                            at = h % len(run)
                            counts[run[:at] + run[at + 1 :]] += n
                counts.update(runs)
                if len(counts) > COUNTED_WORDS:
                    yield told()
                    counts.clear()
        yield told()

    counted = source.mapInPandas(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def group_counts(word: Column) -> Column:
    """The counts of the letter groups and of all other characters; they add up to the word's length."""
    counts = []
    for group in range(GROUPS):
        letters = "".join(chr(c) for c in _LETTERS if c % GROUPS == group)
        counts.append(F.length(word) - F.length(F.translate(word, letters, "")))
    every = "".join(map(chr, _LETTERS))
    return F.array(*counts, F.length(F.translate(word, every, "")))


def one_edit(a: str, b: str) -> bool:
    """Whether the words differ by exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(map(ne, a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) != 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at:] == b[at + 1 :]


@dataclass
class Leaf:
    """The words with the same counts, which are all of one length."""

    counts: tuple[int, ...]
    words: list[tuple[str, int]] = field(default_factory=list)
    halves: dict = field(default_factory=dict)

    def near(self, word: str) -> list[tuple[str, int]]:
        words = self.words
        if len(words) > LEAF_WORDS:
            # one edit leaves the word's first half or the rest of it as it is
            half = len(word) // 2
            first, rest = self.halves.get(len(word)) or self._index(len(word))
            begin, end = word[:half], word[half:]
            words = first.get(begin, [])
            if end in rest:
                words = words + [entry for entry in rest[end] if not entry[0].startswith(begin)]
        return [entry for entry in words if one_edit(word, entry[0])]

    def _index(self, length: int) -> tuple[dict, dict]:
        first, rest = self.halves[length] = defaultdict(list), defaultdict(list)
        half = length // 2
        for entry in self.words:
            first[entry[0][:half]].append(entry)
            rest[entry[0][half - length :]].append(entry)
        return first, rest


class Trie:
    """Nodes are dictionaries from a count to a child; a node with a single path below it is its leaf."""

    def __init__(self, level: int = 0):
        self.level, self.root = level, {}

    def add(self, counts: tuple[int, ...], word: str, n: int) -> None:
        node, level = self.root, self.level
        if level == len(counts):  # a part of one leaf
            node.setdefault(None, Leaf(counts)).words.append((word, n))
            return
        while True:
            child = node.get(counts[level])
            if child is None:
                child = node[counts[level]] = Leaf(counts)
            if isinstance(child, Leaf):
                if child.counts == counts:
                    child.words.append((word, n))
                    return
                inner = node[counts[level]] = {child.counts[level + 1]: child}
                child = inner
            node, level = child, level + 1

    def reached(self, counts: tuple[int, ...], surplus: int, deficit: int, ordered: bool = False) -> list[Leaf]:
        """The leaves within one surplus and one deficit, of which those given have been spent above this trie.

        With ``ordered``, the deficit is spent after the surplus only.
        """
        leaves = []
        if self.level == len(counts):
            return list(self.root.values())
        stack = [(self.root, self.level, surplus, deficit)]
        while stack:
            node, level, surplus, deficit = stack.pop()
            if isinstance(node, Leaf):
                if level == len(counts) or _within(node.counts, counts, level, surplus, deficit, ordered):
                    leaves.append(node)
                continue
            count, level = counts[level], level + 1
            if (child := node.get(count)) is not None:
                stack.append((child, level, surplus, deficit))
            if not surplus and (child := node.get(count + 1)) is not None:
                stack.append((child, level, 1, deficit))
            if not deficit and (surplus or not ordered) and (child := node.get(count - 1)) is not None:
                stack.append((child, level, surplus, 1))
        return leaves


def _within(
    theirs: tuple[int, ...], own: tuple[int, ...], level: int, surplus: int, deficit: int, ordered: bool = False
) -> bool:
    for a, b in zip(theirs[level:], own[level:]):
        if a > b:
            surplus += a - b
        elif a < b:
            if ordered and not surplus:
                return False
            deficit += b - a
    return surplus <= 1 and deficit <= 1


def _parse(path: str) -> tuple[int, ...]:
    return tuple(map(int, path.split(",")))


def _subtries(path: str, inner: dict[str, int], subtrie_words: int) -> list[tuple[str, int, int]]:
    """(root, surplus, deficit spent) of every subtrie that a word's search reaches, the surplus spent first.

    Parts of a large leaf have numbers.
    """
    counts = path.split(",")
    found = []
    stack = [("", 0, 0, 0)]
    while stack:
        node, level, surplus, deficit = stack.pop()
        if node not in inner:
            found.append((node, surplus, deficit))
        elif level == len(counts):
            found.extend((f"{node}#{part}", surplus, deficit) for part in range(-(-inner[node] // subtrie_words)))
        else:
            count, before = int(counts[level]), f"{node}," if level else ""
            stack.append((f"{before}{count}", level + 1, surplus, deficit))
            if not surplus:
                stack.append((f"{before}{count + 1}", level + 1, 1, deficit))
            if surplus and not deficit and count:
                stack.append((f"{before}{count - 1}", level + 1, surplus, 1))
    return found


def _home(path: str, word: str, inner: dict[str, int], subtrie_words: int) -> str:
    """The root of the subtrie that a word lies in."""
    node, counts = "", path.split(",")
    for level, count in enumerate(counts):
        if node not in inner:
            return node
        node = f"{node},{count}" if level else count
    if node not in inner:
        return node
    return f"{node}#{zlib.crc32(word.encode('utf-8', 'surrogatepass')) % -(-inner[node] // subtrie_words)}"


_ROUTED = "root string, asks boolean, path string, surplus int, deficit int, word string, n long"
_FOUND = "word string, n_near long, form_n long, form string"


def near_words(words: DataFrame, subtrie_words: int = SUBTRIE_WORDS, words_per_task: int = WORDS_PER_TASK) -> DataFrame:
    """(word, n_near, form_n, form) of every word with near words; form is the near word with the largest n.

    ``words`` is a written table of (word, n) with each word once.
    """
    paths = words.select("word", "n", F.concat_ws(",", group_counts(F.col("word"))).alias("path"))
    path = F.split("path", ",")
    nodes = F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda depth: F.concat_ws(",", F.slice(path, 1, depth)))
    large = paths.select(F.explode(nodes).alias("node")).groupBy("node").count().where(F.col("count") > subtrie_words)
    inner = {row["node"]: row["count"] for row in large.collect()}
    known = words.sparkSession.sparkContext.broadcast(inner)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for word, n, path in zip(*(batch.column(name).to_pylist() for name in ("word", "n", "path"))):
                rows.append((_home(path, word, known.value, subtrie_words), False, path, 0, 0, word, n))
                for root, surplus, deficit in _subtries(path, known.value, subtrie_words):
                    rows.append((root, True, path, surplus, deficit, word, n))
            yield _batch(rows, ROUTED)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, trie, last, counts, leaves = None, None, None, (), []
        answers: dict[str, list] = {}  # of the subtrie's own words: n_near, form_n, form
        for batch in batches:
            rows = []
            for at, asks, path, surplus, deficit, word, n in zip(*(column.to_pylist() for column in batch.columns)):
                if at != root:
                    rows += [(own, *answer) for own, answer in answers.items()]
                    level = 0 if at == "" else at.split("#")[0].count(",") + 1
                    root, trie, last, answers = at, Trie(level), None, {}
                if not asks:
                    trie.add(_parse(path), word, n)
                    continue
                if last != (path, surplus, deficit):
                    last, counts = (path, surplus, deficit), _parse(path)
                    leaves = trie.reached(counts, surplus, deficit, ordered=True)
                near = []
                for leaf in leaves:
                    found = leaf.near(word)
                    near += found
                    if leaf.counts == counts:  # those ask themselves
                        continue
                    for own, _ in found:
                        answer = answers.get(own)
                        if answer is None:
                            answers[own] = [1, n, word]
                            continue
                        answer[0] += 1
                        if (-n, word) < (-answer[1], answer[2]):
                            answer[1:] = n, word
                if near:
                    form, form_n = min(near, key=lambda entry: (-entry[1], entry[0]))
                    rows.append((word, len(near), form_n, form))
            if rows:
                yield _batch(rows, FOUND)
        if answers:
            yield _batch([(own, *answer) for own, answer in answers.items()], FOUND)

    ROUTED, FOUND = _arrow(_ROUTED), _arrow(_FOUND)
    tasks = max(1, -(-words.count() // words_per_task))
    routed = paths.repartition(tasks).mapInArrow(route, _ROUTED)
    # a subtrie's own words come first, then the questions, those with the same counts together
    dealt = routed.repartition(tasks, "root").sortWithinPartitions("root", "asks", "path", "surplus", "deficit")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    found = dealt.mapInArrow(search, _FOUND).groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return found.select("word", "n_near", (-F.col("best.less")).alias("form_n"), "best.form")


def _arrow(ddl: str) -> pa.Schema:
    types = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64()}
    return pa.schema([(name, types[kind]) for name, kind in (column.split() for column in ddl.split(", "))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def follow_forms(forms: DataFrame) -> DataFrame:
    """(word, root): the last word that following ``form`` from a word leads to.

    A form is at least ``RATIO`` times as frequent as its word, so there is no way back; each round
    doubles the steps taken.
    """
    steps = materialise(forms.select("word", F.col("form").alias("root")), "steps")
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        steps = materialise(
            steps.join(further, "root", "left").select(
                "word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")
            ),
            "steps",
        )
        if steps.where("moved").isEmpty():
            return steps.select("word", "root")


def spelling_variants(words: DataFrame, ratio: int = RATIO, **options) -> DataFrame:
    """One row per word of (word, n): word, n, form, root, n_near, form_n.

    Words are near if they differ by exactly one inserted, deleted or replaced code point. A
    word's form is its near word with the largest n, of equal ones the smallest, if that n is at least
    ``ratio`` (2 or more) times its own; root is where following the forms ends. Rows with a null or
    repeated word count as one with the sum of their n, null words not at all; other columns are ignored.
    """
    words = materialise(
        words.where(F.col("word").isNotNull()).groupBy("word").agg(F.sum(F.coalesce("n", F.lit(0))).cast("long").alias("n")), "words"
    )
    near = materialise(near_words(words, **options), "near")
    is_form = F.col("form_n") >= ratio * F.col("n")
    told = materialise(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.when(is_form, F.col("form")).alias("form"),
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, F.col("form_n")).alias("form_n"),
        ),
        "forms",
    )
    roots = follow_forms(told.where(F.col("form").isNotNull()))
    return told.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
