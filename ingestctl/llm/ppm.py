"""Language-model scores: prediction by partial matching over bytes, beside a word-count base.

Counting and scoring are two passes over the texts. The first pass counts words, and bytes
after the bytes before them (grams), in tasks; Spark adds the counts up. Every counted context
stays in the model: a byte seen in a context takes its share, the rest escapes to the next
shorter context, from which the bytes already seen are excluded (escapes are estimated by the
number of different bytes seen). A gram of the training texts has been seen in its longest
context, so its probability is its share there; grams that only other texts hold get theirs by
joins with the contexts of all lengths. The second pass counts the grams of each text and adds
up the logarithms: the most frequent grams are known to every task, the others are joined.

A caller may bound the model to the most frequent contexts instead. These form a trie (every
shorter end of a kept context is kept too), which is walked from each byte backwards.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ingestctl.llm.common import ascii_lower, crc_remainder, whole_text
from ingestctl.scratch import materialise

ORDER = 5
#: Words that make up more than 1 / HOT_WORDS of all tokens are known to every task; there are fewer than HOT_WORDS.
HOT_WORDS = 100_000
#: At most so many of the most frequent grams are known to every task; the others are joined.
HOT_GRAMS = 1_000_000
END, START = 256, 257
SYMBOLS, BASE = 257, 258
_BLOCK = 1 << 21
_KEPT = 500_000


def symbols(text: bytes, order: int) -> np.ndarray:
    """The bytes of a text with its end, after as many start marks as a context is long."""
    return np.concatenate([[START] * order, np.frombuffer(text, np.uint8), [END]]).astype(np.int64)


def _codes(marked: np.ndarray, order: int) -> np.ndarray:
    """A number for each byte together with the ``order`` bytes before it."""
    n = len(marked) - order
    codes = marked[:n].copy()
    for i in range(1, order + 1):
        codes *= BASE
        codes += marked[i : n + i]
    return codes


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, places = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(places, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)


def count_grams(texts: Iterator[bytes], order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, counts), in portions of bounded size."""
    waiting, size, held = [], 0, []
    for text in texts:
        marked = symbols(text, order)
        for at in range(0, len(marked) - order, _BLOCK):
            waiting.append(_codes(marked[at : at + _BLOCK + order], order))
            size += len(waiting[-1])
            if size >= _BLOCK:
                held.append(np.unique(np.concatenate(waiting), return_counts=True))
                waiting, size = [], 0
                if len(held) == 4:
                    held = [_merged(held)]
                    if len(held[0][0]) > 4 * _KEPT:
                        yield held.pop()
    if waiting:
        held.append(np.unique(np.concatenate(waiting), return_counts=True))
    if held:
        yield _merged(held)


@dataclass(frozen=True)
class Trie:
    """Contexts as rows. ``children``: the row of a context lengthened by one byte at its front, 0 if
    it is not kept. ``logs``: log10 of the probability of each next symbol."""

    order: int
    children: np.ndarray
    logs: np.ndarray
    column: np.ndarray

    def score(self, text: bytes) -> float:
        marked, total = symbols(text, self.order), 0.0
        columns = self.column[marked]
        for at in range(self.order, len(marked), _BLOCK):
            end = min(len(marked), at + _BLOCK)
            rows = np.zeros(end - at, dtype=np.int32)
            alive = np.ones(end - at, dtype=bool)
            for back in range(1, self.order + 1):
                longer = self.children[rows, columns[at - back : end - back]]
                alive &= longer > 0
                rows = np.where(alive, longer, rows)
            total += self.logs[rows, columns[at:end]].sum(dtype=np.float64)
        return float(total)


def build(contexts: list[tuple[int, int]], after: dict[int, tuple[np.ndarray, np.ndarray]], order: int) -> Trie:
    """The trie of the contexts given as (length, code), shorter ones first; the empty context is always there.

    ``after`` holds, by the place of a context in the list, the symbols seen after it and their counts.
    Symbols that never occur share one column.
    """
    used = sorted({int(s) for seen, _ in after.values() for s in seen.tolist()} | {c % BASE for n, c in contexts if n})
    lead = {c // BASE ** (n - 1) for n, c in contexts if n}
    used = sorted(set(used) | lead)
    column = np.full(BASE, len(used), dtype=np.int32)
    column[used] = np.arange(len(used))
    width = len(used) + 1
    rows = {key: i for i, key in enumerate(contexts)}
    children = np.zeros((len(contexts), width), dtype=np.int32 if len(contexts) > 65_535 else np.uint16)
    logs = np.zeros((len(contexts), width), dtype=np.float32)  # probabilities, until the end
    escapes = np.ones(len(contexts))
    empty = np.zeros(0, dtype=np.int64)
    seen_at: list[np.ndarray] = []
    counts_at: list[np.ndarray] = []
    for row, (length, code) in enumerate(contexts):
        seen, counts = after.get(row, (empty, empty))
        at = column[seen]
        seen_at.append(at)
        counts_at.append(counts)
        total, kinds = int(counts.sum()), len(seen)
        if length == 0:
            unseen = SYMBOLS - kinds
            escape = kinds / (total + kinds) if unseen and kinds else float(not kinds)
            odds = np.full(width, escape / unseen if unseen else 0.0)
            if kinds:
                odds[at] = counts / (total + (kinds if unseen else 0))
        else:
            shorter = rows[(length - 1, code % BASE ** (length - 1))]
            children[shorter, column[code // BASE ** (length - 1)]] = row
            escape = kinds / (total + kinds)
            theirs = np.zeros(width, dtype=np.int64)
            theirs[seen_at[shorter]] = counts_at[shorter]
            known = theirs > 0
            theirs[at] = 0  # excluded: they were possible before the escape
            rest, rest_kinds = int(theirs.sum()), int((theirs > 0).sum())
            further = logs[shorter].astype(np.float64) / escapes[shorter] if escapes[shorter] else np.zeros(width)
            if rest:
                odds = escape * np.where(known, theirs / (rest + rest_kinds), rest_kinds / (rest + rest_kinds) * further)
            else:
                odds = escape * np.where(known, 0.0, further)
            odds[at] = counts / (total + kinds)
        escapes[row] = escape
        logs[row] = odds
    with np.errstate(divide="ignore"):
        # the floor is met only by what cannot occur: a symbol of the context's own, such as the start mark
        return Trie(order, children, np.log10(np.maximum(logs, np.float32(1e-30))), column)


@dataclass(frozen=True)
class Hot:
    """Frequent grams in a table of slots, and the log10 of the probability of the last symbol of each.

    A gram's slot is the leading bits of its hash, or the next free one after it; at least two thirds of
    the slots are free, so most grams are found, or found to be missing, at once.
    """

    order: int
    grams: np.ndarray
    logs: np.ndarray

    @classmethod
    def of(cls, order: int, grams: np.ndarray, logs: np.ndarray) -> Hot:
        size = 1 << (3 * len(grams) + 1).bit_length()
        table, values = np.full(size, _FREE, dtype=np.int64), np.zeros(size)
        slots, left = _slots(grams, size), np.arange(len(grams))
        while len(left):
            free = table[slots] == _FREE
            table[slots[free]] = grams[left[free]]  # of several grams for a slot the last one stays
            placed = table[slots] == grams[left]
            values[slots[placed]] = logs[left[placed]]
            slots, left = (slots[~placed] + 1) % size, left[~placed]
        return cls(order, table, values)

    def score(self, text: bytes) -> tuple[float, list[np.ndarray], list[np.ndarray]]:
        """What the grams known here add up to, and the others with their counts."""
        marked, total, others, times = symbols(text, self.order), 0.0, [], []
        for at in range(0, len(marked) - self.order, _BLOCK):
            codes = _codes(marked[at : at + _BLOCK + self.order], self.order)
            slots = _slots(codes, len(self.grams))
            unknown = []
            while len(codes):
                there = self.grams[slots]
                hit = there == codes
                total += float(self.logs[slots] @ hit)
                free = there == _FREE
                unknown.append(codes[free])
                further = ~(hit | free)
                codes, slots = codes[further], (slots[further] + 1) % len(self.grams)
            rest, counts = np.unique(np.concatenate(unknown), return_counts=True)
            others.append(rest)
            times.append(counts)
        return total, others, times


_FREE = -1


def _slots(grams: np.ndarray, size: int) -> np.ndarray:
    """The leading bits of a gram times an odd number (2**64 by the golden ratio); ``size`` is a power of two."""
    hashed = grams.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    hashed >>= np.uint64(65 - size.bit_length())
    return hashed.view(np.int64)


def _count(docs: DataFrame, order: int) -> DataFrame:
    """Partial counts of the tasks: words (word, n) and byte grams (gram, n)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        portions: list[pa.RecordBatch] = []

        def portion(kinds, grams, counts) -> pa.RecordBatch:
            columns = [pa.array(kinds, pa.binary()), pa.array(grams, pa.int64()), pa.array(counts, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["word", "gram", "n"])

        def word_rows() -> pa.RecordBatch:
            return portion(list(words), [None] * len(words), list(words.values()))

        def texts() -> Iterator[bytes]:
            for batch in batches:
                for text in batch.column("text").to_pylist():
                    lowered = ascii_lower(text)
                    words.update(lowered.split())
                    if len(words) > _KEPT:
                        portions.append(word_rows())
                        words.clear()
                    yield lowered

        for codes, counts in count_grams(texts(), order):
            yield portion([None] * len(codes), codes, counts)
            yield from portions
            portions.clear()
        yield from portions
        if words:
            yield word_rows()

    return docs.mapInArrow(count, "word binary, gram long, n long")


def _contexts(grams: DataFrame, order: int, most: int) -> tuple[list[tuple[int, int]], dict]:
    """The most frequent contexts of all lengths, with what follows them.

    A shorter end of a context is at least as frequent and comes first among equals, so what is
    kept is closed under shortening; at most ``most`` + 1 contexts of at most 257 symbols each
    reach the driver.
    """
    lengths = F.explode(F.array([F.lit(k) for k in range(1, order + 1)])).alias("length")
    power = F.element_at(F.array([F.lit(BASE**k).cast("long") for k in range(order + 1)]), F.col("length") + 1)
    every = grams.select(
        (F.col("gram") % BASE).alias("symbol"), F.expr(f"gram div {BASE}").alias("whole"), "n", lengths
    ).select("length", (F.col("whole") % power).alias("context"), "symbol", "n")
    follow = materialise(every.groupBy("length", "context", "symbol").agg(F.sum("n").alias("n")), "follow")
    # A context that begins before the text's start is counted as the shorter one it ends in, too.
    kept = (
        follow.groupBy("length", "context")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "length", "context")
        .limit(most)
        .select("length", "context")
    )
    chosen = follow.join(F.broadcast(kept), ["length", "context"]).toPandas()
    root = grams.groupBy((F.col("gram") % BASE).alias("symbol")).agg(F.sum("n").alias("n")).toPandas()
    contexts, after = [(0, 0)], {}
    root = root.sort_values("symbol")
    after[0] = (root["symbol"].to_numpy(np.int64), root["n"].to_numpy(np.int64))
    for (length, context), rows in chosen.sort_values(["length", "context", "symbol"]).groupby(["length", "context"], sort=True):
        contexts.append((int(length), int(context)))
        after[len(contexts) - 1] = (rows["symbol"].to_numpy(np.int64), rows["n"].to_numpy(np.int64))
    return contexts, after


def _known(grams: DataFrame) -> DataFrame:
    """(gram, n, log) for the grams of the training texts: each has been seen in its longest context."""
    context = F.expr(f"gram div {BASE}").alias("context")
    totals = grams.groupBy(context).agg((F.sum("n") + F.count("*")).alias("size"))
    return materialise(
        grams.select("gram", "n", context)
        .join(totals, "context")
        .select("gram", "n", F.log10(F.col("n") / F.col("size")).alias("log")),
        "known",
    )


def _frequent(known: DataFrame, most: int) -> DataFrame:
    """At most ``most`` of the grams in ``known``: those above a count."""
    step = F.floor(F.log2("n") * 4).cast("int")
    least, size = None, 0
    for row in sorted(known.groupBy(step.alias("step")).count().collect(), reverse=True):
        size += row["count"]
        if size > most:
            break
        least = row["step"]
    return known.where(step >= least if least is not None else F.lit(False)).select("gram", "log")


def _unseen(wanted: DataFrame, grams: DataFrame, order: int) -> DataFrame:
    """(gram, log) for grams that no training text holds, by escapes from their longest counted context."""
    powers = F.array([F.lit(BASE**k).cast("long") for k in range(order + 2)])
    power = lambda k: F.element_at(powers, k + 1)
    shorter = grams.select("gram", "n", F.explode(F.array([F.lit(k) for k in range(order)])).alias("length"))
    shorter = (
        shorter.select("length", (F.col("gram") % power(F.col("length") + 1)).alias("gram"), "n")
        .groupBy("length", "gram")
        .agg(F.sum("n").alias("n"))
    )
    follow = materialise(shorter.unionByName(grams.select(F.lit(order).alias("length"), "gram", "n")), "follow")
    # What has been seen in a context has been seen in its shorter end: that is what an escape excludes there.
    below = follow.select((F.col("length") + 1).alias("length"), F.col("gram").alias("end"), F.col("n").alias("n_below"))
    contexts = materialise(
        follow.withColumn("end", F.col("gram") % power(F.col("length")))
        .join(below, ["length", "end"], "left")
        .groupBy("length", F.expr(f"gram div {BASE}").alias("context"))
        .agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum("n_below").alias("excluded")),
        "contexts",
    )
    ends = contexts.select(
        (F.col("length") + 1).alias("length"),
        F.col("context").alias("end"),
        F.col("total").alias("total_below"),
        F.col("kinds").alias("kinds_below"),
    )
    rest, rest_kinds = F.col("total_below") - F.col("excluded"), F.col("kinds_below") - F.col("kinds")
    size = F.col("total") + F.col("kinds")
    model = materialise(
        contexts.where("length > 0")
        .withColumn("end", F.col("context") % power(F.col("length") - 1))
        .join(ends, ["length", "end"])
        .select(
            "length",
            "context",
            F.log10(size).alias("size"),
            F.log10(F.col("kinds") / size).alias("escape"),
            F.when(rest > 0, F.log10(rest + rest_kinds)).alias("rest"),
            F.when(rest > 0, F.log10(rest_kinds / (rest + rest_kinds))).otherwise(0.0).alias("further"),
        ),
        "model",
    )
    root = contexts.where("length = 0").select("total", "kinds").first()
    total, kinds = (root["total"], root["kinds"]) if root else (0, 0)
    root_size = math.log10(total + kinds) if kinds else 0.0
    root_escape = math.log10(kinds / (total + kinds)) if kinds else 0.0
    unseen = -math.log10(SYMBOLS - kinds) if kinds < SYMBOLS else 0.0
    # One row per gram and length: its context of that length, and its symbol after the context that is one shorter.
    places = wanted.select("gram", F.explode(F.array([F.lit(k) for k in range(1, order + 1)])).alias("length")).select(
        "gram",
        "length",
        (F.expr(f"gram div {BASE}") % power(F.col("length"))).alias("context"),
        (F.col("gram") % power(F.col("length"))).alias("end"),
    )
    found = (
        places.join(model, ["length", "context"], "left")
        .join(below.withColumnRenamed("n_below", "n"), ["length", "end"], "left")
        .groupBy("gram")
        .agg(
            F.max(F.when(F.col("escape").isNotNull(), F.struct("length", "size", "escape"))).alias("top"),
            F.max(F.when(F.col("n").isNotNull(), F.struct("length", "n", "rest"))).alias("at"),
            F.collect_list(F.struct("length", F.coalesce("further", F.lit(0.0)).alias("further"))).alias("steps"),
        )
        .withColumn("longest", F.coalesce("top.length", F.lit(0)))
        .withColumn("seen", F.coalesce(F.col("at.length") - 1, F.lit(-1)))
    )
    steps = F.aggregate(
        F.filter("steps", lambda s: (s["length"] > F.col("seen") + 1) & (s["length"] <= F.col("longest"))),
        F.lit(0.0),
        lambda sum_, s: sum_ + s["further"],
    )
    log = F.log10("at.n")
    escape = F.coalesce("top.escape", F.lit(root_escape))
    return found.select(
        "gram",
        F.when(F.col("seen") == -1, escape + steps + F.lit(unseen))
        .when(F.col("seen") == F.col("longest"), log - F.coalesce("top.size", F.lit(root_size)))
        .otherwise(escape + steps + log - F.col("at.rest"))
        .alias("log"),
    )


def held_out(id_column: str = "doc_id") -> Column:
    """Ids that nothing is learned from."""
    return crc_remainder(id_column, 7) == 2


def score_documents(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    order: int = ORDER,
    contexts: int | None = None,
    hot_words: int = HOT_WORDS,
    hot_grams: int = HOT_GRAMS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``score`` is the model's log10 probability of the lower-cased (A-Z) text, as bytes, and its
    end; the model holds every context of the training texts up to ``order`` bytes, or the
    ``contexts`` most frequent ones if that is given. ``base_score`` adds up smoothed word frequencies, the end of a text being a token. All
    counts come from the rows that are not held out. Null texts count as empty; repeated rows
    count and come out as often as they go in. Without training rows every byte is equally
    likely. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    source = docs.select(
        F.col(id_column).alias("doc_id"), held_out(id_column).alias("held_out"), whole_text(text_column).alias("text")
    )
    training = source.where("not held_out").select("text")
    partial = materialise(_count(training, order), "partial")
    counts = materialise(
        partial.where("word is not null").groupBy("word").agg(F.sum("n").alias("c")), "words"
    )
    grams = materialise(partial.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = grams.where(f"gram % {BASE} = {END}").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tokens = totals["n"] + ends
    kinds = totals["v"] + (1 if ends else 0)
    denominator = tokens + kinds + 1
    hot = counts.where(F.col("c") > max(1, tokens / hot_words)).toPandas() if tokens else pd.DataFrame({"word": [], "c": []})
    hot_logs = {bytes(w): math.log10((c + 1) / denominator) for w, c in zip(hot["word"], hot["c"])}
    end_log = math.log10((ends + 1) / denominator)
    if contexts is None:
        known_grams = _known(grams)
        frequent = _frequent(known_grams, hot_grams).toArrow()
        codes, logs_of = frequent.column("gram").to_numpy(), frequent.column("log").to_numpy()
        parts = tuple(vars(Hot.of(order, codes, logs_of)).values())
    else:
        trie = build(*_contexts(grams, order, contexts), order)
        parts = (trie.order, trie.children, trie.logs, trie.column)
    model = spark.sparkContext.broadcast((hot_logs, parts))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, parts = model.value
        hot = Hot(*parts) if contexts is None else None
        trie = None if hot else Trie(*parts)
        no_grams = np.zeros(0, dtype=np.int64)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            sums, words, times, ends_at = [], [], [], [0]
            others, other_times, others_at = [no_grams], [no_grams], [0]
            for text in batch.column("text").to_pylist():
                lowered = ascii_lower(text)
                own = Counter(lowered.split())
                base, n_hot = end_log, int(ends > 0)
                for word, n in own.items():
                    log = known.get(word)
                    if log is None:
                        words.append(word)
                        times.append(n)
                    else:
                        base += n * log
                        n_hot += n
                ends_at.append(len(words))
                if hot:
                    score, codes, code_times = hot.score(lowered)
                    others += codes
                    other_times += code_times
                    others_at.append(others_at[-1] + sum(map(len, codes)))
                else:
                    score = trie.score(lowered)
                    others_at.append(0)
                sums.append((sum(own.values()) + 1, n_hot, base, score))
            pairs = pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(times, pa.int64())], ["word", "n"])
            grams_of = pa.StructArray.from_arrays(
                [pa.array(np.concatenate(others)), pa.array(np.concatenate(other_times), pa.int32())], ["gram", "n"]
            )
            totals = list(zip(*sums)) or [[], [], [], []]
            columns = {
                "row": pa.array(np.arange(row, row + len(sums), dtype=np.int64)),
                "doc_id": batch.column("doc_id"),
                "held_out": batch.column("held_out"),
                "n_tokens": pa.array(totals[0], pa.int64()),
                "hot_known": pa.array(totals[1], pa.int64()),
                "hot_score": pa.array(totals[2], pa.float64()),
                "hot_grams": pa.array(totals[3], pa.float64()),
                "rare": pa.ListArray.from_arrays(pa.array(ends_at, pa.int32()), pairs),
                "others": pa.ListArray.from_arrays(pa.array(others_at, pa.int32()), grams_of),
            }
            row += len(sums)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    scored = materialise(
        source.mapInArrow(
            score,
            f"row long, doc_id {id_type}, held_out boolean, n_tokens long, hot_known long, hot_score double, "
            "hot_grams double, rare array<struct<word: binary, n: long>>, others array<struct<gram: long, n: int>>",
        ),
        "scored",
    )
    rare = scored.select("row", F.explode("rare").alias("w")).select("row", "w.word", "w.n")
    parts_of = (
        rare.join(counts, "word", "left")
        .withColumn("c", F.coalesce("c", F.lit(0)))
        .select(
            "row",
            (F.col("n") * F.log10((F.col("c") + 1) / F.lit(float(denominator)))).alias("word_log"),
            F.when(F.col("c") > 0, F.col("n")).otherwise(0).alias("known"),
            F.lit(0.0).alias("gram_log"),
        )
    )
    if contexts is None:
        others = scored.select("row", "held_out", F.explode("others").alias("g")).select("row", "held_out", "g.gram", "g.n")
        logs = known_grams.select("gram", "log")
        new = materialise(others.where("held_out").select("gram").distinct().join(logs, "gram", "leftanti"), "new")
        logs = logs.unionByName(materialise(_unseen(new, grams, order), "unseen"))
        # each gram once, so the hash spreads them evenly: a table for each task, instead of sorting all texts' grams
        parts_of = parts_of.unionByName(
            others.join(logs.hint("shuffle_hash"), "gram").select(
                "row",
                F.lit(0.0).alias("word_log"),
                F.lit(0).cast("long").alias("known"),
                (F.col("n") * F.col("log")).alias("gram_log"),
            )
        )
    sums = parts_of.groupBy("row").agg(
        F.sum("word_log").alias("rare_score"), F.sum("known").alias("rare_known"), F.sum("gram_log").alias("rare_grams")
    )
    return scored.drop("rare", "others").join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("hot_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("hot_score") + F.coalesce("rare_score", F.lit(0.0))).alias("base_score"),
        (F.col("hot_grams") + F.coalesce("rare_grams", F.lit(0.0))).alias("score"),
    )
