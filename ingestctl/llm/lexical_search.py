"""Ranked lexical search: posting lists with range-maximum tables, searched best interval first.

The index is a table of blocks of documents. A block holds, for each term, the positions of the
documents that have it, in ascending order of their ids, and how often they do. A task turns one
block's lists into impacts, and into a sparse table that gives the position of the largest
impact in any range of a list.

An interval of documents is bounded by the sum of its terms' largest impacts. The interval with
the best bound is split at the document of its largest impact, which is scored; its two sides go
back to the queue with bounds of their own. An interval whose bound is below the worst of the
best documents so far cannot hold a result. Short intervals are scored whole, so a block never
costs much more than scoring it. Each block gives its best documents, and the best of these count.
"""

from __future__ import annotations

import heapq
import math
import string
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ingestctl.llm.common import whole_text
from ingestctl.scratch import materialise

BEST = 10
#: Documents and postings that a block may reach: its tables are some 100 MB in a Python worker.
BLOCK_DOCUMENTS, BLOCK_POSTINGS = 16_384, 1_000_000
#: Items searched at a time, and the largest vocabulary that lists are limited to; beyond it all terms are indexed.
ITEMS_AT_A_TIME, VOCABULARY = 1_000, 300_000
#: Intervals of so few documents are scored whole; so many intervals are split at a time.
LEAF, WAVE = 64, 64

# Fixed values of the contract: weights in thousandths, saturation 0.8, length share 0.9.
_SEPARATORS = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_TO_TERMS = bytes(
    ord(string.ascii_lowercase[b - 65]) if 65 <= b <= 90 else 32 if b in _SEPARATORS else b for b in range(256)
)


def terms(text: str) -> list[bytes]:
    """Runs of digits, letters and all characters beyond ASCII, as UTF-8, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_TO_TERMS).split()


def weight(n_documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_documents + 2) / (2 * df + 1)))


def _id_type(frame: DataFrame) -> str:
    return frame.schema["doc_id"].dataType.simpleString()


def build_index(
    docs: DataFrame, vocabulary: list[bytes] | None = None, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The written index of all documents: rows (block, term, n_documents, n_terms, positions, tfs, ids, lengths).

    A block's row without a term holds its documents, their ids ascending (null last) and their numbers of
    terms; there n_documents counts those with terms. With ``vocabulary`` the lists of other terms are left
    out; lengths count every term.
    """
    source = docs.select(F.col(id_column).alias("doc_id"), whole_text(text_column).alias("text"))
    wanted = None
    if vocabulary is not None:
        wanted = docs.sparkSession.sparkContext.broadcast({term: i for i, term in enumerate(vocabulary)})
    schema = (
        "block long, term binary, n_documents long, n_terms long, positions binary, tfs binary, "
        f"ids array<{_id_type(source)}>, lengths binary"
    )
    names = [column.split()[0] for column in schema.split(", ")]

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        known = {} if wanted is None else wanted.value
        held: list[tuple] = []  # (id, length, term numbers, tfs)
        n_postings = 0

        def block() -> pd.DataFrame:
            held.sort(key=lambda d: (d[0] is None, d[0]) if d[0] is not None else (True,))
            lengths = np.array([d[1] for d in held], dtype=np.int64)
            rows = [(number, None, int((lengths > 0).sum()), int(lengths.sum()), None, None, [d[0] for d in held], lengths.tobytes())]
            sizes = [len(d[2]) for d in held]
            which = np.concatenate([np.array(d[2], dtype=np.int64) for d in held])
            tfs = np.concatenate([np.array(d[3], dtype=np.uint32) for d in held])
            positions = np.repeat(np.arange(len(held), dtype=np.uint16), sizes)
            order = np.argsort(which, kind="stable")
            which, tfs, positions = which[order], tfs[order], positions[order]
            names_of = list(known)
            starts = np.flatnonzero(np.r_[True, which[1:] != which[:-1]]) if len(which) else np.array([], dtype=np.int64)
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(which)]):
                term = names_of[which[a]]
                rows.append((number, term, b - a, int(tfs[a:b].sum()), positions[a:b].tobytes(), tfs[a:b].tobytes(), None, None))
            return pd.DataFrame(rows, columns=names)

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].astype(object), batch["text"]):
                words = terms(text)
                counts = Counter(words)
                if wanted is None:
                    found = [(known.setdefault(t, len(known)), tf) for t, tf in counts.items()]
                else:
                    found = [(known[t], tf) for t, tf in counts.items() if t in known]
                held.append((None if pd.isna(doc_id) else doc_id, len(words), [i for i, _ in found], [tf for _, tf in found]))
                n_postings += len(found)
                if len(held) >= BLOCK_DOCUMENTS or n_postings >= BLOCK_POSTINGS:
                    yield block()
                    number, n_postings = number + 1, 0
                    held.clear()
                    if wanted is None:
                        known.clear()
        if held:
            yield block()

    return materialise(source.mapInPandas(build, schema), "index")


@dataclass
class Lists:
    """A block's posting lists, one after the other, with their impacts and the table of range maxima."""

    terms: dict[bytes, int]
    starts: np.ndarray  # where each list begins, and the end of the last
    keys: np.ndarray  # list number * documents + position, ascending
    positions: np.ndarray
    impacts: np.ndarray
    table: list[np.ndarray]  # table[k][i]: where the largest impact of i to i + 2**k - 1 is
    n_documents: int

    @classmethod
    def of(cls, postings: list[tuple[bytes, bytes, bytes]], lengths: np.ndarray, weights: dict[bytes, int], total: int, n_terms: int):
        """``postings``: (term, positions, tfs); ``total`` documents with terms and ``n_terms`` in all of the table."""
        size = len(lengths)
        m = 10 + (90 * lengths * total) // max(n_terms, 1)
        positions = [np.frombuffer(p, dtype=np.uint16).astype(np.int64) for _, p, _ in postings]
        starts = np.cumsum([0, *map(len, positions)])
        impacts = []
        for (term, _, tfs), at in zip(postings, positions):
            tf = np.frombuffer(tfs, dtype=np.uint32).astype(np.int64)
            impacts.append(weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[at])))
        keys = np.concatenate([at + i * size for i, at in enumerate(positions)])
        impact = np.concatenate(impacts)
        table = [np.arange(len(impact), dtype=np.int32)]
        for k in range(int(max(map(len, positions))).bit_length() - 1):
            before, step = table[-1], 1 << k
            a, b = before[:-step], before[step:]
            table.append(np.where(impact[b] > impact[a], b, a))
        return cls({t: i for i, (t, _, _) in enumerate(postings)}, starts, keys, np.concatenate(positions), impact, table, size)

    def maxima(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(largest impact, its place) of each range of a list; 0 where it is empty."""
        size = hi - lo
        level = np.frexp(np.maximum(size, 1))[1] - 1
        where = np.zeros(lo.shape, dtype=np.int64)
        for k in np.unique(level[size > 0]).tolist():
            at = (level == k) & (size > 0)
            a, b = self.table[k][lo[at]], self.table[k][hi[at] - (1 << k)]
            where[at] = np.where(self.impacts[b] > self.impacts[a], b, a)
        return np.where(size > 0, self.impacts[where], 0), where


def best_documents(lists: Lists, item: list[bytes], best: int = BEST, leaf: int = LEAF, wave: int = WAVE) -> list[tuple[int, int]]:
    """(score, position) of the ``best`` documents with a score above 0, highest first, equal ones by position."""
    own = np.array([lists.terms[t] for t in item if t in lists.terms], dtype=np.int64)
    if not len(own):
        return []
    found: list[tuple[int, int]] = []  # a heap of (score, -position): its first is the worst
    queue: list[tuple[int, int, int, np.ndarray, np.ndarray]] = []  # (-bound, begin, end, from, to of each list)

    def keep(scores: np.ndarray, positions: np.ndarray) -> None:
        worst = found[0][0] if len(found) == best else 1
        for at in np.flatnonzero(scores >= worst).tolist():
            entry = (int(scores[at]), -int(positions[at]))
            if len(found) < best:
                heapq.heappush(found, entry)
            elif entry > found[0]:
                heapq.heapreplace(found, entry)

    def push(begin: np.ndarray, end: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        bounds = lists.maxima(lo, hi)[0].sum(axis=1)
        worst = found[0][0] if len(found) == best else 1
        for i in np.flatnonzero(bounds >= worst).tolist():
            heapq.heappush(queue, (-int(bounds[i]), int(begin[i]), int(end[i]), lo[i], hi[i]))

    push(np.array([0]), np.array([lists.n_documents]), lists.starts[own][None], lists.starts[own + 1][None])
    while queue:
        worst = found[0][0] if len(found) == best else 1
        taken = []
        while queue and len(taken) < wave and -queue[0][0] >= worst:
            taken.append(heapq.heappop(queue))
        if not taken:
            break
        short = [t for t in taken if t[2] - t[1] <= leaf]
        if short:
            lo, hi = np.concatenate([t[3] for t in short]), np.concatenate([t[4] for t in short])
            sizes = hi - lo
            each = np.repeat(lo - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            at, back = np.unique(lists.positions[each], return_inverse=True)
            scores = np.zeros(len(at), dtype=np.int64)
            np.add.at(scores, back, lists.impacts[each])
            keep(scores, at)
        long = [t for t in taken if t[2] - t[1] > leaf]
        if long:
            begin, end = np.array([t[1] for t in long]), np.array([t[2] for t in long])
            lo, hi = np.stack([t[3] for t in long]), np.stack([t[4] for t in long])
            values, where = lists.maxima(lo, hi)
            rows = np.arange(len(long))
            split = lists.positions[where[rows, values.argmax(axis=1)]]
            keys = own * lists.n_documents + split[:, None]
            middle = np.searchsorted(lists.keys, keys)
            inside = np.minimum(middle, len(lists.keys) - 1)
            has = (middle < hi) & (lists.keys[inside] == keys)
            keep(np.where(has, lists.impacts[inside], 0).sum(axis=1), split)
            push(np.r_[begin, split + 1], np.r_[split, end], np.r_[lo, middle + has], np.r_[middle, hi])
    return [(score, -at) for score, at in sorted(found, reverse=True)]


def _searcher(asked: Broadcast, total: int, n_terms: int, best: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """What a task does with one block: (item, doc_id, score) of each item's best documents in it."""

    def search(block: pd.DataFrame) -> pd.DataFrame:
        queries, weights = asked.value
        documents, postings = block[block["term"].isna()].iloc[0], block[block["term"].notna()]
        found = []
        if len(postings):
            entries = sorted(zip(map(bytes, postings["term"]), postings["positions"], postings["tfs"]))
            lists = Lists.of(entries, np.frombuffer(documents["lengths"], dtype=np.int64), weights, total, n_terms)
            ids = documents["ids"]
            for item, own in queries:
                found.extend((item, ids[at], score) for score, at in best_documents(lists, own, best))
        doc_ids = pd.Series([f[1] for f in found], dtype=object)
        return pd.DataFrame({"item": [f[0] for f in found], "doc_id": doc_ids, "score": [f[2] for f in found]})

    return search


def search_index(index: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """(item, rank, doc_id, score) for written ``items`` (item, terms): each item's best documents of a built index.

    Items are searched a block at a time, so only that block's terms are known everywhere.
    """
    spark, id_type = index.sparkSession, _index_id_type(index)
    totals = index.where("term is null").agg(F.sum("n_documents").alias("n"), F.sum("n_terms").alias("l")).first()
    total, n_terms = totals["n"] or 0, totals["l"] or 0
    results = None
    last = -1
    while True:
        rows = items.where(F.col("item") > last).orderBy("item").limit(ITEMS_AT_A_TIME).collect()
        if not rows:
            break
        last = rows[-1]["item"]
        wanted = spark.createDataFrame([(t,) for t in {bytes(t) for r in rows for t in r["terms"]}], "term binary")
        lists = index.join(F.broadcast(wanted), "term", "left_semi")
        counted = lists.groupBy("term").agg(F.sum("n_documents").alias("df")).collect()
        weights = {bytes(r["term"]): weight(total, r["df"]) for r in counted}
        asked = spark.sparkContext.broadcast(([(r["item"], [bytes(t) for t in r["terms"]]) for r in rows], weights))
        parts = lists.unionByName(index.where("term is null")).select("block", "term", "positions", "tfs", "ids", "lengths")
        local = materialise(parts.groupBy("block").applyInPandas(_searcher(asked, total, n_terms, best), f"item long, doc_id {id_type}, score long"), "found")
        results = local if results is None else results.unionByName(local)
    if results is None:
        return spark.createDataFrame([], f"item long, rank int, doc_id {id_type}, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return results.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def _index_id_type(index: DataFrame) -> str:
    return index.schema["ids"].dataType.elementType.simpleString()


def search(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    best: int = BEST,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``best`` documents of each item, of equal scores the smaller id first.

    Null texts have no terms, and items without terms, or whose terms no document has, no rows.
    Every row of ``docs`` is a document and every row of ``items`` an item, repeated ones too; null
    ids come last among equal scores. Other columns are ignored; an empty table gives an empty result.
    """

    @F.pandas_udf("array<binary>")
    def distinct_terms(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: sorted(set(terms(text))))

    numbered = materialise(
        items.select(
            F.col(item_column).alias("item_id"),
            F.monotonically_increasing_id().alias("item"),
            distinct_terms(whole_text(item_text)).alias("terms"),
        ),
        "items",
    )
    own = materialise(numbered.select(F.explode("terms").alias("term")).distinct(), "terms")
    few = own.count() <= VOCABULARY
    vocabulary = [bytes(row["term"]) for row in own.collect()] if few else None
    found = search_index(build_index(docs, vocabulary, id_column, text_column), numbered, best)
    return found.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


#: The same for unique ids, in DuckDB's SQL.
SQL = r"""
WITH runs AS (
    SELECT doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM runs GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tfs GROUP BY doc_id),
totals AS (SELECT count(*) AS n_documents, sum(n)::BIGINT AS n_terms FROM sizes),
weights AS (
    SELECT term, floor(1000 * ln((2 * any_value(n_documents) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
    FROM tfs, totals GROUP BY term),
wanted AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark),
scores AS (
    SELECT item_id, doc_id,
        sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_documents) // n_terms))))::BIGINT AS score
    FROM wanted JOIN tfs USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), totals
    GROUP BY ALL),
ranked AS (
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
    FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
