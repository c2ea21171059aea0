"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, an exact check.

A window has as many words as a benchmark item. Only windows that share enough word shingles
with an item of that size can be similar to it; their places follow from the positions of the
shared shingles, so the others need no fingerprint. The fingerprint of each window is looked
up in an index over the items: it is cut into blocks, and two fingerprints within the radius
differ by at most ``RADIUS // BLOCKS`` bits in one block at least, so the index holds every
block of an item with every change of that many bits, and the blocks of a window find all
items within the radius. A shingle that repeats weighs in a fingerprint as often as it occurs,
so a similar window may differ in more bits than the radius; windows beyond the radius of an
item that placed them are taken as they are. All are verified on the shingles themselves, each
weighing as often as it occurs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ingestctl.llm.common import letter_words, once, whole_text
from ingestctl.scratch import materialise

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Differing bits of 64 that the index finds; texts at the similarity bound differ in about 10 where few shingles repeat.
RADIUS = 21
BLOCKS = 11
_HALVES = 0x0000000100000001


def shingle_hashes(text: Column, size: int) -> Column:
    """A hash of each run of ``size`` words; empty if there are fewer words."""
    return once(
        F.transform(letter_words(text), lambda w: F.xxhash64(w)),
        lambda h: F.when(
            F.size(h) >= size,
            F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*[h[i + j] for j in range(size)])),
        ).otherwise(F.array().cast("array<bigint>")),
    )


def simhash(hashes: Column) -> Column:
    """A bit is 1 if it is set in over half the hashes. Bits s and s + 32 are counted in one number."""
    counts = F.aggregate(
        hashes,
        F.array_repeat(F.lit(0).cast("long"), 32),
        lambda acc, h: F.transform(
            acc, lambda a, s: a + F.call_function("shiftrightunsigned", h, s).bitwiseAND(F.lit(_HALVES))
        ),
    )

    def bit(acc: Column, size: Column, b: Column) -> Column:
        count = F.call_function("shiftrightunsigned", acc[b % 32], F.when(b < 32, 0).otherwise(32)).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.when(count * 2 > size, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    return once(
        F.struct(counts.alias("acc"), F.size(hashes).alias("size")),
        lambda s: F.aggregate(
            F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda f, b: f.bitwiseOR(bit(s["acc"], s["size"], b))
        ),
    )


def _block_bits() -> list[tuple[int, int]]:
    """(first bit, number of bits) of each block."""
    edges = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _block(fingerprint: Column, number: int) -> Column:
    first, size = _block_bits()[number]
    return F.shiftrightunsigned(fingerprint, first).bitwiseAND(F.lit((1 << size) - 1)).cast("int")


def _probes(fingerprint: Column) -> Column:
    """Every block of a fingerprint, as it is and with one bit changed: what RADIUS // BLOCKS = 1 needs."""
    entries = []
    for number, (_, size) in enumerate(_block_bits()):
        own = _block(fingerprint, number)
        for value in [own, *(own.bitwiseXOR(F.lit(1 << b)) for b in range(size))]:
            entries.append(F.struct(F.lit(number).alias("block"), value.alias("value")))
    return F.explode(F.array(*entries))


def _shared(window: Column, item: Column) -> Column:
    """The weight that two lists of shingles share: each shingle as often as it occurs in both."""

    def times(among: Column, shingle: Column) -> Column:
        return F.size(F.filter(among, lambda x: x == shingle))

    return F.aggregate(
        F.array_intersect(item, window), F.lit(0), lambda total, s: total + F.least(times(window, s), times(item, s))
    )


def _starts(positions: Column, need: Column, width: Column, count: Column) -> Column:
    """Where windows of ``width`` shingles begin that hold at least ``need`` of the sorted ``positions``."""

    def run(p: Column, i: Column) -> Column:
        after = F.when(i > 0, p[i - 1] + 1).otherwise(0)
        low = F.greatest(after, p[i + need - 1] - width + 1, F.lit(0))
        high = F.least(p[i], count - width)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    return once(
        positions,
        lambda p: F.when(
            F.size(p) >= need,
            F.flatten(F.transform(F.sequence(F.lit(0), F.size(p) - need), lambda i: run(p, i))),
        ).otherwise(F.array().cast("array<int>")),
    )


def _items(benchmark: DataFrame, id_column: str, text_column: str) -> DataFrame:
    source = benchmark.select(F.col(id_column).alias("item_id"), whole_text(text_column).alias("text"))
    every = source.distinct().withColumn("n_words", F.size(letter_words(F.col("text")))).where("n_words > 0")
    sizes = F.least("n_words", F.lit(SHINGLE_WORDS))
    by_size = reduce(
        lambda rest, k: F.when(sizes == k, shingle_hashes(F.col("text"), k)).otherwise(rest),
        range(SHINGLE_WORDS - 1, 0, -1),
        shingle_hashes(F.col("text"), SHINGLE_WORDS),
    )
    return every.select(
        "item_id",
        F.xxhash64("item_id", "text").alias("item"),
        "n_words",
        sizes.alias("shingle_words"),
        by_size.alias("shingles"),
    ).withColumn("fingerprint", simhash(F.col("shingles")))


def _need(count: Column, other: Column, similarity: float) -> Column:
    """The shared weight that a similarity takes: s / (a + b - s) >= t."""
    return F.ceil((count + other) * F.lit(similarity / (1 + similarity)) - F.lit(1e-9)).cast("int")


def _found(docs: DataFrame, items: DataFrame, size: int, similarity: float) -> DataFrame:
    """Similar (document, window, item) for the items whose shingles have ``size`` words."""
    own = items.where(F.col("shingle_words") == size)
    anchors = materialise(
        own.select("item", F.size("shingles").alias("count"), F.explode(F.array_distinct("shingles")).alias("hash")), "anchors"
    )
    hits = docs.select("doc_id", "text_hash", F.posexplode(shingle_hashes(F.col("text"), size)).alias("pos", "hash")).join(
        anchors, "hash"
    )
    pairs = materialise(
        hits.groupBy("doc_id", "text_hash", "item", "count")
        .agg(F.array_sort(F.collect_set("pos")).alias("positions"))
        .where(F.size("positions") >= F.col("count") * similarity - 1e-9)
        .join(own.select("item", "n_words"), "item")
        .select(F.col("doc_id").alias("of_doc"), F.col("text_hash").alias("of_hash"), "item", "n_words", "count", "positions"),
        "pairs",
    )
    holders = materialise(pairs.select("of_doc", "of_hash").distinct(), "holders")
    # Repeated rows hold the same windows: one of them is enough.
    held = materialise(
        docs.join(holders, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_hash") == F.col("of_hash")), "leftsemi")
        .dropDuplicates(["doc_id", "text_hash"])
        .select("doc_id", "text_hash", shingle_hashes(F.col("text"), size).alias("all")),
        "held",
    )
    width = F.least(F.col("count"), F.size("all"))
    place = ["doc_id", "text_hash", "n_words", "start"]
    windows = materialise(
        held.join(pairs, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_hash") == F.col("of_hash")))
        .withColumn("width", width)
        .withColumn("need", _need(F.col("width"), F.col("count"), similarity))
        .withColumn("start", F.explode(_starts(F.col("positions"), F.col("need"), F.col("width"), F.size("all"))))
        .select(*place, F.slice("all", F.col("start") + 1, F.col("width")).alias("window"), "item")
        .groupBy(*place, "window")
        .agg(F.collect_set("item").alias("placed_by"))
        .withColumn("fingerprint", simhash(F.col("window"))),
        "windows",
    )
    index = materialise(
        own.select("item", "n_words", _probes(F.col("fingerprint")).alias("p")).select("item", "n_words", "p.block", "p.value"),
        "index",
    )
    blocks = F.explode(
        F.array(*[F.struct(F.lit(n).alias("block"), _block(F.col("fingerprint"), n).alias("value")) for n in range(BLOCKS)])
    )
    candidates = (
        windows.select("doc_id", "text_hash", "n_words", "start", blocks.alias("b"))
        .select("doc_id", "text_hash", "n_words", "start", "b.block", "b.value")
        .join(index, ["n_words", "block", "value"])
        .select("doc_id", "text_hash", "start", "item")
        .distinct()
    )
    compared = own.select("item", "item_id", "n_words", F.col("shingles").alias("theirs"), F.col("fingerprint").alias("their_fingerprint"))
    shared = _shared(F.col("window"), F.col("theirs"))
    bits = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("their_fingerprint")))
    columns = [*place, "item_id", "window", "theirs", "bits"]
    near = (
        candidates.join(compared, "item")
        .alias("c")
        .join(
            windows.alias("w"),
            F.col("c.doc_id").eqNullSafe(F.col("w.doc_id"))
            & (F.col("c.text_hash") == F.col("w.text_hash"))
            & (F.col("c.n_words") == F.col("w.n_words"))
            & (F.col("c.start") == F.col("w.start")),
        )
        .withColumn("bits", bits)
        .where(F.col("bits") <= RADIUS)
        .select(*[F.col(f"w.{name}").alias(name) for name in place], "item_id", "window", "theirs", "bits")
    )
    far = (
        windows.select(*place, "window", "fingerprint", F.explode("placed_by").alias("item"))
        .join(compared.drop("n_words"), "item")
        .withColumn("bits", bits)
        .where(F.col("bits") > RADIUS)
        .select(*columns)
    )
    return (
        near.unionByName(far)
        .withColumn("shared", shared)
        .select(
            "doc_id",
            "text_hash",
            "item_id",
            "start",
            "n_words",
            "bits",
            (F.col("shared") / (F.size("window") + F.size("theirs") - F.col("shared"))).alias("similarity"),
        )
        .where(F.col("similarity") >= similarity)
    )


#: The rows of the registered query in DuckDB's SQL, for items of five words or more: all windows of all pairs that share a shingle.
SQL = """
WITH doc_words AS (
    SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents
), item_words AS (
    SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark
), doc_shingles AS (
    SELECT doc_id, pos, array_to_string(w[pos + 1 : pos + 5], ' ') AS shingle
    FROM (SELECT doc_id, w, unnest(range(0, len(w) - 4)) AS pos FROM doc_words)
), item_shingles AS (
    SELECT item_id, array_to_string(w[pos + 1 : pos + 5], ' ') AS shingle, count(*) AS times
    FROM (SELECT item_id, w, unnest(range(0, len(w) - 4)) AS pos FROM item_words) GROUP BY ALL
), hits AS (
    SELECT doc_id, item_id, pos, shingle, times FROM doc_shingles JOIN item_shingles USING (shingle)
), pairs AS (
    SELECT DISTINCT h.doc_id, h.item_id, len(i.w) AS n_words, len(i.w) - 4 AS theirs, len(d.w) - 4 AS own,
           least(len(i.w), len(d.w)) - 4 AS width
    FROM hits h JOIN doc_words d USING (doc_id) JOIN item_words i USING (item_id)
), windows AS (
    SELECT *, unnest(range(0, own - width + 1)) AS start FROM pairs
), held AS (
    SELECT w.doc_id, w.item_id, w.n_words, w.theirs, w.width, w.start, h.shingle, least(count(*), min(h.times)) AS shared
    FROM windows w JOIN hits h ON h.doc_id = w.doc_id AND h.item_id = w.item_id AND h.pos BETWEEN w.start AND w.start + w.width - 1
    GROUP BY ALL
), scored AS (
    SELECT doc_id, item_id, n_words, start, sum(shared) / (width + theirs - sum(shared)) AS similarity
    FROM held GROUP BY doc_id, item_id, n_words, start, width, theirs
)
SELECT doc_id, item_id, cast(start AS bigint) AS start, cast(n_words AS bigint) AS n_words, similarity
FROM scored WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""


def text_hash(column: str = "text") -> Column:
    return F.xxhash64(whole_text(column))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    similarity: float = SIMILARITY,
) -> DataFrame:
    """One row per document and benchmark item that has a similar window in it, with the best window.

    Columns: doc_id, text_hash, item_id, start (in words, from 0; the first of equals), n_words,
    bits (of the fingerprints that differ), similarity. Words are runs of letters and digits in
    lower case. Items of fewer than five words are one shingle; items without words match
    nothing. A document shorter than an item is one window. Null texts count as empty; repeated
    rows (same id and text) are reported once; an id with several texts has a row for each.
    Other columns are ignored; an empty table on either side gives an empty result.
    """
    items = materialise(_items(benchmark, item_column, item_text_column), "items")
    sizes = sorted(row[0] for row in items.select("shingle_words").distinct().collect()) or [SHINGLE_WORDS]
    source = docs.select(
        F.col(id_column).alias("doc_id"), text_hash(text_column).alias("text_hash"), whole_text(text_column).alias("text")
    )
    found = reduce(DataFrame.unionByName, [_found(source, items, size, similarity) for size in sizes])
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), (-F.col("bits")).alias("same"), "n_words")).alias("best")
    return (
        found.groupBy("doc_id", "text_hash", "item_id")
        .agg(best)
        .select(
            "doc_id",
            "text_hash",
            "item_id",
            (-F.col("best.back")).alias("start"),
            F.col("best.n_words").alias("n_words"),
            (-F.col("best.same")).alias("bits"),
            F.col("best.similarity").alias("similarity"),
        )
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    found = contaminated(docs, benchmark, id_column, text_column, **options)
    bad = materialise(found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "contaminated")
    own = docs.select(F.struct("*").alias("whole"), F.col(id_column).alias("id"), text_hash(text_column).alias("hash"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))
    return own.join(bad, same, "leftanti").select("whole.*")
