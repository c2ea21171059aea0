"""Decontamination against a search over all windows."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ingestctl.llm import decontaminate as D
from ingestctl.llm.catalog import ORACLES, QUERIES
from tests.compare import connect, differences
from tests.conftest import rows

DIR = "/root/testdata/sf0.001"


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def plain_search(docs, items, similarity=0.8):
    found = []
    for doc, text in set(docs):
        own = words(text)
        for item, passage in set(items):
            theirs = words(passage)
            size = min(5, len(theirs))
            if not size:
                continue
            cut = lambda w: [tuple(w[i : i + size]) for i in range(len(w) - size + 1)]
            mine, other = cut(own), cut(theirs)
            width, best = min(len(mine), len(other)), None
            for start in range(len(mine) - width + 1) if mine else ():
                shared = sum((Counter(mine[start : start + width]) & Counter(other)).values())
                score = shared / (width + len(other) - shared)
                if score >= similarity and (best is None or score > best[0]):
                    best = (score, start)
            if best:
                found.append((doc, item, best[1], len(theirs), round(best[0], 9)))
    return sorted(found, key=repr)


def search(docs, items, **options):
    found = D.contaminated(docs, items, **options)
    return rows(found.select("doc_id", "item_id", "start", "n_words", F.round("similarity", 9)))


def documents(spark, pairs):
    schema = "doc_id long, text string, item_id int, n_words string, whole string, hash string"
    return spark.createDataFrame([(i, t, 1, "n", "w", "h") for i, t in pairs], schema)


def benchmark(spark, pairs):
    return spark.createDataFrame([(i, t, 5) for i, t in pairs], "item_id long, text string, doc_id int")


def test_given_tables(spark):
    docs, items = (spark.read.parquet(f"{DIR}/{n}.parquet") for n in ("documents", "benchmark"))
    expected = plain_search(
        [(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()]
    )
    assert expected and search(docs, items) == expected


def test_edited_passages(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(300)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([14, 20, 35, 60])))) for i in range(12)]
    docs = []
    for i in range(60):
        own = [word() for _ in range(rng.randrange(40))]
        passage = rng.choice(items)[1].split()
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(passage))
            passage[at : at + rng.randrange(2)] = [word()] * rng.randrange(2)
        if i % 5 == 0:
            passage = [passage[-1], *passage[:-1]]
        docs.append((i, " ".join([*own, *passage, *own[::-1]]).title()))
    expected = plain_search(docs, items)
    assert 20 < len(expected) < 60 and any(e[-1] < 1 for e in expected)
    assert search(documents(spark, docs), benchmark(spark, items)) == expected


PASSAGE = "one two three four five six seven eight nine ten eleven twelve"
DOCS = [
    (1, None),
    (2, ""),
    (3, PASSAGE),
    (3, PASSAGE),
    (3, "another text of three"),
    (None, f"x {PASSAGE} y"),
    (4, "One, two -- three! four; five six seven eight nine ten eleven"),
    (5, "long " * 100_000 + PASSAGE),
    (6, "a a a a a a a a a a a a a a"),
    (7, "short item"),
    (8, f"{PASSAGE} gap {PASSAGE}"),
]
ITEMS = [(1, PASSAGE), (1, PASSAGE), (2, None), (3, "..."), (4, "a a a a a a a a a"), (5, "Short item"), (None, PASSAGE), (6, "y")]


@pytest.mark.parametrize("similarity", [0.8, 0.95])
def test_odd_rows(spark, similarity):
    got = search(documents(spark, DOCS), benchmark(spark, ITEMS), similarity=similarity)
    assert got == plain_search(DOCS, ITEMS, similarity)


def test_empty_tables(spark):
    assert search(documents(spark, []), benchmark(spark, ITEMS)) == []
    assert search(documents(spark, DOCS), benchmark(spark, [])) == []


def test_clean_documents_stay(spark):
    kept = D.keep_clean(documents(spark, DOCS), benchmark(spark, ITEMS))
    assert kept.columns == documents(spark, []).columns
    bad = {i for i, *_ in plain_search(DOCS, ITEMS)} - {3}
    expected = [(i, t, 1, "n", "w", "h") for i, t in DOCS if i not in bad and t != PASSAGE]
    assert rows(kept) == sorted(expected, key=repr)


def test_every_fingerprint_within_the_radius_is_found(spark):
    rng = random.Random(1)
    pairs = []
    for n in range(300):
        a = rng.getrandbits(64)
        bits = rng.sample(range(64), rng.randrange(D.RADIUS + 1))
        b = a ^ sum(1 << i for i in bits)
        pairs.append((n, a - 2**64 if a >> 63 else a, b - 2**64 if b >> 63 else b))
    frame = spark.createDataFrame(pairs, "n long, a long, b long")
    probes = frame.select("n", D._probes(F.col("a")).alias("p")).select("n", "p.block", "p.value")
    blocks = F.explode(
        F.array(*[F.struct(F.lit(k).alias("block"), D._block(F.col("b"), k).alias("value")) for k in range(D.BLOCKS)])
    )
    met = frame.select("n", blocks.alias("q")).select("n", "q.block", "q.value").join(probes, ["n", "block", "value"])
    assert met.select("n").distinct().count() == 300


def test_fingerprint_by_majority(spark):
    frame = spark.sql("SELECT array(3L, 5L, -1L) AS h UNION ALL SELECT array(1L, 2L) UNION ALL SELECT array()")
    got = {tuple(r[0]): r[1] for r in frame.select("h", D.simhash(F.col("h"))).collect()}
    assert got == {(3, 5, -1): 7, (1, 2): 0, (): 0}


def test_against_sql(spark):
    directory = "/root/testdata/sf0.01"
    name = "op4_decontamination"
    assert differences(spark, connect(directory), QUERIES[name], ORACLES[name], directory) is None


def test_repeated_shingles_at_the_bound(spark):
    rng = random.Random(7)
    docs, items = [], []
    for i in range(12):
        rest = [f"w{rng.randrange(10**6)}" for _ in range(164)]
        items.append((i, " ".join(["0"] * 20 + rest)))
        other = [f"v{rng.randrange(10**6)}" for _ in range(20)]
        docs.append((i, " ".join(["before", "it", *other, *rest, "and", "after"])))
    expected = plain_search(docs, items)
    assert [e[-1] for e in expected] == [0.8] * 12
    assert search(documents(spark, docs), benchmark(spark, items)) == expected
    found = D.contaminated(documents(spark, docs), benchmark(spark, items))
    assert found.where(F.col("bits") > D.RADIUS).count() > 0
