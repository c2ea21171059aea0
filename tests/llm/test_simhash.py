"""SimHash near-dedup against pairwise comparison."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from ingestctl.llm import components, simhash_dedup as S
from tests.conftest import rows

SCHEMA = "doc_id long, text string, fingerprint int, component_id string, whole string"


def documents(spark, pairs):
    return spark.createDataFrame([(i, t, 7, "x", "y") for i, t in pairs], SCHEMA)


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for gap in "\t\n\x0b\x0c\r":
        words = words.replace(gap, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Smallest id in reach over links of at most three bits; prints: (id, fingerprint)."""
    roots = list(range(len(prints)))

    def find(i):
        while roots[i] != i:
            i = roots[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= 3:
                roots[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(doc, least.get(find(i))) for i, (doc, _) in enumerate(prints)]


CASES = [
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, "One"),
    (5, "one two"),
    (6, "ONE  TWO"),
    (7, "Éa b c d e"),
    (8, "long " * 200_000 + "end"),
    (9, "a b c d e f g h i j k l m n o p q r s t u v w x y z"),
    (9, "another text under the same id"),
    (10, "a b c d e f g h i j k l m n o p q r s t u v w x y z"),
    (10, "a b c d e f g h i j k l m n o p q r s t u v w x y z"),
    (None, "a text without an id"),
    (None, "a b c d e f g h i j k l m n o p q r s t u v w x y z"),
]


def test_edge_cases(spark):
    got = S.near_duplicates(documents(spark, CASES))
    fingerprints = rows(got.select("doc_id", S.hex16(F.col("fingerprint"))))
    assert fingerprints == sorted(((i, f"{plain_fingerprint(t):016x}") for i, t in CASES), key=repr)
    expected = plain_components([(i, plain_fingerprint(t)) for i, t in CASES])
    assert rows(got.select("doc_id", "component_id")) == sorted(expected, key=repr)


def test_edited_copies(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    texts = []
    for i in range(120):
        words = list(base) if i % 3 else [f"v{rng.randrange(5000)}" for _ in range(60)]
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(99)}"
        texts.append((i, " ".join(words)))
    expected = plain_components([(i, plain_fingerprint(t)) for i, t in texts])
    assert len({c for _, c in expected}) < len(expected)
    got = S.near_duplicates(documents(spark, texts))
    assert rows(got.select("doc_id", "component_id")) == sorted(expected, key=repr)


@pytest.mark.parametrize("max_bits", [0, 1, 2, 3])
def test_links_lose_nothing(spark, max_bits):
    rng = random.Random(max_bits)
    points = {rng.getrandbits(64) for _ in range(40)} | {0, 2**64 - 1}
    for p in list(points):
        for _ in range(6):
            points.add(p ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(6))}))
    signed = [p - 2**64 if p >= 2**63 else p for p in points]
    frame = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    expected = {
        (a, b) for a in signed for b in signed if a < b and bin((a ^ b) % 2**64).count("1") <= max_bits
    }
    assert {tuple(r) for r in S.links(frame, max_bits).collect()} == expected


def test_wider_radius_is_refused(spark):
    with pytest.raises(ValueError, match="at most 3"):
        S.links(spark.range(1).toDF("fingerprint"), 4)


def test_keep_one(spark):
    kept = S.keep_one(documents(spark, CASES))
    assert kept.columns == ["doc_id", "text", "fingerprint", "component_id", "whole"]
    classes = rows(S.near_duplicates(documents(spark, CASES)).select("component_root").distinct())
    got = rows(kept.select("doc_id", "text"))
    assert len(got) == len(classes)
    assert (9, CASES[8][1]) in got and (10, CASES[8][1]) not in got
    assert (1, None) in got and (2, "") not in got


def test_keep_one_of_repeated_rows(spark):
    kept = S.keep_one(documents(spark, [(5, "same text here"), (5, "same text here"), (6, "same text here")]))
    assert rows(kept.select("doc_id")) == [(5,)]


def test_empty_table(spark):
    assert rows(S.near_duplicates(documents(spark, []))) == []
    assert rows(S.keep_one(documents(spark, []))) == []


def test_components_of_long_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(100, 200)] + [(1000 + i, 999) for i in range(300)] + [(5, 5), (None, 3)]
    frame = spark.createDataFrame(links + [(b, a) for a, b in links[:50]], "a long, b long")
    got = dict(rows(components.components(frame, "a", "b")))
    assert got == {i: 100 for i in range(100, 201)} | {i: 999 for i in range(999, 1300)}
