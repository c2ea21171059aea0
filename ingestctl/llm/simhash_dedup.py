"""Near-duplicates by SimHash: segment bit counts as coordinates, a grid range join, an exact check.

A fingerprint is cut into segments of two bits; the bit counts of the segments are its
coordinates. The Manhattan distance of two such points never exceeds the number of differing
bits, so a range join on it loses no link. The points are cut into ``parts`` of the
coordinates: a pair within ``max_bits`` is within ``max_bits // parts`` in one of them, and
there a grid of unit cells is probed around each point. What comes out is tested on the whole
Manhattan distance and then on the bits themselves. Only distinct fingerprints are joined, so a
group of copies of any size is one point.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ingestctl.llm.common import ascii_words, text_key, whole_text
from ingestctl.llm.components import components
from ingestctl.scratch import materialise

SEED = 42
#: Production contract: words per shingle, and the largest number of differing bits of a link.
SHINGLE_WORDS, MAX_BITS = 3, 3
SEGMENT_BITS, SEGMENTS, PARTS = 2, 32, 2
_BLOCK = 65_536


def simhash(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint, unsigned; a bit is 1 if it is set in over half the shingle hashes."""
    words = ascii_words(text)
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle_words:
        return digest(joined, SEED)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    spans = list(zip((ends - lengths).tolist(), ends[shingle_words - 1 :].tolist()))
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(spans), _BLOCK):
        hashes = np.array([digest(joined[i:j], SEED) for i, j in spans[at : at + _BLOCK]], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(spans), bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, shingle_words: int = SHINGLE_WORDS) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("long")
    def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            values = np.fromiter((simhash(t, shingle_words) for t in texts), np.uint64, len(texts))
            yield pd.Series(values.view(np.int64))

    return fingerprints(text)


def hex16(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def _count(fingerprint: str, segment: int) -> Column:
    """The bit count of one segment, 0 to 2."""
    shifted = F.shiftrightunsigned(F.col(fingerprint), SEGMENT_BITS * segment)
    return F.bit_count(shifted.bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1)))


def _part(part: int) -> range:
    size = SEGMENTS // PARTS
    return range(part * size, (part + 1) * size)


def _cell(fingerprint: str, part: int) -> Column:
    """The number of the grid cell that a point lies in, in one part of the coordinates."""
    terms = [_count(fingerprint, s) * F.lit((SEGMENT_BITS + 1) ** i) for i, s in enumerate(_part(part))]
    return reduce(add, [t.cast("long") for t in terms])


def _steps(fingerprint: str, part: int) -> list[Column]:
    """What a step up by one in each coordinate adds to the cell's number; null where it leaves the grid."""
    return [
        F.when(_count(fingerprint, s) < SEGMENT_BITS, F.lit((SEGMENT_BITS + 1) ** i).cast("long"))
        for i, s in enumerate(_part(part))
    ]


def _manhattan(a: str, b: str) -> Column:
    return reduce(add, [F.abs(_count(a, s) - _count(b, s)) for s in range(SEGMENTS)])


def links(points: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) for all pairs of different values of ``fingerprint`` with at most ``max_bits`` differing bits, a < b.

    ``points`` holds each fingerprint once. The grid is probed one step up in each coordinate
    from either point of a pair, which reaches every pair that is within one step of each
    other; that is what ``max_bits`` up to 3 needs with two parts.
    """
    if not 0 <= max_bits < 2 * PARTS:
        raise ValueError(f"two parts reach at most {2 * PARTS - 1} differing bits")
    found = []
    for part in range(PARTS):
        at = points.select(F.col("fingerprint").alias("a"), _cell("fingerprint", part).alias("cell"))
        reach = F.array(F.lit(0).cast("long"), *(_steps("fingerprint", part) if max_bits >= PARTS else []))
        probe = (
            points.select("fingerprint", _cell("fingerprint", part).alias("own"), F.explode(F.array_compact(reach)).alias("step"))
            .select(F.col("fingerprint").alias("b"), (F.col("own") + F.col("step")).alias("cell"), "step")
        )
        found.append(
            at.join(probe, "cell")
            .where("step > 0 or a < b")
            .where(_manhattan("a", "b") <= max_bits)
            .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        )
    return reduce(DataFrame.unionByName, found).distinct()


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """One row per row of ``docs``: its id, text_key, fingerprint (signed long) and component_id.

    Documents are linked if their fingerprints differ in at most ``max_bits`` bits;
    component_id is the smallest id that can be reached over links, the own one included.
    Null and empty texts, and texts of white space only, have fingerprint 0 and are linked like
    any other. Repeated rows come out as often as they go in. A row without an id takes part;
    its component_id is the smallest id there is in its component, and null if there is none.
    Other columns of ``docs`` are ignored; an empty table gives an empty result.
    """
    marked = materialise(
        docs.select(
            F.col(id_column).alias("doc_id"),
            text_key(text_column).alias("text_key"),
            fingerprint_column(whole_text(text_column), shingle_words).alias("fingerprint"),
        ),
        "fingerprints",
    )
    points = materialise(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id")), "points")
    roots = materialise(components(links(points, max_bits), "a", "b"), "roots")
    rooted = points.join(roots, points["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "least_id", F.coalesce("root", "fingerprint").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = materialise(rooted.join(least, "root").select("fingerprint", "component_id", "root"), "classes")
    return marked.join(classes, "fingerprint").select(
        "doc_id", "text_key", "fingerprint", "component_id", F.col("root").alias("component_root")
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of each component: the one with the smallest id, then text key; rows of equal id and text are one."""
    id_column, text_column = options.get("id_column", "doc_id"), options.get("text_column", "text")
    classes = near_duplicates(docs, **options)
    first = F.min(F.struct(F.isnull("doc_id").alias("nameless"), "doc_id", "text_key")).alias("first")
    winners = materialise(
        classes.groupBy("component_root").agg(first).select("first.doc_id", "first.text_key"), "winners"
    )
    repeated = classes.groupBy("doc_id", "text_key").count().where("count > 1").select("doc_id", "text_key")
    chosen = materialise(
        winners.join(
            repeated.withColumn("again", F.lit(True)),
            winners["doc_id"].eqNullSafe(repeated["doc_id"]) & (winners["text_key"] == repeated["text_key"]),
            "left",
        ).select(winners["doc_id"].alias("_id"), winners["text_key"].alias("_key"), F.col("again").isNotNull().alias("_again")),
        "chosen",
    )
    own = docs.select(F.struct("*").alias("whole"), F.col(id_column).alias("id"), text_key(text_column).alias("key"))
    kept = own.join(chosen, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")))
    single = kept.where("not _again").select("whole.*")
    once = kept.where("_again").dropDuplicates(["_id", "_key"]).select("whole.*")
    return single.unionByName(once)
