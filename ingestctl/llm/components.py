"""Connected components of an edge table, by alternating star contraction.

Each round links every node to the smallest node in reach of one step: first the larger
neighbours of a node go to the smallest of its neighbourhood, then the smaller ones do. Trees
shrink to stars in a number of rounds that grows with the logarithm of the graph. A node of
any degree costs one aggregate with map-side combine, and a join that adaptive execution can
split, as its unique side has been written first; no neighbourhood is ever collected. Each
round is a written table, so that lineage stays short and a lost executor costs at most one
round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ingestctl.scratch import materialise


def _directed(edges: DataFrame, high: str = "high", low: str = "low") -> DataFrame:
    return edges.select(F.col(high).alias("node"), F.col(low).alias("other"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _directed(edges).unionByName(_directed(edges, "low", "high"))
    smallest = materialise(both.groupBy("node").agg(F.least("node", F.min("other")).alias("least")), "smallest")
    return (
        _directed(edges, "low", "high")
        .join(smallest, "node")
        .select(F.col("other").alias("high"), F.col("least").alias("low"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    smallest = materialise(edges.groupBy("high").agg(F.min("low").alias("least")), "smallest")
    moved = edges.join(smallest, "high").where("low <> least").select(
        F.col("low").alias("high"), F.col("least").alias("low")
    )
    kept = smallest.select("high", F.col("least").alias("low"))
    return moved.unionByName(kept).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("high", "low"))).first())


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node that has a link to another one; root is its component's smallest node.

    ``links`` may hold a link in either direction, more than once, or from a node to itself;
    links with a null end are no links. Nodes without links are not returned.
    """
    edges = materialise(
        links.where(F.col(left) != F.col(right))
        .select(F.greatest(left, right).alias("high"), F.least(left, right).alias("low"))
        .distinct(),
        "links",
    )
    state = _state(edges)
    while state[0]:
        edges = materialise(_small_star(materialise(_large_star(edges), "larger")), "stars")
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select("low").distinct()
    return edges.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(
        roots.select(F.col("low").alias("node"), F.col("low").alias("root"))
    )
