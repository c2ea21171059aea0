"""Labelled training rows: a bounded, stratified sample of the labels and the weight of each class."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ingestctl.scratch import materialise

#: Tasks that the sampled texts are spread over, which are few bytes but much work.
FEATURE_TASKS = 16


@dataclass(frozen=True)
class Sample:
    """Rows to learn from: doc_id and label (0 or 1), and how many of each label there are in all."""

    rows: DataFrame
    totals: tuple[int, int]
    sampled: tuple[int, int]

    def weight(self, label: int) -> float:
        """Restores the share that a class has among all labelled rows."""
        if not self.sampled[label]:
            return 0.0
        return self.totals[label] / self.sampled[label] * sum(self.sampled) / sum(self.totals)


def labelled(labels: DataFrame, label: str, held_out: Column, id_column: str = "doc_id") -> DataFrame:
    """(doc_id, label) to learn from: one row per id, without nulls, contradictions and held-out ids."""
    return (
        labels.where(F.col(id_column).isNotNull() & F.col(label).isin(0, 1))
        .where(~held_out)
        .groupBy(F.col(id_column).alias("doc_id"))
        .agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("other"))
        .where("label = other")
        .select("doc_id", "label")
    )


def sample(labels: DataFrame, label: str, held_out: Column, per_class: int, id_column: str = "doc_id") -> Sample:
    """At most ``per_class`` rows of each label, chosen by a hash of the id."""
    every = materialise(labelled(labels, label, held_out, id_column), "labelled")
    counts = {row["label"]: row["count"] for row in every.groupBy("label").count().collect()}
    order = F.xxhash64(F.lit("sample"), F.col("doc_id"))
    chosen = [every.where(F.col("label") == value).orderBy(order).limit(per_class) for value in (0, 1)]
    rows = materialise(reduce(DataFrame.unionByName, chosen), "sampled")
    totals = (counts.get(0, 0), counts.get(1, 0))
    return Sample(rows, totals, tuple(min(n, per_class) for n in totals))


def with_texts(chosen: Sample, docs: DataFrame, id_column: str, text: Column) -> DataFrame:
    """(doc_id, label, text) of the sampled ids, one row each; the sample is bounded by its parameter, so it is broadcast.

    Of an id's several rows the smallest text counts, so a repeated id adds no row to the sample.
    """
    texts = docs.select(F.col(id_column).alias("doc_id"), text.alias("text"))
    one = texts.join(F.broadcast(chosen.rows), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return one.repartition(FEATURE_TASKS)
