"""Data-quality rules of a load: conditions counted while the rows are written, with a share of failures allowed."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ingestctl.scratch import small_frame

RESULT_SCHEMA = T.StructType(
    [
        T.StructField("checked_timestamp", T.TimestampType(), False),
        T.StructField("entity_name", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("load_id", T.StringType()),
        T.StructField("rule_name", T.StringType()),
        T.StructField("n_rows", T.LongType()),
        T.StructField("n_failed", T.LongType()),
        T.StructField("max_failed_share", T.DoubleType()),
        T.StructField("passed", T.BooleanType()),
    ]
)


class RulesBroken(ValueError):
    pass


@dataclass(frozen=True)
class Rule:
    """``condition`` is SQL over the target's columns; a row for which it is not true has failed."""

    name: str
    condition: str
    max_failed_share: float


def rules_by_entity(rules: DataFrame | None) -> dict[str, list[Rule]]:
    """From a table of (entity_name, rule_name, condition, max_failed_share); a null share allows no failure."""
    found: dict[str, list[Rule]] = {}
    for row in rules.collect() if rules is not None else []:
        rule = Rule(row["rule_name"], row["condition"], row["max_failed_share"] or 0.0)
        found.setdefault(row["entity_name"], []).append(rule)
    return {name: sorted(own, key=lambda rule: rule.name) for name, own in found.items()}


@dataclass
class Checked:
    """The rows, which count each rule's failures on their way to wherever they are written."""

    rows: DataFrame
    rules: list[Rule]
    counted: Observation

    def results(self) -> list[tuple[Rule, int, int, bool]]:
        """(rule, rows, failures, passed) after the rows were written; an empty load passes."""
        counts = self.counted.get
        n_rows = counts["n_rows"]
        found = []
        for i, rule in enumerate(self.rules):
            n_failed = counts[f"failed_{i}"]
            found.append((rule, n_rows, n_failed, n_failed <= rule.max_failed_share * n_rows))
        return found


def checked(df: DataFrame, rules: list[Rule]) -> Checked:
    """One more observation in the same pass; a condition that does not fit the columns fails here."""
    counted = Observation()
    failures = [
        F.count_if(~F.coalesce(F.expr(rule.condition), F.lit(False))).alias(f"failed_{i}") for i, rule in enumerate(rules)
    ]
    return Checked(df.observe(counted, F.count(F.lit(1)).alias("n_rows"), *failures), rules, counted)


def not_all_null(columns: list[str]) -> str:
    """The condition that some column of a row is not null."""
    quoted = ["`" + name.replace("`", "``") + "`" for name in columns]
    return f"coalesce({', '.join(f'cast({column} AS string)' for column in quoted)}) IS NOT NULL"


def result_rows(
    spark: SparkSession, entity: str, table: str, run_id: str | None, load_id: str, results: list[tuple]
) -> DataFrame:
    now = datetime.now(timezone.utc)
    rows = [
        (now, entity, table, run_id, load_id, rule.name, n_rows, n_failed, rule.max_failed_share, passed)
        for rule, n_rows, n_failed, passed in results
    ]
    return small_frame(spark, rows, RESULT_SCHEMA)


def require_passed(results: list[tuple]) -> None:
    broken = [f"{rule.name}: {n_failed} of {n_rows} rows" for rule, n_rows, n_failed, passed in results if not passed]
    if broken:
        raise RulesBroken(f"rules broken, nothing of this step was loaded: {'; '.join(broken)}")
