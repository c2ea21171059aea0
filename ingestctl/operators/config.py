"""Selecting the entities of one load from a configuration table."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def select_config(config: DataFrame, project_id: str, dept_id: str, job_id: str) -> DataFrame:
    """Entities of one (project, department, job), each whole row packed as ``config_elements``."""
    return config.where(
        (F.col("project_id") == project_id)
        & (F.col("dept_id") == dept_id)
        & (F.col("job_id") == job_id)
    ).select(F.col("Entity_Name").alias("entity_name"), F.struct("*").alias("config_elements"))


def duplicate_entities(config: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once."""
    return (
        config.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_entries"))
        .where(F.col("n_entries") > 1)
    )


def require_unique_entities(names: list[str]) -> None:
    """Refuse a load that names an entity twice; ``names`` are the entities of one job."""
    duplicates = sorted(name for name, n_entries in Counter(names).items() if n_entries > 1)
    if duplicates:
        raise ValueError(f"entities configured more than once: {duplicates}")
