"""Exclusion of training rows that share texts with evaluation data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def excluding(rows: DataFrame, forbidden: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys are not among the forbidden ones; the planner picks the join by the sides' sizes."""
    return rows.join(forbidden.select(*keys).distinct(), list(keys), "left_anti")


def colliding(rows: DataFrame, id_col: str, hashes_col: str, forbidden: DataFrame) -> DataFrame:
    """Ids of rows of which any hash is among forbidden (hash)."""
    return rows.select(id_col, F.explode(hashes_col).alias("hash")).join(forbidden.select("hash").distinct(), "hash", "left_semi").select(id_col).distinct()


def exclusion_report(rows: DataFrame, by: str, reason: str) -> DataFrame:
    """For each `by`: rows read, kept (reason null) and dropped by reason."""
    return rows.groupBy(by).agg(F.count("*").alias("read"), F.count_if(F.col(reason).isNull()).alias("kept"), F.count_if(F.col(reason) == "overlap").alias("dropped_overlap"), F.count_if(F.col(reason) == "context").alias("dropped_context"))
