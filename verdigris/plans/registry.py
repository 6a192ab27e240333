"""All registered queries of the engine, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from verdigris.plans import batches, corpora, documents, encoding, policies, reports, requests


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return documents.Q | requests.Q | policies.Q | encoding.Q | reports.Q | batches.Q | corpora.Q


def oracle_sql() -> dict[str, str]:
    return documents.SQL | requests.SQL | policies.SQL | encoding.SQL | reports.SQL | batches.SQL | corpora.SQL
