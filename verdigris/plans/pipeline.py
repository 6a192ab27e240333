"""Stages with fingerprints: skip what is done, refuse what differs, and a report of small aggregates."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def fingerprint(inputs: dict) -> str:
    """SHA-256 of the inputs as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(inputs, sort_keys=True, ensure_ascii=False, allow_nan=False).encode()).hexdigest()


class Stages:
    """A folder of stage results on any store. A stage with the same inputs is not run again; with others it is an error.

    A stage's mark is a table of one row, written after its result: a stage without a mark is run again.
    """

    def __init__(self, folder: str):
        self.folder = str(folder).rstrip("/")

    def run(self, name: str, inputs: dict, stage: Callable[[], DataFrame]) -> str:
        """The path of the stage's table, made now or before."""
        spark, mark, out = SparkSession.active(), fingerprint(inputs), f"{self.folder}/{name}"
        try:
            found = spark.read.schema("fingerprint string, inputs string").json(f"{out}.mark").first()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            found = None
        if found is None:
            stage().write.mode("overwrite").parquet(out)
            spark.createDataFrame([(mark, json.dumps(inputs))], "fingerprint string, inputs string").coalesce(1).write.mode("overwrite").json(f"{out}.mark")
        elif found["fingerprint"] != mark:
            raise ValueError(f"stage {name} was run with other inputs; choose another folder")
        return out


def markdown(title: str, rows: DataFrame, most: int = 200) -> str:
    """A small aggregate as a Markdown table; more than `most` rows are refused, not cut."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError("a report is for small aggregates")
    cell = lambda v: "not measured" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = [f"## {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    return "\n".join([*lines, *("| " + " | ".join(cell(v) for v in r) + " |" for r in found)]) + "\n"
