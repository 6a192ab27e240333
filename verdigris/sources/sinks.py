"""Sinks: JSON Lines, appended targets, manifests."""

from __future__ import annotations

import hashlib
import inspect
import json
from collections.abc import Mapping, Sequence
from pathlib import Path
from types import ModuleType

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from verdigris.sources import digests


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.option("ignoreNullFields", "false").json(path)


def append_targets(rows: DataFrame, path: str) -> None:
    """Rows added to a target table; a failed job adds none."""
    rows.write.mode("append").parquet(path)


def manifest(records: DataFrame) -> DataFrame:
    """Counts of prepared records by split, source, type and schema."""
    return records.groupBy("split", "source_family", "type").agg(F.count("*").alias("questions"), F.count_distinct("record_id").alias("records"))


def write_json(value: object, path: str) -> None:
    """A small driver-side document; NaN is refused."""
    Path(path).write_text(json.dumps(value, ensure_ascii=False, allow_nan=False, indent=1) + "\n", encoding="utf-8")


def write_document(spark: SparkSession, value: object, path: str) -> None:
    """A small document as one line of JSON in a folder of any store that Spark writes to; NaN is refused."""
    spark.createDataFrame([(json.dumps(value, ensure_ascii=False, allow_nan=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str) -> object:
    return json.loads(spark.read.text(path).first()["value"])


def code_digests(*modules: ModuleType) -> dict[str, str]:
    """The digest of each module's source."""
    return {m.__name__: hashlib.sha256(inspect.getsource(m).encode()).hexdigest() for m in modules}


def write_counted(records: DataFrame, path: str, levels: Mapping[str, Sequence[str]], types: Sequence[str] = ("noul", "choice", "score"), modules: Sequence[ModuleType] = ()) -> dict:
    """Prepared records (split, the columns of levels, questions: an array of structs with a type) as parquet by split; returns their manifest.

    The manifest is counted by the job that writes: for each split its records, questions, a digest of its rows and the
    records of each level, and questions by type. levels names the values of each column, `split` among them; a
    record with another value, or a question of another type, is a ValueError, after which the folder holds no manifest.
    The manifest is written beside the data as `_manifest`, with the digests of the modules' code.
    """
    splits = list(levels["split"])
    asked = lambda kind: F.size(F.filter("questions", lambda q: q["type"] == kind)).cast("long")
    none = F.lit(0).cast("long")
    total = lambda when, n: F.sum(F.when(when, n).otherwise(none))
    metrics: dict[str, Column] = {}
    known = F.lit(True)
    for column, values in levels.items():
        known &= F.coalesce(F.col(column).isin(list(values)), F.lit(False))
    metrics["strange"] = F.count_if(~known | F.exists(F.coalesce("questions", F.array().cast(records.schema["questions"].dataType)), lambda q: ~F.coalesce(q["type"].isin(list(types)), F.lit(False))))
    columns = [c for c in records.columns if c != "split"]
    hashes = [F.xxhash64(*(F.col(f"`{c}`") for c in columns)), F.xxhash64(F.lit("second"), *(F.col(f"`{c}`") for c in columns))]
    for i, split in enumerate(splits):
        own = F.col("split") == split
        metrics[f"{i}"] = F.count_if(own)
        for k, h in enumerate(hashes):
            metrics[f"{i}:mark{k}"] = F.sum(F.when(own, h.cast("decimal(20,0)"))).cast("string")
        for t in types:
            metrics[f"{i}:type:{t}"] = total(own, asked(t))
        for column, values in levels.items():
            if column != "split":
                for j, v in enumerate(values):
                    metrics[f"{i}:{column}:{j}"] = F.count_if(own & (F.col(column) == v))
    seen = Observation()
    names = list(metrics)
    observed = records.observe(seen, *(metrics[n].alias(f"m{k}") for k, n in enumerate(names)))
    observed.write.partitionBy("split").parquet(path)
    found = {n: seen.get[f"m{k}"] for k, n in enumerate(names)}
    if found["strange"]:
        raise ValueError(f"{path}: {found['strange']} records with a value that is no level")
    manifest: dict = {"files": {}, "counts": {}, "code_sha256": code_digests(*modules)}
    for i, split in enumerate(splits):
        by_type = {t: found[f"{i}:type:{t}"] or 0 for t in types}
        marks = {"rows": found[f"{i}"], "first": found[f"{i}:mark0"], "second": found[f"{i}:mark1"]}
        manifest["files"][split] = {"records": found[f"{i}"], "questions": sum(by_type.values()), "sha256": digests.marks_digest(marks)}
        by = {column: {v: found[f"{i}:{column}:{j}"] for j, v in enumerate(values) if found[f"{i}:{column}:{j}"]} for column, values in levels.items() if column != "split"}
        manifest["counts"][split] = by | {"questions_by_type": {t: n for t, n in by_type.items() if n}}
    write_document(records.sparkSession, manifest, f"{path}/_manifest")
    return manifest


def read_counted(spark: SparkSession, path: str, split: str) -> digests.Watched:
    """One split of what write_counted has written, checked against the manifest in the scan that reads it."""
    entry = read_document(spark, f"{path}/_manifest")["files"][split]
    rows = spark.read.parquet(path).where(F.col("split") == split)
    return digests.Watched(rows.drop("split"), entry["records"], entry["sha256"], f"{path}, {split}")
