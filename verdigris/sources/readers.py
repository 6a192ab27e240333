"""Sources: registered tables, JSON Lines, panels and verified splits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.sources import digests


@dataclass(frozen=True)
class Source:
    """Where a source's rows are and which function makes records of them."""

    name: str
    path: str
    text_field: str
    converter: Callable[[DataFrame], DataFrame]
    role: str = "trainable"  # or unseen, extended


class Registry:
    """Sources by name."""

    def __init__(self) -> None:
        self._sources: dict[str, Source] = {}

    def add(self, source: Source) -> None:
        if source.name in self._sources:
            raise ValueError(f"{source.name} is registered already")
        self._sources[source.name] = source

    def records(self, spark: SparkSession, role: str | None = None) -> DataFrame:
        """Records of all sources of a role, one plan."""
        chosen = [s for s in self._sources.values() if role in (None, s.role)]
        if not chosen:
            raise ValueError("no source of this role")
        out = None
        for s in chosen:
            rows = s.converter(spark.read.parquet(s.path))
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON Lines: by a schema, or as (line) with the raw text where key order counts. Blank lines are skipped."""
    if schema:
        return spark.read.schema(schema).json(path)
    return spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("line"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of text files: each line with its number in its file, from 0, blank ones counted.

    Lines end in \\n, \\r\\n or \\r. Files are read by byte ranges in any number of tasks: a task counts the lines of its
    ranges, and a line's number is the lines of the ranges before it in the file plus those before it in its own. A number
    for each range is broadcast, so lines aren't shuffled.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("at"), "value")
    ranges = rows.groupBy("file", "range").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranges.select("file", "range", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return rows.join(F.broadcast(starts), ["file", "range"]).select("file", (F.col("at") + F.col("shift")).alias("line"), "value")


def folder_digest(spark: SparkSession, path: str) -> str:
    """A digest over all files under a path, by byte ranges, files and folders; contents stay on the executors."""
    return digests.tree_digest(spark, path)


def watched(spark: SparkSession, path: str, records: int, digest: str) -> digests.Watched:
    """A stored split that is checked against its manifest's entry in the scan that reads it: use its rows, then check()."""
    return digests.Watched(spark.read.parquet(path), records, digest, path)


def verified(spark: SparkSession, path: str, records: int, digest: str | None = None) -> DataFrame:
    """A stored split whose row count (and the digest of its files) must be those of its manifest; read here once for that."""
    rows = spark.read.parquet(path)
    found = rows.count()
    if found != records:
        raise ValueError(f"{path}: {found} records, the manifest says {records}")
    if digest and folder_digest(spark, path) != digest:
        raise ValueError(f"{path}: the files differ from the manifest's")
    return rows


def panel(rows: DataFrame, ordinal: str, limit: int | None = None) -> DataFrame:
    """An evaluation panel in its order; the first `limit` records if given (a feature of panels)."""
    ordered = rows.orderBy(ordinal)
    return ordered.limit(limit) if limit else ordered
