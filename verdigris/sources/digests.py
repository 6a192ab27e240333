"""Digests of files as a tree over byte ranges, and of rows while they are read or written."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of a range.
RANGE = 1 << 20


def range_digests(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(folder, file, range, bytes, digest) of all files under a path, by ranges of `size` bytes.

    Any file is read as the stretches between line feeds, in byte ranges that Spark deals out, so that none is read whole; a
    stretch counts in the range that it begins in. Where it begins follows from the lengths before it, summed by what a task
    has read, then in it. A range's digest is the exclusive or of 128-bit hashes of its stretches with their
    places, so parts of it are combined before the shuffle and in any order. Files whose names begin with _ or . are not seen.
    """
    rows = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("whole"), F.col("_metadata.file_block_start").alias("read"), F.monotonically_increasing_id().alias("at"), F.octet_length("value").cast("long").alias("n"), F.xxhash64("value").alias("h"), F.xxhash64(F.lit("second"), "value").alias("k"))
    parts = rows.groupBy("path", "read").agg(F.sum(F.col("n") + 1).alias("n"))
    before = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("path", "read", F.coalesce(F.sum("n").over(before(["path"], "read")), F.lit(0)).alias("start"))
    placed = rows.withColumn("within", F.coalesce(F.sum(F.col("n") + 1).over(before(["path", "read"], "at")), F.lit(0))).join(starts, ["path", "read"])
    place = F.col("start") + F.col("within")
    found = placed.withColumn("place", place).groupBy("path", "whole", F.floor(F.col("place") / size).cast("long").alias("range")).agg(F.sum(F.col("n") + 1).alias("bytes"), F.bit_xor(F.xxhash64("place", "h")).alias("h"), F.bit_xor(F.xxhash64("place", "k", F.lit(2))).alias("k"))
    # The file's size tells whether its last stretch ends in a line feed.
    digest = F.sha2(F.concat_ws(":", "h", "k", "bytes", "whole"), 256)
    return found.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), "range", "bytes", digest.alias("digest"))


def _joined(names: Sequence[str], *by: str) -> Column:
    """A digest over the rows of a group, in the order of their names."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*names))), lambda x: F.concat_ws("=", x[names[0]].cast("string"), x[names[1]])), "\n"), 256)


def file_digests(ranges: DataFrame) -> DataFrame:
    """(folder, file, digest): each over its ranges."""
    return ranges.groupBy("folder", "file").agg(_joined(("range", "digest")).alias("digest"))


def folder_digests(files: DataFrame) -> DataFrame:
    """(folder, digest): each over its files."""
    return files.groupBy("folder").agg(_joined(("file", "digest")).alias("digest"))


def tree_digest(spark: SparkSession, path: str, size: int = RANGE) -> str:
    """One digest of all that is under a path, whatever the path is called: over folders by their names below it."""
    folders = folder_digests(file_digests(range_digests(spark, path, size)))
    root = folders.agg(F.min("folder")).first()[0] or ""
    named = folders.select(F.substr("folder", F.lit(len(root) + 1)).alias("folder"), "digest")
    return named.agg(_joined(("folder", "digest")).alias("digest")).first()["digest"]


def changed_ranges(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file, range, change) of two states of a folder (as of range_digests): changed, added or removed ranges."""
    keys = ["file", "range"]
    both = before.select(*keys, F.col("digest").alias("a")).join(after.select(*keys, F.col("digest").alias("b")), keys, "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select(*keys, change.alias("change"))


def row_marks(columns: Sequence[str]) -> list[Column]:
    """Aggregates that tell rows apart as a multiset, in any order and any files: number and two sums of 64-bit hashes."""
    own = [F.col(f"`{c}`") for c in columns]
    wide = lambda h: F.sum(h.cast("decimal(20,0)")).cast("string")
    return [F.count(F.lit(1)).alias("rows"), wide(F.xxhash64(*own)).alias("first"), wide(F.xxhash64(F.lit("second"), *own)).alias("second")]


def marks_digest(marks: dict) -> str:
    return hashlib.sha256(f"{marks['rows']}:{marks['first'] or 0}:{marks['second'] or 0}".encode()).hexdigest()


class Watched:
    """Rows that are counted and hashed while something else reads them, in the same job."""

    def __init__(self, rows: DataFrame, records: int | None = None, digest: str | None = None, name: str = "rows"):
        self._seen, self._records, self._digest, self._name = Observation(), records, digest, name
        self.rows = rows.observe(self._seen, *row_marks(rows.columns))

    def check(self) -> str:
        """The digest of the rows that were read, after an action that read all of them; a ValueError if number or digest aren't as given."""
        marks = self._seen.get
        if self._records is not None and marks["rows"] != self._records:
            raise ValueError(f"{self._name}: {marks['rows']} records, the manifest says {self._records}")
        found = marks_digest(marks)
        if self._digest is not None and found != self._digest:
            raise ValueError(f"{self._name}: the rows differ from the manifest's")
        return found
