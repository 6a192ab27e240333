"""The folder that all executors share, tables kept in it, and rows numbered in a total order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder; a local session that has neither gets a new one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="verdigris-"))
    return context.getCheckpointDir().get()


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has."""
    return f"{shared_folder(spark)}/verdigris-{uuid.uuid4().hex}"


def kept(rows: DataFrame) -> DataFrame:
    """rows as a table in the shared folder: computed once, whoever reads it and whatever executor is lost."""
    path = new_path(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


#: Low bits of monotonically_increasing_id: the row within its partition.
_WITHIN = 33


def numbered(rows: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """rows with their place, from 0 and without gaps, in the order of the columns given.

    Rows are range-partitioned and sorted, each partition counts its own, and the sums of the counts before it are added: no
    task sees more than its range, and a number for each partition reaches the driver. The order should be
    total: equal rows stay in one partition, in any order.
    """
    placed = kept(rows.repartitionByRange(*(F.col(f"`{c}`") for c in order)).sortWithinPartitions(*(F.col(f"`{c}`") for c in order)).withColumn("__place", F.monotonically_increasing_id()))
    part = F.shiftright("__place", _WITHIN)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("n")).orderBy("__part").collect()
    before, starts = 0, []
    for r in sizes:
        starts.append((r["__part"], before))
        before += r["n"]
    offsets = rows.sparkSession.createDataFrame(starts, "__part long, __start long")  # a row for each partition
    out = placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    number = F.col("__start") + F.col("__place").bitwiseAND(F.lit((1 << _WITHIN) - 1))
    return out.select(*(F.col(f"`{c}`") for c in rows.columns), number.alias(name))
