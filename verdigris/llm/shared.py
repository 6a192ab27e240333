"""What the operators of this subpackage share: tables, the shared folder, names."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shingles


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables under sf_dir, which may be a path that only Spark can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which every executor reaches; where it is unset (local runs) a new one, kept by the context."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="verdigris-"))
    return context.getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """df, written to the shared folder, so that neither a lost executor nor a second reader computes it again."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, **options: str) -> DataFrame:
    """df as a new parquet table in the shared folder: for wide rows, which checkpoint() would write uncompressed."""
    path = f"{shared_dir(df.sparkSession)}/verdigris-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch, where the session has Spark's default of 64 MB: workers of several cores share an executor.
BATCH_BYTES = 4 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def _small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches are small, unless a size was set."""
    if spark.conf.get(_BATCHES, "67108864b") == "67108864b":
        spark.conf.set(_BATCHES, str(BATCH_BYTES))


def drop_shuffles(spark: SparkSession) -> None:
    """From now on the shuffle files of an action go when it ends, not when the driver collects its garbage: an operator of many steps would keep those of all."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def _give_back() -> None:
    """What a task has kept goes: the words that it has met, Arrow's free pages and, where the C library can, its own."""
    shingles.forget()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def arrow_rows(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow(run, schema) in small batches; a worker gives back what it doesn't need any more."""
    _small_batches(df.sparkSession)

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _give_back()

    return df.mapInArrow(freed, schema)


def with_scores(docs: DataFrame, scored: Callable, schema: str, text_col: str, keep: tuple[Column, ...]) -> DataFrame:
    """The columns in keep and, for each row, the fields of schema that scored(texts) gives, batch by batch.

    Only the text crosses to Python, once: not deterministic to the optimiser, so that a filter on a
    field doesn't compute it again.
    """

    _small_batches(docs.sparkSession)

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from scored(texts)
        _give_back()

    udf = F.arrow_udf(run, schema).asNondeterministic()
    rows = docs.select(*keep, udf(F.col(f"`{text_col}`").cast("string")).alias("__vg_scored"))
    return rows.select(*(F.col(f"`{c}`") for c in rows.columns[:-1]), "__vg_scored.*")
