"""Session helpers shared by the benchmark, the tests and the streaming code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session with the settings that the queries expect everywhere: UTC and AQE."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("verdigris")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .config("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: Bytes of an Arrow batch, where the session has Spark's default of 64 MB: workers of several cores share an executor.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches are small, unless a size was set."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, "67108864b") == "67108864b":
        spark.conf.set(name, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables under sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
