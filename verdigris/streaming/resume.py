"""Collection of targets in batches that a restart goes on with: by session from a table, or from a stream with keyed state."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from verdigris.operators.targets import KEY, incomplete, remaining
from verdigris.sources import sinks
from verdigris.store import kept, numbered


def deduplicated(stream: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """The first row of each key; keys are kept for as long as late rows may come."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, ts: str, size: str, delay: str, *by: str) -> DataFrame:
    """Rows by tumbling window and keys, final once the watermark has passed."""
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, size), *by).agg(F.count("*").alias("n"))


def _written(score: Callable[[DataFrame], DataFrame], target: str, seen: Callable[[int, dict], None] | None = None, sums: Sequence[str] = ()) -> Callable[[DataFrame, int], None]:
    """Scores a batch into its own folder, over whatever an attempt at the same batch has left there; tells rows and sums of columns."""

    def write(batch: DataFrame, number: int) -> None:
        told = Observation()
        rows = score(batch)
        totals = [F.sum(F.col(c)).alias(c) for c in sums if c in rows.columns]
        rows.observe(told, F.count(F.lit(1)).alias("questions"), *totals).write.mode("overwrite").parquet(f"{target}/batch={number}")
        if seen:
            seen(number, {k: v or 0 for k, v in told.get.items()})

    return write


def collect_stream(stream: DataFrame, score: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Scores the first row of each key of a stream, each batch into a folder of its own.

    Keys that have come are the query's state, kept with its checkpoint (in RocksDB in sessions of local_session), so a
    batch costs what its own rows cost, however large the target is; a batch that was cut off is written anew by the next start, to the
    same folder. Rows with one key are repeats of one question; of those in one batch any may be taken.
    """
    first = stream.dropDuplicates(keys)
    return first.writeStream.foreachBatch(_written(score, target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class SessionLog(StreamingQueryListener):
    """What the batches of queries with a given name did, in order: number, when it began, rows and wall seconds."""

    def __init__(self, name: str):
        self.name, self.batches, self.ended = name, [], threading.Event()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if p.name == self.name and p.numInputRows:
            self.batches.append({"batch": p.batchId, "began": p.timestamp, "rows": p.numInputRows, "seconds": p.durationMs.get("triggerExecution", 0) / 1000})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended.set()


def _meta(spark: SparkSession, target: str) -> dict:
    try:
        return sinks.read_document(spark, f"{target}/_meta")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {"input_sha256": None, "sessions": [], "wall_seconds": 0.0, "complete": False}


def collected(spark: SparkSession, target: str) -> DataFrame | None:
    """All rows that sessions have added, with session and batch; None before the first."""
    try:
        return spark.read.option("mergeSchema", "true").parquet(target)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def collect(spark: SparkSession, wanted: DataFrame, score: Callable[[DataFrame], DataFrame], target: str, input_sha256: str, per_batch: int = 256, files_per_batch: int = 1, sums: Sequence[str] = ("layouts", "prompt_tokens")) -> dict:
    """One session: every wanted question (record_id, qid, ...) that the target lacks is scored and added; returns the target's log.

    The target's keys are read once, when the session begins; what is left is staged in files of per_batch records, whole
    records to a file, and read as a stream, files_per_batch of them a batch. Each batch adds a folder, by one job. A session
    that was killed leaves whole batches; the next one stages what they lack, so that nothing is added twice. The log
    (`_meta` beside the data) holds for each session its batches, records, questions, the sums of the given columns that score
    returns, seconds and error; and whether all wanted questions are there. Other inputs than the target's (by
    their digest) are refused. A question that is wanted twice is scored once, the row with the smallest hash.
    """
    meta = _meta(spark, target)
    if meta["input_sha256"] not in (None, input_sha256):
        raise ValueError(f"{target} was collected for other inputs; move it away to collect again")
    meta["input_sha256"] = input_sha256
    others = [c for c in wanted.columns if c not in KEY]
    once = wanted.groupBy(*KEY).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in others)) if others else F.lit(0), F.xxhash64(*(F.col(f"`{c}`") for c in wanted.columns))).alias("row"))
    once = once.select(*KEY, "row.*") if others else once.select(*KEY)
    done = collected(spark, target)
    todo = kept(remaining(once, done) if done is not None else once)
    number, work = len(meta["sessions"]), f"{target}/_work/session={len(meta['sessions'])}"
    began, batches, error = time.monotonic(), {}, None
    records = todo.select("record_id").distinct().count()
    log = SessionLog(f"collect-{uuid.uuid4().hex}")
    if records:
        staged = todo.join(numbered(todo.select("record_id").distinct(), "record_id"), "record_id").withColumn("staged", F.floor(F.col("number") / per_batch).cast("long")).drop("number")
        staged.repartition("staged").write.mode("overwrite").partitionBy("staged").parquet(f"{work}/rows")
        stream = spark.readStream.schema(todo.schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").parquet(f"{work}/rows")
        spark.streams.addListener(log)
        try:
            query = stream.writeStream.queryName(log.name).foreachBatch(_written(score, f"{target}/session={number}", batches.__setitem__, sums)).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()
            query.awaitTermination()
        except StreamingQueryException as e:
            error = e
        log.ended.wait(10)
        spark.streams.removeListener(log)
    session = {"records": records, "batches": len(batches), "seconds": round(time.monotonic() - began, 3), "log": log.batches, "failed": error is not None}
    session |= {k: sum(b.get(k, 0) for b in batches.values()) for k in ("questions", *sums)}
    there = collected(spark, target)
    meta["sessions"].append(session)
    meta["wall_seconds"] = round(meta["wall_seconds"] + session["seconds"], 3)
    meta["complete"] = not incomplete(once, there) if there is not None else records == 0
    sinks.write_document(spark, meta, f"{target}/_meta")
    if error:
        raise error
    return meta


def session_log(query: StreamingQuery) -> list[dict]:
    """A session's batches that had rows: number, when it began, rows, and wall seconds."""
    found = (p for p in query.recentProgress if p["numInputRows"])
    return [{"batch": p["batchId"], "began": p["timestamp"], "rows": p["numInputRows"], "seconds": p["durationMs"].get("triggerExecution", 0) / 1000} for p in found]
