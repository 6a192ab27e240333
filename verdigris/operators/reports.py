"""From what systems answer to what a report shows: evaluation rows, timings, systems side by side, manifests, sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import numeric as nm
from verdigris.functions import questions as qs


def evaluation_rows(answers: DataFrame, panel: str, system: str | Column, variant: str | Column = "canonical", *keep: str) -> DataFrame:
    """A row for each answered or refused question, in the schema that the evaluation operators read.

    answers: record_id, source_family, schema_family, question, type, names, gold, task (null: the schema's), by_key (a map of
    probabilities, null if none), said (an answer without probabilities), eligible, reason. Probabilities are laid in
    key order whatever order the system saw; a tie goes to the first key. Without a gold answer correct is null.
    system and variant are names or columns; keep: columns that come after.
    """
    told = lambda v: F.lit(v) if isinstance(v, str) else v
    rows = answers.withColumn("keys", qs.question_keys(F.col("type"), F.col("names")))
    probs = F.when(F.col("by_key").isNotNull(), F.transform("keys", lambda k: F.try_element_at("by_key", k)))
    rows = rows.withColumn("probs", probs)
    rows = rows.withColumn("pred", F.coalesce("said", F.when(F.col("probs").isNotNull(), F.get("keys", nm.argmax(F.col("probs"))))))
    level = F.when(F.col("probs").isNotNull(), nm.expected_level(F.col("probs"))).otherwise(F.expr("try_cast(pred as double)"))
    return rows.select(
        F.lit(panel).alias("panel"),
        "record_id",
        "source_family",
        F.coalesce("task", "schema_family").alias("task"),
        "schema_family",
        "question",
        "type",
        told(system).alias("system"),
        told(variant).alias("variant"),
        "keys",
        "probs",
        "pred",
        "gold",
        F.when(F.col("gold").isNotNull(), F.coalesce(F.col("pred") == F.col("gold"), F.lit(False))).alias("correct"),
        "eligible",
        "reason",
        F.when(F.col("type") == "score", level).alias("expected_level"),
        *keep,
    )


def profile(timings: DataFrame, batch: int, questions: int, *by: str) -> DataFrame:
    """Latency of single requests and throughput of batches, a row for each system.

    timings: phase (warmup, single or batch), ms, tokens, passes. Warm-ups aren't counted. A phase that was not
    measured gives nulls, which a report tells as not measured.
    """
    one = F.col("phase") == "single"
    shared = "within group (order by ms) filter (where phase = 'single')"
    out = timings.groupBy(*by).agg(
        F.count_if(one).alias("requests"),
        F.expr(f"percentile_disc(0.5) {shared}").alias("p50_ms"),
        F.expr(f"percentile_disc(0.95) {shared}").alias("p95_ms"),
        F.avg(F.when(one, F.col("ms"))).alias("mean_ms"),
        F.avg(F.when(one, F.col("tokens"))).alias("tokens_per_request"),
        F.avg(F.when(one, F.col("passes"))).alias("passes_per_request"),
        F.count_if(F.col("phase") == "batch").alias("batches"),
        F.median(F.when(F.col("phase") == "batch", F.col("ms") / 1000)).alias("median_batch_seconds"),
    )
    per_second = F.try_divide(F.lit(float(batch)), F.col("median_batch_seconds"))
    return out.withColumns({"requests_per_second": per_second, "decisions_per_second": per_second * questions})


def side_by_side(rows: DataFrame, systems: Sequence[str], base: str) -> DataFrame:
    """A row for each option of each question: each system's probability, its mark and whether any system disagrees with base.

    A system that refused or left a question has nulls and no part in a disagreement. Variants other than the canonical
    one are left out. One shuffle by question; options come out of it as an array.
    """
    chosen = rows.where((F.col("variant") == "canonical") & F.col("system").isin(*systems))
    seen = [F.max_by(F.struct("keys", "probs", "pred"), F.col("system") == s).alias(f"__vg_{i}") for i, s in enumerate(systems)]
    has = [F.max(F.col("system") == s).alias(f"__vg_has_{i}") for i, s in enumerate(systems)]
    asked = chosen.groupBy("record_id", "question").agg(F.first("keys").alias("__vg_keys"), *seen, *has)
    part = lambda i, field: F.when(F.col(f"__vg_has_{i}"), F.col(f"__vg_{i}")[field])
    own = list(systems).index(base)
    differ = F.lit(False)
    for i in range(len(systems)):
        differ |= F.coalesce(part(i, "pred") != part(own, "pred"), F.lit(False))
    cells = []
    for i, s in enumerate(systems):
        at = F.array_position(part(i, "keys"), F.col("option")) - 1
        cells += [F.get(part(i, "probs"), at.cast("int")).alias(s), F.coalesce(part(i, "pred") == F.col("option"), F.lit(False)).alias(f"{s}_top")]
    return asked.withColumn("option", F.explode("__vg_keys")).select("record_id", "question", "option", *cells, differ.alias("disagreement"))


def manifest_counts(questions: DataFrame) -> DataFrame:
    """By split: records and questions in all, by source, by schema and by type, in one pass. questions: a row a question."""
    dims = ["source_family", "schema_family", "type"]
    out = questions.groupingSets([["split"], *(["split", d] for d in dims)], "split", *dims).agg(F.grouping_id().alias("g"), F.count("*").alias("questions"), F.count_distinct("record_id").alias("records"))
    level = F.when(F.col("g") == 7, "all").when(F.col("g") == 3, "source").when(F.col("g") == 5, "schema").otherwise("type")
    return out.select("split", level.alias("level"), F.coalesce(*dims).alias("value"), "records", "questions")


def dev_loss(rows: DataFrame) -> DataFrame:
    """The mean loss of the gold answers of development questions (logits, label), by which a checkpoint is selected."""
    return rows.where((F.col("split") == "dev") & F.col("label").isNotNull()).agg(F.count("*").alias("questions"), F.avg(nm.nll_at(F.col("logits"), F.col("label"))).alias("nll"))


def write_evaluation(folder: str, rows: DataFrame, tables: Mapping[str, DataFrame]) -> None:
    """The rows as Parquet by system, and each small table as JSON Lines, under a folder on any store.

    A folder that has an evaluation already is refused by the first write: nothing is replaced.
    """
    rows.write.mode("error").partitionBy("system").parquet(f"{folder}/rows")
    for name, table in tables.items():
        table.coalesce(1).write.mode("error").option("ignoreNullFields", "false").json(f"{folder}/{name}")


def read_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that write_evaluation has written; a filter on system reads its folders only."""
    return spark.read.parquet(f"{folder}/rows")
