"""Evaluation analytics over rows (system, variant, record_id, question, type, keys, probs, pred, gold, eligible, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions import numeric as nm


def metric_columns() -> list[Column]:
    """Aggregates of one group. Ineligible questions are counted, never scored; unanswered ones count as wrong."""
    labelled = F.col("gold").isNotNull()
    scored = labelled & F.col("eligible")
    answered = scored & F.col("pred").isNotNull()
    right = (F.col("pred") == F.col("gold")).cast("double")
    label = (F.array_position("keys", F.col("gold")) - 1).cast("int")
    prob = scored & F.col("probs").isNotNull()
    level = answered & (F.col("type") == "score")
    gold_level = F.expr("try_cast(gold as int)")
    return [
        F.count_if(scored).alias("n"),
        F.count_if(labelled).alias("n_total"),
        F.count_if(answered).alias("answered"),
        F.count_if(labelled & ~F.col("eligible")).alias("ineligible"),
        F.count_if(scored & F.col("pred").isNull()).alias("unanswered"),
        F.avg(F.when(scored, F.coalesce(right, F.lit(0.0)))).alias("accuracy"),
        F.avg(F.when(answered, right)).alias("accuracy_answered"),
        F.avg(F.when(prob, nm.nll(F.col("probs"), label))).alias("nll"),
        F.avg(F.when(prob, nm.brier(F.col("probs"), label))).alias("brier"),
        F.avg(F.when(level, F.abs(F.col("expected_level") - gold_level))).alias("score_mae_expected"),
        F.avg(F.when(level, F.abs(F.expr("try_cast(pred as int)") - gold_level).cast("double"))).alias("score_mae_modal"),
        F.count_if(level).alias("score_n"),
    ]


def metrics(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(*metric_columns())


def panel_metrics(rows: DataFrame, dims: tuple[str, ...] = ("task", "source_family", "type")) -> DataFrame:
    """Metrics by system, and by system and each of dims, in one pass; `level` names the grouping."""
    sets = [["system"], *(["system", d] for d in dims)]
    out = rows.groupingSets(sets, "system", *dims).agg(F.grouping_id().alias("__vg_set"), *metric_columns())
    size = len(dims)
    names = F.lit("overall")
    for i, d in enumerate(dims):
        bit = 1 << (size - 1 - i)
        names = F.when(F.col("__vg_set").bitwiseAND(F.lit(bit)) == 0, d).otherwise(names)
    return out.withColumn("level", names).withColumn("value", F.coalesce(*dims)).drop("__vg_set", *dims)


def agreement(rows: DataFrame, one: str, other: str) -> DataFrame:
    """How often two systems, on questions that both answered, say the same."""
    keys = ["record_id", "question"]
    a = rows.where((F.col("system") == one) & F.col("pred").isNotNull()).select(*keys, F.col("pred").alias("a"))
    b = rows.where((F.col("system") == other) & F.col("pred").isNotNull()).select(*keys, F.col("pred").alias("b"))
    return a.join(b, keys).agg(F.count("*").alias("n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("agreement"))


def like_for_like(rows: DataFrame, parent: str) -> DataFrame:
    """Metrics of every system on the questions that the parent was eligible for."""
    keys = ["record_id", "question"]
    answerable = rows.where((F.col("system") == parent) & F.col("eligible")).select(*keys).distinct()
    return metrics(rows.join(answerable, keys, "left_semi"), "system")


def order_sensitivity(rows: DataFrame) -> DataFrame:
    """For each system: flips of the answer and changes of probability between reordered and canonical choice questions."""
    keys = ["system", "record_id", "question"]
    usable = rows.where((F.col("type") == "choice") & F.col("probs").isNotNull())
    base = usable.where(F.col("variant") == "canonical").select(*keys, F.col("pred").alias("base_pred"), F.map_from_arrays("keys", "probs").alias("base"))
    other = usable.where(F.col("variant") != "canonical").join(base, keys)
    change = F.array_max(F.zip_with("keys", "probs", lambda k, p: F.abs(p - F.try_element_at("base", k))))
    other = other.withColumn("change", change)
    return other.groupBy("system").agg(F.count("*").alias("n"), F.avg((F.col("pred") != F.col("base_pred")).cast("double")).alias("flip_rate"), F.avg("change").alias("mean_max_dp"), F.max("change").alias("max_dp"))


def generation_stats(rows: DataFrame, ordinal: str) -> DataFrame:
    """For each generating system: tokens, truncated and unparsed responses; a request's first row counts."""
    first = Window.partitionBy("system", "panel", "record_id").orderBy(ordinal)
    requests = rows.withColumn("__vg_rank", F.row_number().over(first)).where("__vg_rank = 1")
    stats = requests.groupBy("system").agg(
        F.count("*").alias("requests"),
        F.avg("generated_tokens").alias("tokens_mean"),
        F.median("generated_tokens").alias("tokens_median"),
        F.max("generated_tokens").alias("tokens_max"),
        F.count_if("truncated").alias("truncated"),
        F.count_if(~F.col("parse_ok")).alias("no_json"),
    )
    open_questions = rows.groupBy("system").agg(F.count_if(F.col("pred").isNull()).alias("questions_unanswered"))
    return stats.join(open_questions, "system")


def percentiles(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Nearest-rank p50 and p95, mean and count."""
    return rows.groupBy(*by).agg(F.expr(f"percentile_disc(0.5) within group (order by {value})").alias("p50"), F.expr(f"percentile_disc(0.95) within group (order by {value})").alias("p95"), F.avg(value).alias("mean"), F.count(value).alias("n"))


def compared(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Two systems' probabilities of the same rows: largest change, flips of the answer and the margin at a flip."""
    both = a.select(key, F.col("probs").alias("p")).join(b.select(key, F.col("probs").alias("q")), key)
    change = F.array_max(F.zip_with("p", "q", lambda x, y: F.abs(x - y)))
    top = F.slice(F.sort_array("p", False), 1, 2)
    both = both.select(change.alias("change"), (nm.argmax(F.col("p")) != nm.argmax(F.col("q"))).alias("flip"), (top[0] - F.get(top, F.lit(1))).alias("margin"))
    return both.agg(F.count("*").alias("n"), F.max("change").alias("max_dp"), F.count_if("flip").alias("flips"), F.max(F.when(F.col("flip"), F.col("margin"))).alias("max_flip_margin"))
