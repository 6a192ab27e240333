"""Temperature calibration by grid search, and its summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.functions import numeric as nm


def grid_losses(rows: DataFrame, grid: list[float]) -> DataFrame:
    """(t_index, temperature, loss): the mean negative log-likelihood of rows (logits, label) at each temperature.

    Each row gives an array of its losses, and the sums go over array positions: the grid multiplies columns
    of one task, not rows of the shuffle.
    """
    losses = rows.select(F.posexplode(F.transform(F.array(*(F.lit(t) for t in grid)), lambda t: nm.nll_at(F.col("logits"), F.col("label"), t))).alias("t_index", "loss"))
    means = losses.groupBy("t_index").agg(F.avg("loss").alias("loss"))
    return means.select("t_index", F.element_at(F.array(*(F.lit(t) for t in grid)), F.col("t_index") + 1).alias("temperature"), "loss")


def best_temperature(losses: DataFrame) -> DataFrame:
    """The first temperature of the least loss, and whether it is at an end of the grid."""
    best = losses.agg(F.min(F.struct("loss", "t_index", "temperature")).alias("b"), F.max("t_index").alias("last"))
    return best.select("b.t_index", "b.temperature", "b.loss", ((F.col("b.t_index") == 0) | (F.col("b.t_index") == F.col("last"))).alias("grid_edge"))


def summary(rows: DataFrame, temperature: DataFrame) -> DataFrame:
    """Questions, accuracy and likelihood, raw and calibrated: overall, by type and by source. rows: logits, label, type, source_family."""
    t = temperature.select("temperature").scalar()
    scored = rows.withColumn("t", t).select(
        "type",
        "source_family",
        (nm.argmax(F.col("logits")) == F.col("label")).cast("double").alias("right"),
        nm.nll_at(F.col("logits"), F.col("label")).alias("raw"),
        nm.nll_at(F.col("logits"), F.col("label"), F.col("t")).alias("calibrated"),
    )
    out = scored.groupingSets([[], ["type"], ["source_family"]], "type", "source_family").agg(
        F.grouping_id().alias("g"), F.count("*").alias("questions"), F.avg("right").alias("accuracy"), F.avg("raw").alias("nll_raw"), F.avg("calibrated").alias("nll_calibrated")
    )
    level = F.when(F.col("g") == 3, "overall").when(F.col("g") == 1, "type").otherwise("source_family")
    return out.select(level.alias("level"), F.coalesce("type", "source_family").alias("value"), "questions", "accuracy", "nll_raw", "nll_calibrated")
