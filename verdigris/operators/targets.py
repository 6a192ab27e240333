"""Teacher targets: layouts, collection that can be resumed, last write wins, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.functions import questions as qs

KEY = ["record_id", "qid"]


def exploded_layouts(questions: DataFrame, cyclic: bool = True) -> DataFrame:
    """A row for each layout of each eligible question (record_id, qid, type, names): layout, perm, labels."""
    k = F.when(F.col("type") == "noul", 2).otherwise(F.size("names"))
    rows = questions.withColumn("k", k).where(qs.ineligible_reason(F.col("type"), F.col("k")).isNull())
    return rows.select(*KEY, "type", "names", "k", F.posexplode(qs.layouts(F.col("type"), F.col("k"), cyclic)).alias("layout", "perm"))


def remaining(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """Rows of wanted whose (record_id, qid) hasn't been collected."""
    return wanted.join(done.select(*KEY).distinct(), KEY, "left_anti")


def latest(targets: DataFrame, ordinal: str) -> DataFrame:
    """The last row of each (record_id, qid): an aggregate, so repeats collapse before the shuffle."""
    others = [c for c in targets.columns if c not in KEY]
    best = targets.groupBy(*KEY).agg(F.max_by(F.struct(*others), F.col(ordinal)).alias("row"))
    return best.select(*KEY, "row.*")


def incomplete(wanted: DataFrame, done: DataFrame) -> bool:
    """Whether any wanted question has no target."""
    return not remaining(wanted, done).isEmpty()


def summary(targets: DataFrame) -> DataFrame:
    """By source (the record id's prefix): eligible and not, layouts and tokens."""
    return targets.groupBy(F.split_part("record_id", F.lit("/"), F.lit(1)).alias("source")).agg(
        F.count_if("eligible").alias("eligible"),
        F.count_if(~F.col("eligible")).alias("ineligible"),
        F.sum(F.coalesce("layouts", F.lit(0))).cast("long").alias("layouts"),
        F.sum(F.coalesce("prompt_tokens", F.lit(0))).cast("long").alias("prompt_tokens"),
    )


def costs(targets: DataFrame) -> DataFrame:
    """What all targets took: targets, eligible, layouts and prompt tokens; nulls count as none."""
    whole = lambda c: F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(0))), F.lit(0)).cast("long").alias(c)
    return targets.agg(F.count("*").alias("targets"), F.count_if("eligible").alias("eligible"), whole("layouts"), whole("prompt_tokens"))


def target_path(root: str, revision: str, digits: int = 12) -> str:
    """Where the targets of a teacher's revision are kept under root."""
    return f"{root.rstrip('/')}/{revision[:digits]}/targets"
