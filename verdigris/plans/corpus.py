"""The corpus build end to end: official panels, train pools without overlap, splits, caps, held-out panels, manifest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.functions import text as tx
from verdigris.operators import leakage, splits
from verdigris.sources import sinks


@dataclass(frozen=True)
class Limits:
    """Records of a source: drawn for the pool, kept for training, official ones for the test and the showcase panel."""

    pool: int = 1600
    train: int = 1000
    test: int = 150
    showcase: int = 50


def _identified(records: DataFrame) -> DataFrame:
    """records (source_family, row_key, state) with text hash, group and record id."""
    gid = tx.group_id(F.col("source_family"), F.col("state"))
    return records.withColumns({"text_sha256": tx.text_hash(F.col("state")), "group_id": gid})


def _capped(records: DataFrame, seed: int, cap: int) -> DataFrame:
    """Whole groups of each source in hash order, up to cap records."""
    groups = records.groupBy("source_family", "group_id").agg(F.count("*").alias("rows"))
    kept = splits.take_groups(groups, "source_family", "rows", seed, cap)
    return records.join(kept.select("source_family", "group_id"), ["source_family", "group_id"], "left_semi")


def prepare(train: DataFrame, official: DataFrame, seed: int, limits: Limits | None = None) -> DataFrame:
    """All records of the corpus with their split, from labelled train and official evaluation records.

    Official records give the showcase, then the test panel, whole groups each. Train records whose text is
    among the same source's official ones go; a pool is drawn by hash, split by group and capped for training.
    """
    limits = limits or Limits()
    official, train = _identified(official), _identified(train)
    showcase = _capped(official, seed, limits.showcase)
    rest = leakage.excluding(official, showcase, "source_family", "group_id")
    test = _capped(rest, seed + 1, limits.test)
    clean = leakage.excluding(train, official, "source_family", "text_sha256")
    pool = _capped(clean, seed + 2, limits.pool).withColumn("split", tx.split_of(F.col("group_id"), seed))
    kept = _capped(pool.where(F.col("split") == "train"), seed + 3, limits.train)
    every = showcase.withColumn("split", F.lit("showcase")).unionByName(test.withColumn("split", F.lit("test")))
    return every.unionByName(pool.where(F.col("split") != "train")).unionByName(kept)


def held_out_panel(candidates: DataFrame, corpus: DataFrame, seed: int, per_source: int) -> DataFrame:
    """Candidates of sources that were never trained on, without any text of train, dev or calibration, per_source each."""
    seen = corpus.where(F.col("split").isin("train", "dev", "calibration"))
    return _capped(leakage.excluding(_identified(candidates), seen, "text_sha256"), seed, per_source).withColumn("split", F.lit("unseen"))


def manifest(corpus: DataFrame) -> DataFrame:
    """Counts by split, source and type; the disjointness of splits is checked first."""
    broken = splits.disjointness(corpus).where(F.col("violations") > 0)
    if not broken.isEmpty():
        raise ValueError("a group or a text is in two splits")
    return sinks.manifest(corpus.withColumn("record_id", F.concat("source_family", F.lit("/"), "row_key")))
