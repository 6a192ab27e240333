"""Grouping, deterministic splits, capped samples and disjointness."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions import text as tx
from verdigris.store import kept


def with_groups(docs: DataFrame, source: str, text_col: str, seed: int) -> DataFrame:
    """docs with text_sha256, group_id and split: a projection, no shuffle."""
    gid = tx.group_id(F.lit(source), F.col(text_col))
    return docs.withColumn("text_sha256", tx.text_hash(F.col(text_col))).withColumn("group_id", gid).withColumn("split", tx.split_of(F.col("group_id"), seed))


def first_groups(groups: DataFrame, by: str, seed: int, k: int) -> DataFrame:
    """The first k groups of each `by` in hash order, with their rank; the window keeps k rows a task before the shuffle."""
    order = Window.partitionBy(by).orderBy(tx.order_hash(F.col("group_id"), seed), "group_id")
    return groups.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def take_groups(groups: DataFrame, by: str, size: str, seed: int, cap: int, pool: int | None = None) -> DataFrame:
    """Whole groups in hash order while a `by`'s rows stay within cap (by, group_id, rank, rows); a group that doesn't fit is passed over, not the end.

    pool: only the first so many groups of each `by` are drawn from. Without it every group is considered, in rounds:
    each folds the next cap + 1 groups that still fit (no more can be taken), until none is left that fits; singletons need
    one round. A round is a top-n of each `by`, which tasks cut before the shuffle, and a walk over those few with a
    running total; what it took, and where each `by` stands, is a table in the shared folder, and the driver asks only whether any is open.
    """
    sized = groups.select(by, "group_id", F.col(size).cast("long").alias("n"), tx.order_hash(F.col("group_id"), seed).alias("key"))
    order = Window.partitionBy(by).orderBy("key", "group_id")
    kind = dict(sized.dtypes)[by]
    schema = f"{by} {kind}, group_id string, rank int, rows long, total long, last string, open boolean"
    fresh = {"total": F.lit(0).cast("long"), "base": F.lit(0)}
    if pool is not None:
        first = sized.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= pool) & (F.col("n") > 0)).withColumns(fresh)
        return first.groupBy(by).applyInArrow(_walk(by, cap, pool), schema).where(F.col("group_id").isNotNull()).select(by, "group_id", "rank", "rows")
    sized = sized.where((F.col("n") > 0) & (F.col("n") <= cap))
    out, state = None, None
    while True:
        left = sized.withColumns(fresh)
        if state is not None:
            open_ = state.select(F.col(by).alias("__by"), "total", "last", F.col("rank").alias("base"))
            left = sized.join(open_, sized[by].eqNullSafe(F.col("__by"))).where((F.col("key") > F.col("last")) & (F.col("n") <= cap - F.col("total"))).drop("__by", "last")
        batch = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap + 1)
        walked = kept(batch.groupBy(by).applyInArrow(_walk(by, cap, cap + 1), schema))
        taken = walked.where(F.col("group_id").isNotNull()).select(by, "group_id", "rank", "rows")
        out = taken if out is None else out.unionByName(taken)
        state = walked.where(F.col("group_id").isNull() & F.col("open"))
        if state.isEmpty():
            return out


def _walk(by: str, cap: int, most: int):
    """Over a `by`'s groups in their order, most at most: those that a running total takes, and a row (group_id null) with the total, the last key and rank, and whether more may follow."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rank")
        sizes, total = rows["n"].to_pylist(), rows["total"][0].as_py()
        base, end, at = rows["base"][0].as_py(), rows.num_rows - 1, []
        for k, n in enumerate(sizes):
            if total + n <= cap:
                total += n
                at.append(k)
        found = rows.take(pa.array([*at, end], pa.int64()))
        last = [False] * len(at) + [True]
        ranks = [base + r for r in found["rank"].to_pylist()]
        names = [None if x else g for g, x in zip(found["group_id"].to_pylist(), last, strict=True)]
        count = len(last)
        columns = [found[by], pa.array(names, pa.string()), pa.array(ranks, pa.int32()), found["n"], pa.array([total] * count, pa.int64()), found["key"], pa.array([len(sizes) >= most and total < cap] * count)]
        return pa.Table.from_arrays(columns, names=[by, "group_id", "rank", "rows", "total", "last", "open"])

    return run


def disjointness(records: DataFrame) -> DataFrame:
    """Groups and (source, text) pairs that are in more than one split: kind and how many, zeros included."""

    def shared(kind: str, *keys: str) -> DataFrame:
        return records.groupBy(*keys).agg(F.min("split").alias("a"), F.max("split").alias("b")).agg(F.lit(kind).alias("kind"), F.count_if(F.col("a") != F.col("b")).alias("violations"))

    return shared("group", "group_id").unionByName(shared("text", "source_family", "text_sha256"))


def sampled(rows: DataFrame, key: Column, seed: int, n: int) -> DataFrame:
    """n rows by the hash of their key: a top-n, so each task keeps n rows at most."""
    return rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256)).limit(n)
