"""Batches under a budget of padded tokens, and what requests with shared beginnings need not compute again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.store import kept, numbered

#: Lengths that rows may have: what reaches the driver is a count for each. More are refused.
LENGTHS = 1 << 20
#: Tokens by which requests are dealt to ranges; within a range all count.
DEALT_BY = 128


def batch_plan(counts: list[tuple[int, int]], budget: int) -> list[tuple[int, int, int, int, int, int]]:
    """Of (length, rows) by rising length: (length, first row, rows that go on with the open batch, its number, the next batch's number, rows of a batch).

    The greedy rule fills a batch in order of length while its rows, padded to the newest one, stay within the
    budget; a row over the budget is a batch by itself. Among rows of one length that is arithmetic, so the fold has a
    step for each length, not for each row.
    """
    out, first, batch, filled = [], 0, -1, 0
    for length, rows in counts:
        size = max(1, budget // max(length, 1))
        more = min(rows, max(0, size - filled)) if filled else 0
        left = rows - more
        out.append((length, first, more, batch, batch + 1, size))
        if left:
            batch += -(-left // size)
            filled = left - (left - 1) // size * size
        else:
            filled += more
        first += rows
    return out


def budgeted(rows: DataFrame, length: str, budget: int, *ties: str) -> DataFrame:
    """rows with `place` in the order of length (then of ties, which make it total) and `batch`, from 0.

    The order is cut in ranges, numbered by counts of the ranges before; the batches follow from the number of
    rows of each length. Null lengths count as 0, which takes no room: such rows share batches of `budget` rows.
    """
    if budget < 1:
        raise ValueError("a budget of one token at least")
    spark = rows.sparkSession
    known = numbered(rows.withColumn("__length", F.coalesce(F.col(f"`{length}`").cast("long"), F.lit(0).cast("long"))), "__length", *ties, name="place")
    counts = known.groupBy("__length").agg(F.count("*").alias("n")).orderBy("__length").limit(LENGTHS + 1).collect()
    if len(counts) > LENGTHS:
        raise ValueError(f"more than {LENGTHS} lengths")
    steps = spark.createDataFrame(batch_plan([(r["__length"], r["n"]) for r in counts], budget), "__length long, __first long, __more long, __open long, __next long, __size long")
    at = F.col("place") - F.col("__first")
    batch = F.when(at < F.col("__more"), F.col("__open")).otherwise(F.col("__next") + F.floor((at - F.col("__more")) / F.col("__size")))
    return known.join(F.broadcast(steps), "__length").select(*(F.col(f"`{c}`") for c in rows.columns), "place", batch.cast("long").alias("batch"))


def batch_report(batched: DataFrame, length: str) -> DataFrame:
    """By batch: rows, tokens, longest, padded (rows times longest) and waste (padded less tokens)."""
    n = F.coalesce(F.col(length).cast("long"), F.lit(0).cast("long"))
    found = batched.groupBy("batch").agg(F.count("*").alias("rows"), F.sum(n).alias("tokens"), F.max(n).alias("longest"))
    full = F.col("rows") * F.col("longest")
    return found.select("batch", "rows", "tokens", "longest", full.alias("padded"), (full - F.col("tokens")).alias("waste"))


def common_prefix(a: Column, b: Column) -> Column:
    """How many elements two arrays have in common at their beginnings."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differs > 0, differs - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (id, x, y, part, tokens) to (id, x, y, part, n, reused, source, edge): each row's tokens in common with the row before it.

    A range's first and last row also come with their tokens (edge 0 and 1), as ranges meet there.
    """
    names = ["id", "x", "y", "part", "n", "reused", "source", "edge", "tokens"]
    last = None

    def edge(row: pa.RecordBatch, kind: int) -> pa.RecordBatch:
        none = pa.nulls(1, pa.int32())
        return pa.RecordBatch.from_arrays([*row.columns[:4], none, none, pa.nulls(1, row.schema.field(0).type), pa.array([kind], pa.int32()), row.column(4)], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        if last is None:
            yield edge(batch.slice(0, 1), 0)
        own = pa.Table.from_batches([last, batch] if last is not None else [batch]).combine_chunks()
        skip = int(last is not None)
        lists = own.column(4).chunk(0)
        at, flat = lists.offsets.to_numpy(), lists.values
        reused = np.zeros(own.num_rows, np.int32)
        for k in range(1, own.num_rows):
            m = min(at[k] - at[k - 1], at[k + 1] - at[k])
            same = pc.equal(flat.slice(at[k - 1], m), flat.slice(at[k], m))
            found = pc.index(same, False).as_py()
            reused[k] = m if found < 0 else found
        ids = own.column(0).chunk(0)
        source = pa.concat_arrays([pa.nulls(1, ids.type), ids.slice(0, len(ids) - 1)])
        source = pc.if_else(pa.array(reused > 0), source, pa.nulls(len(ids), ids.type))
        rows = pa.Table.from_arrays([*own.columns[:4], pa.array(np.diff(at).astype(np.int32)), pa.array(reused), source, pa.nulls(own.num_rows, pa.int32()), pa.nulls(own.num_rows, lists.type)], names=names)
        yield from rows.slice(skip).to_batches()
        last = batch.slice(batch.num_rows - 1, 1)
    if last is not None:
        yield edge(last, 1)


def prefix_plan(rows: DataFrame, id_col: str, tokens_col: str) -> DataFrame:
    """For every row: id_col, n (its tokens), reused, computed and source, if rows are computed in the order of their tokens.

    Sorted so, a row shares its longest beginning with the row before it: `reused` tokens are taken from what was computed
    for that row (`source`), the others are computed, each beginning once. Equal rows are one: the one with
    the smallest id is computed, its copies reuse all of it (and name it as their source). Ranges are dealt by the first
    DEALT_BY tokens and sorted by all; where two meet, the edge rows are compared. Null tokens count as none;
    rows with a null id are computed by themselves and belong to no tree.
    """
    spark = rows.sparkSession
    cut = rows.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{tokens_col}`"), F.array()).alias("tokens"))
    cut = cut.withColumns({"x": F.xxhash64("tokens"), "y": F.xxhash64(F.lit("second"), "tokens")})
    alone = cut.where(F.col("id").isNull())
    named = cut.where(F.col("id").isNotNull())
    classes = named.groupBy("x", "y").agg(F.min("id").alias("id"), F.first("tokens").alias("tokens"))
    dealt = classes.repartitionByRange(F.slice("tokens", 1, DEALT_BY)).sortWithinPartitions("tokens").select("id", "x", "y", F.spark_partition_id().alias("part"), "tokens")
    id_type, list_type = dealt.schema["id"].dataType.simpleString(), dealt.schema["tokens"].dataType.simpleString()
    found = kept(dealt.mapInArrow(_shared, f"id {id_type}, x long, y long, part int, n int, reused int, source {id_type}, edge int, tokens {list_type}"))
    edges = found.where(F.col("edge").isNotNull())
    parts = sorted(r["part"] for r in edges.where("edge = 0").select("part").collect())  # a number for each range
    met = spark.createDataFrame(list(zip(parts[1:], parts[:-1], strict=True)), "part int, before int")
    firsts = edges.where("edge = 0").select("part", "id", F.col("tokens").alias("a")).join(met, "part")
    lasts = edges.where("edge = 1").select(F.col("part").alias("before"), F.col("id").alias("__source"), F.col("tokens").alias("b"))
    starts = firsts.join(lasts, "before").select("id", "__source", common_prefix(F.col("a"), F.col("b")).alias("__reused"))
    plan = found.where(F.col("edge").isNull()).join(F.broadcast(starts), "id", "left")  # a row for each range
    reused = F.coalesce("__reused", "reused")
    plan = plan.select("x", "y", F.col("id").alias("leader"), "n", reused.alias("reused"), F.when(reused > 0, F.coalesce("__source", "source")).alias("source"))
    out = named.select("id", "x", "y").join(plan, ["x", "y"])
    first = F.col("id") == F.col("leader")
    mine = out.select(F.col("id").alias(id_col), "n", F.when(first, F.col("reused")).otherwise(F.col("n")).alias("reused"), F.when(first, F.col("source")).otherwise(F.col("leader")).alias("source"))
    lone = alone.select(F.col("id").alias(id_col), F.size("tokens").alias("n"), F.lit(0).alias("reused"), F.lit(None).cast(id_type).alias("source"))
    return mine.unionByName(lone).select(id_col, "n", "reused", (F.col("n") - F.col("reused")).alias("computed"), "source")
