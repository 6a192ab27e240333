"""Sharding by position on a Hilbert curve over metadata dimensions (DataFrame operations only).

Every dimension is cut at its own quantiles into 2**bits codes, the codes of a row give its index on the
curve, rows are put in order by (index, id, size, checksum), and the order is cut into runs of equal row
counts. Neighbours on the curve have close values in every dimension, so the minimum and maximum that a
shard keeps of each dimension (shard_manifest) let a reader skip most shards whichever dimension it filters.

The quantiles are 2**bits - 1 values a dimension, strings whole, the only thing that reaches the driver besides the plan.
A hot value of a dimension can't load one task: the range partitioning orders by the index and then by the
id, so that a cell of the curve is split wherever it is large.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import checkpoint

ACCURACY = 10_000


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 16."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def _position(df: DataFrame, name: str) -> Column:
    """What a dimension is cut by: numbers and times as a double that keeps their order, anything else as a string."""
    kind = df.schema[name].dataType
    column = F.col(f"`{name}`")
    if isinstance(kind, T.NumericType):
        return column.cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("double")
    return column.cast("string")


def string_splitters(values: DataFrame, cells: int) -> list[str]:
    """The values at the cells' quantiles of a column of strings, cells - 1 at most, whole and exact; one on several is repeated.

    Repeats are counted first, the distinct values are put in order by a range shuffle, counts are summed along
    it (within a partition, then over the partitions' totals), and the values that a quantile falls on return.
    """
    name = F.col(values.columns[0])
    counts = values.where(name.isNotNull()).groupBy(name.alias("value")).agg(F.count("*").alias("n"))
    laid = checkpoint(counts.repartitionByRange("value").sortWithinPartitions("value").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    totals = laid.groupBy(part.alias("part")).agg(F.sum("n").alias("part_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("part_n").over(before), F.lit(0)).alias("start"), F.sum("part_n").over(Window.partitionBy()).alias("total"))
    upto = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    reached = laid.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("end", F.col("start") + F.sum("n").over(upto))
    hits = F.expr(f"least(end * {cells}L, total * {cells}L - 1) div total - ((end - n) * {cells}L) div total")
    return sorted(r["value"] for r in reached.select("value", hits.alias("hits")).where("hits > 0").collect() for _ in range(r["hits"]))


def hilbert_index(codes: Sequence[Column], bits: int) -> Column:
    """The index on the Hilbert curve of a cell, given as one int column of `bits` bits for each dimension.

    Undoes the excess work of the axes from the highest bit down (a fold over the pairs of bit and axis),
    takes the Gray code across the axes and interleaves their bits. bits times dimensions is 62 at most.
    """
    n = len(codes)
    if bits * n > 62:
        raise ValueError("bits times dimensions is over 62")
    steps = [(1 << b, i) for b in range(bits - 1, 0, -1) for i in range(n)]
    axes = F.array(*(c.cast("long") for c in codes))
    if steps:
        moves = F.array(*(F.struct(F.lit(q).cast("long").alias("q"), F.lit(i).alias("i")) for q, i in steps))

        def move(x: Column, s: Column) -> Column:
            first, own, low = x[0], F.get(x, s["i"]), s["q"] - 1
            hit = own.bitwiseAND(s["q"]) != 0
            swap = first.bitwiseXOR(own).bitwiseAND(low)
            return F.transform(
                x,
                lambda v, j: F.when(hit, F.when(j == 0, v.bitwiseXOR(low)).otherwise(v))
                .when(s["i"] == 0, v)
                .when((j == 0) | (j == s["i"]), v.bitwiseXOR(swap))
                .otherwise(v),
            )

        axes = F.aggregate(moves, axes, move)
    return _index_of(axes, n, bits)


def _index_of(axes: Column, n: int, bits: int) -> Column:
    """Gray code and interleaving of the folded axes; one-element transforms name what is used more than once."""

    def gray(x: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.lit(n)),
            lambda i: F.aggregate(F.slice(x, F.lit(1), i), F.lit(0).cast("long"), lambda a, v: a.bitwiseXOR(v)),
        )

    def flat(x: Column) -> Column:
        zero = F.lit(0).cast("long")
        flips = [F.when(x[n - 1].bitwiseAND(F.lit(1 << b).cast("long")) != 0, F.lit((1 << b) - 1).cast("long")).otherwise(zero) for b in range(1, bits)]
        flip = reduce(lambda a, b: a.bitwiseXOR(b), flips, zero)
        return F.transform(F.array(flip), lambda f: F.transform(x, lambda v: v.bitwiseXOR(f)))[0]

    def woven(x: Column) -> Column:
        one = F.lit(1).cast("long")
        return reduce(add, [F.shiftleft(F.shiftright(x[i], b).bitwiseAND(one), b * n + n - 1 - i) for b in range(bits) for i in range(n)])

    return F.transform(F.transform(F.transform(F.array(axes), gray), flat), woven)[0]


def quantised(df: DataFrame, dims: Sequence[str], bits: int, splitters: dict[str, list[float] | list[str]] | None = None) -> tuple[DataFrame, list[str], dict[str, list[float] | list[str]]]:
    """df with a code from 0 to 2**bits - 1 for each dimension, the codes' names and the splitters.

    A code is the number of splitters at or below the value; null is code 0. Given splitters are used as
    they are, which repeats an earlier layout.
    """
    cells = 1 << bits
    names = [f"__vg_code{i}" for i in range(len(dims))]
    placed = df.withColumns({f"__vg_pos{i}": _position(df, d) for i, d in enumerate(dims)})
    if splitters is None:
        at = F.array(*(F.lit(k / cells) for k in range(1, cells)))
        kinds = {d: placed.schema[f"__vg_pos{i}"].dataType for i, d in enumerate(dims)}
        numbers = [(i, d) for i, d in enumerate(dims) if not isinstance(kinds[d], T.StringType)]
        row = placed.agg(*(F.percentile_approx(f"__vg_pos{i}", at, ACCURACY).alias(d) for i, d in numbers)).first() if numbers else []
        splitters = {d: list(q or []) for (_, d), q in zip(numbers, row, strict=True)}
        splitters |= {d: string_splitters(placed.select(f"__vg_pos{i}"), cells) for i, d in enumerate(dims) if d not in splitters}
    codes = {
        name: reduce(add, [F.coalesce(F.col(f"__vg_pos{i}") >= F.lit(s), F.lit(False)).cast("int") for s in splitters[d]], F.lit(0))
        for i, (name, d) in enumerate(zip(names, dims, strict=True))
    }
    return placed.withColumns(codes).drop(*(f"__vg_pos{i}" for i in range(len(dims)))), names, splitters


def hilbert_shards(df: DataFrame, id_col: str, text_col: str, dims: Sequence[str], n_shards: int = 40, bits: int = 4, keep: Sequence[str] = (), splitters: dict[str, list[float] | list[str]] | None = None) -> DataFrame:
    """All rows of df in n_shards runs along the curve, with row counts at most one apart (law `rows`).

    Returns id_col, size, text_crc32, law, shard, slot, grown_shard, curve_index and the columns in keep.
    Nulls: a null dimension has code 0, a null text has size 16 and a null checksum, a null id comes first
    in its cell. Ties: rows with equal index, id, size and checksum are interchangeable. An empty table
    gives no row. Columns of df besides those named are not read.
    """
    named = dict.fromkeys([id_col, *dims, *keep])
    base = df.select(*(F.col(f"`{c}`").alias(f"__vg_in_{c}") for c in named), F.col(f"`{text_col}`").alias("__vg_text"))
    coded, codes, _ = quantised(base, [f"__vg_in_{d}" for d in dims], bits, splitters and {f"__vg_in_{d}": s for d, s in splitters.items()})
    key = F.col(f"`__vg_in_{id_col}`")
    keyed = coded.select(
        key.alias("__vg_id"),
        text_size(F.col("__vg_text")).alias("__vg_size"),
        F.crc32(F.encode("__vg_text", "UTF-8")).alias("__vg_crc"),
        hilbert_index([F.col(c) for c in codes], bits).alias("__vg_index"),
        *(F.col(f"`__vg_in_{c}`").alias(f"__vg_keep_{c}") for c in keep),
    )
    order = ["__vg_index", "__vg_id", "__vg_size", "__vg_crc"]
    # The checkpoint fixes which partition each row is in: range bounds are sampled, so a second run could differ.
    laid = checkpoint(keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__vg_at", F.monotonically_increasing_id()))
    part = F.shiftright("__vg_at", 33)
    counts = laid.groupBy(part.alias("__vg_part")).agg(F.count("*").alias("__vg_n"))
    # A row for each partition: its bound is the number of partitions, whatever the table's size.
    before = Window.orderBy("__vg_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__vg_part", F.coalesce(F.sum("__vg_n").over(before), F.lit(0)).alias("__vg_start"), F.sum("__vg_n").over(Window.partitionBy()).alias("__vg_total"))
    rank = F.col("__vg_start") + F.col("__vg_at").bitwiseAND(F.lit((1 << 33) - 1).cast("long"))
    shard = F.expr(f"(__vg_rank * {n_shards}L) div __vg_total")
    ranked = laid.withColumn("__vg_part", part).join(F.broadcast(starts), "__vg_part").withColumn("__vg_rank", rank).withColumn("__vg_shard", shard)
    return ranked.select(
        F.col("__vg_id").alias(id_col),
        F.col("__vg_size").alias("size"),
        F.col("__vg_crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("__vg_shard").cast("int").alias("shard"),
        (F.col("__vg_rank") - F.expr(f"(__vg_shard * __vg_total + {n_shards - 1}L) div {n_shards}L")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("__vg_index").alias("curve_index"),
        *(F.col(f"__vg_keep_{c}").alias(c) for c in keep),
    )


def shard_manifest(shards: DataFrame, dims: Sequence[str], shard_col: str = "shard") -> DataFrame:
    """A row for each shard with its row count and the minimum and maximum of each dimension: what a reader prunes by."""
    return shards.groupBy(shard_col).agg(
        F.count("*").alias("rows"),
        *(f(d).alias(f"{n}_{d}") for d in dims for n, f in (("min", F.min), ("max", F.max))),
    )
