"""Whitening of vectors by a tall-and-skinny QR factorisation, without forming a covariance matrix.

Entries become whole numbers, so the fit list (each distinct vector once) has exact sums. Its rows, centred by these in
whole numbers and only then divided, are folded into one upper triangle (R) by each partition; triangles are
stacked and factorised again, FAN at a time, until one is left, whose R'R is n times the covariance. The singular
values and right vectors of that triangle are the standard deviations and the components. Every row is then
projected by itself. What reaches the driver are sums, one triangle and the check of the result: numbers by dimension only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import arrow_rows, stored
from .vectors import LONG, largest, matrix, whole

#: What is added to every scaled entry; components that are returned at most; triangles that a task merges, about; rows worked on at once.
SHIFT, COMPONENTS, FAN, ROWS = 1_000_000, 16, 16, 4096


class Centre:
    """Takes the mean, sums / n, from whole vectors without rounding."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.base = [s // n for s in sums]
        self.rest = [s - n * b for s, b in zip(sums, self.base, strict=True)]

    def times_n(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly: longs, or Python's numbers where a long can't hold them."""
        base = np.array(self.base, np.int64)
        z = x - base
        if (largest(z) + 1) * self.n <= LONG:
            return z * self.n - np.array(self.rest, np.int64)
        return z.astype(object) * self.n - np.array(self.rest, object)

    def rows(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n, rounded once at the end."""
        t = self.times_n(x)
        return np.array([[int(v) / self.n for v in r] for r in t], float).reshape(x.shape) if t.dtype == object else t / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """For each row the sum of (n * x - sums)^2, exactly; None if a long can't hold it."""
        t = self.times_n(x)
        if x.shape[1] * largest(t) ** 2 <= LONG:
            t = t.astype(np.int64)
            return (t * t).sum(axis=1).tolist()
        found = (t.astype(object) ** 2).sum(axis=1)
        return [int(v) if v <= LONG else None for v in found]


def triangle(stack: list[np.ndarray]) -> np.ndarray:
    """R of the rows of stack, one above the other: d x d, with rows of zeros if there are fewer rows than columns."""
    r = np.linalg.qr(np.concatenate(stack), mode="r")
    return np.vstack((r, np.zeros((max(0, r.shape[1] - r.shape[0]), r.shape[1]))))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (x) to the exact sum of each dimension: (at, total)."""
    totals: list[int] = []
    for batch in batches:
        x = matrix(batch.column(0))
        if len(x):
            own = x.sum(axis=0) if largest(x) * len(x) <= LONG else x.astype(object).sum(axis=0)
            totals = [a + int(b) for a, b in zip(totals or [0] * x.shape[1], own, strict=True)]
    yield pa.RecordBatch.from_pydict({"at": pa.array(range(len(totals)), pa.int32()), "total": pa.array(totals, pa.decimal128(38, 0))})


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Triangles (r) to the one of them all."""
    r = None
    for batch in batches:
        for data in batch.column(0).to_pylist():
            flat = np.frombuffer(data)
            own = flat.reshape(-1, math.isqrt(len(flat)))
            r = own if r is None else triangle([r, own])
    if r is not None:
        yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(r).tobytes()], pa.binary())], names=["r"])


def _one_triangle(fit: DataFrame, centre: Centre) -> np.ndarray:
    """R of all centred rows of fit (x): one triangle a partition, merged in a tree."""

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            x = matrix(batch.column(0))
            for at in range(0, len(x), ROWS):
                own = centre.rows(x[at : at + ROWS])
                r = triangle([own] if r is None else [r, own])
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])

    triangles = stored(arrow_rows(fit, folded, "r binary"))
    left = triangles.count()
    while left > 1:
        left = math.ceil(left / FAN)
        triangles = arrow_rows(triangles.repartition(left), _merged, "r binary")
    d = len(centre.base)
    return np.frombuffer(triangles.first()["r"]).reshape(d, d)


def _identity_error(fit: DataFrame, centre: Centre, turn: np.ndarray) -> float:
    """The largest absolute entry of the covariance of the whitened rows of fit, minus the identity."""
    c, n = turn.shape[1], centre.n

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((c + 1, c))
        for batch in batches:
            x = matrix(batch.column(0))
            for at in range(0, len(x), ROWS):
                z = centre.rows(x[at : at + ROWS]) @ turn
                total += np.vstack((z.T @ z, z.sum(axis=0)))
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(total.size), pa.int32()), "total": pa.array(total.ravel())})

    found = np.zeros((c + 1) * c)
    for r in arrow_rows(fit, products, "at int, total double").groupBy("at").agg(F.sum("total").alias("total")).collect():
        found[r["at"]] = r["total"] / n
    found = found.reshape(c + 1, c)
    return float(np.abs(found[:c] - np.outer(found[c], found[c]) - np.eye(c)).max())


def fit(whole_vectors: DataFrame) -> dict | None:
    """The model of a table (x: arrays of equally many longs): centre, turn (dimensions x components), explained, identity_error.

    None if there is no row, no dimension or no direction in which the rows differ. Components stand by falling
    variance, COMPONENTS at most, and only those with a variance over the rounding of the largest one; of each, the entry
    that is largest without its sign is positive.
    """
    distinct = stored(whole_vectors.select("x").distinct())
    n = distinct.count()
    totals = {r["at"]: int(r["total"]) for r in arrow_rows(distinct, _summed, "at int, total decimal(38,0)").groupBy("at").agg(F.sum("total").alias("total")).collect()} if n else {}
    if not totals:
        return None
    centre = Centre(n, [totals[k] for k in range(len(totals))])
    _, spread, across = np.linalg.svd(_one_triangle(distinct, centre))
    used = min(COMPONENTS, int((spread > spread[0] * len(spread) * np.finfo(float).eps * 4).sum()))
    if not used:
        return None
    axes = across[:used].T
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(used)])
    turn = axes / (spread[:used] / math.sqrt(n))
    return {"centre": centre, "axes": axes, "turn": turn, "explained": (spread[:used] ** 2 / (spread**2).sum()).tolist(), "identity_error": _identity_error(distinct, centre, turn)}


def whitened(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """For every usable row of vectors and every component: id_col, component (from 1), n, deviation, whitened, explained, identity_error.

    Entries become x = floor(scale * c) + SHIFT. Rows whose vector is null, empty or holds a null or non-finite entry, or one
    of 2^58 or more when scaled, are dropped; of vectors of several lengths the commonest is kept (of equally common
    ones the longest). Repeated rows and ids, and null ids, stay and count once in the fit. deviation is null
    where a long can't hold it. Rows that are all alike have no component and so no row; an empty table has none.
    """
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), whole(F.col(f"`{vec_col}`"), scale, SHIFT).alias("x")).where(F.size("x") > 0)
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType)]).add("component", "integer").add("n", "long").add("deviation", "long").add("whitened", "double").add("explained", "double").add("identity_error", "double")
    common = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    rows = rows.where(F.size("x") == (common["d"] if common else 0))
    model = fit(rows.select("x")) if common else None
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    centre, turn, used = model["centre"], model["turn"], len(model["explained"])

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, ROWS):
                batch = whole_batch.slice(at, ROWS)
                x = matrix(batch.column(1))
                rows = len(x)
                z = centre.rows(x) @ turn
                owner = np.repeat(np.arange(rows), used)
                fixed = lambda value, rows=rows: pa.array(np.tile(value, rows * used // len(value)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(owner)),
                        fixed(np.arange(1, used + 1, dtype=np.int32)),
                        fixed(np.array([centre.n], np.int64)),
                        pa.array(centre.deviations(x), pa.int64()).take(pa.array(owner)),
                        pa.array(z.ravel()),
                        fixed(np.array(model["explained"])),
                        fixed(np.array([model["identity_error"]])),
                    ],
                    names=schema.names,
                )

    return arrow_rows(rows, projected, schema)
