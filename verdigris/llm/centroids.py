"""Centroid clustering over distinct vectors.

Components become whole numbers; equal vectors are one class with its number of rows as weight, so that a vector that
a third of the rows has is one row of every round. Lloyd's rounds run over the classes: a task assigns its
vectors and gives, for each centroid, the exact weighted sums of its members, which are summed by
centroid and dimension. All arithmetic is in whole numbers, so results depend on no order. Assignments are
joined back to the rows by the 128 bits that name a class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_rows, stored
from .vectors import LONG, holding, largest, matrix, whole

CLUSTERS, ROUNDS, SEED, SCALE, COMPONENTS = 8, 10, 3, 1024, 64


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the number of the nearest centroid, ties to the smaller one, and the squared distance."""
    bound = 4 * x.shape[1] * (max(largest(x), largest(centroids)) + 1) ** 2
    p, c = holding(x, bound), holding(centroids, bound)
    gaps = (p * p).sum(axis=1)[:, None] - 2 * (p @ c.T) + (c * c).sum(axis=1)
    own = gaps.argmin(axis=1)
    return own, gaps[np.arange(len(x)), own]


def _exact_sums(own: np.ndarray, weights: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Of the rows of each centroid the number (column 0) and the sums of the components, weighted."""
    rows = np.column_stack((np.ones(len(x), np.int64), x))
    bound = (largest(rows) + 1) * int(weights.sum())
    member = (own[:, None] == np.arange(k)) * weights[:, None]
    return (holding(member.T, bound) @ holding(rows, bound)).astype(object)


def _round(classes: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: each non-empty one the floor of its members' exact mean."""
    k, d = centroids.shape

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, d + 1), object)
        for batch in batches:
            weights, x = batch.column(0).to_numpy(), matrix(batch.column(1))
            if len(x):
                total += _exact_sums(nearest(x, centroids)[0], weights, x, k)
        at = np.flatnonzero(total.ravel() != 0)
        yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int32()), "total": pa.array([int(v) for v in total.ravel()[at]], pa.decimal128(38, 0))})

    totals = np.zeros(k * (d + 1), object)
    for r in arrow_rows(classes.select("weight", "x"), summed, "at int, total decimal(38,0)").groupBy("at").agg(F.sum("total").alias("total")).collect():
        totals[r["at"]] = int(r["total"])
    totals = totals.reshape(k, d + 1)
    return np.array([[int(v) // int(t[0]) for v in t[1:]] if t[0] else old for t, old in zip(totals, centroids.tolist(), strict=True)], np.int64).reshape(k, d)


def clustered(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE, components: int = COMPONENTS) -> DataFrame:
    """For every kept row of vectors: id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of `components` components, none of them null, non-finite or 2^58 and more when scaled. Centroids
    start as the kept vectors whose ids have the smallest sha256 of '<seed>:<id>', in that order: fewer if fewer rows are
    kept; rows with a null id come last, and rows of one id by their components. An empty centroid stays where it is.
    Repeated rows count as often as they are there. Whole numbers that a long can't hold (a distance, an inertia) are
    null. An empty table gives no row; other columns aren't read.
    """
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), whole(F.col(f"`{vec_col}`"), scale).alias("v")).where(F.size("v") == components)
    rows = rows.select("id", F.col("v").alias("vector"), F.xxhash64("v").alias("x"), F.xxhash64(F.lit("second"), F.col("v")).alias("y"))
    classes = stored(rows.groupBy("x", "y").agg(F.first("vector").alias("vector"), F.count("*").alias("weight")))
    by = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.select(by.alias("by"), "vector").orderBy(F.asc_nulls_last("by"), "vector").limit(clusters).collect()
    centroids = np.array([r["vector"] for r in first], np.int64).reshape(len(first), components)
    narrow = classes.select("weight", F.col("vector").alias("x"))
    for _ in range(rounds if first else 0):
        moved = _round(narrow, centroids)
        if (moved == centroids).all():
            break  # every further round would be the same
        centroids = moved

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, gaps = nearest(matrix(batch.column(3)), centroids)
                fits = [int(g) if g <= LONG else None for g in gaps.tolist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(own, pa.int32()), pa.array(fits, pa.int64())], names=["x", "y", "weight", "cluster", "distance"])

    found = stored(arrow_rows(classes.select("x", "y", "weight", "vector"), assigned, "x long, y long, weight long, cluster int, distance long"))
    share = (F.col("weight").cast("decimal(19,0)") * F.col("distance").cast("decimal(19,0)")).cast("decimal(38,0)")
    of = {r["cluster"]: (None if r["missing"] else int(r["total"])) for r in found.groupBy("cluster").agg(F.sum(share).alias("total"), F.count_if(F.col("distance").isNull()).alias("missing")).collect()}
    long = lambda v: F.lit(v if v is not None and v <= LONG else None).cast("long")
    inertia = None if None in of.values() else sum(of.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()] or [None]
    by_number = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1)
    return rows.select("id", "x", "y").join(found.select("x", "y", "cluster", "distance"), ["x", "y"]).select(
        F.col("id").alias(id_col), "cluster", "distance",
        by_number([long(of.get(k, 0)) for k in range(len(digests))]).alias("cluster_inertia"),
        long(inertia).alias("inertia"),
        by_number([F.lit(d) for d in digests]).alias("centroid_sha256"),
    )


def oracle(clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE, components: int = COMPONENTS) -> str:
    """The same in DuckDB SQL over embeddings: every round an assignment of all rows and an update, written out."""
    square = "list_sum(list_transform(range(1, {d} + 1), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))".format(d=components)
    steps = [
        f"""k AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
          WHERE embedding IS NOT NULL AND len(embedding) = {components} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c, x FROM k ORDER BY sha256('{seed}:' || vec_id) LIMIT {clusters})",
    ]
    for n in range(rounds + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT vec_id, x, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.vec_id, v.x, c.c, {square} AS d FROM k v CROSS JOIN c{n} c) GROUP BY vec_id, x)")
        if n < rounds:
            mean = "list(CAST((s - ((s % t) + t) % t) // t AS BIGINT) ORDER BY i)"
            steps.append(f"s{n} AS (SELECT c, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS t FROM (SELECT c, x, unnest(range(1, {components} + 1)) AS i FROM a{n}) GROUP BY c, i)")
            steps.append(f"m{n} AS (SELECT c, {mean} AS x FROM s{n} GROUP BY c)")
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN m{n} m USING (c))")
    return f"""
    WITH {", ".join(steps)}
    SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
      CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(z.x, ',')) AS centroid_sha256
    FROM a{rounds} a JOIN c{rounds} z ON z.c = a.c
    """
