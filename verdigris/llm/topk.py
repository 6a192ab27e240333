"""Exact top-k search by the threshold algorithm over sorted lists, one for each dimension.

Vectors become whole numbers, so scores (inner products) are exact. The rows are cut into stripes and the
queries into blocks; a task takes one stripe and one block of queries and reads the stripe some thousand
vectors at a time. For these it sorts a list for each dimension. A query goes down all lists at once, from the end
where its own component makes the product largest, scores every vector that it meets for the first time by
looking up its other components, and stops when the sum of the products at the depth reached, which no vector
further down can exceed, is under its k-th best score so far. The k-th best goes on to the next vectors of
the stripe, so that a query may stop before it has read an entry. Each stripe's k best meet in a window by query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import arrow_rows, stored
from .vectors import LONG, holding, largest, matrix, whole

#: Vectors whose lists a task holds at once; queries of a block; entries of each list that a query reads first (then
#: GROWTH times as many, again and again).
BLOCK, QUERIES, FIRST, GROWTH = 8192, 4096, 16, 4
#: Vectors of a stripe at least, and at most, once there are STRIPES of them; partitions at most (one holds several tiles beyond).
SMALL, LARGE, STRIPES, PARTITIONS = 4096, 1 << 18, 64, 8192
#: The largest score that is told from larger ones when stripes meet.
_WIDEST = 10**38 - 1


class Lists:
    """A block of vectors (rows of x) with a sorted list for each dimension."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray):
        self.rows, self.ids, self.x = rows, ids, x
        self.most = largest(x)
        self.order = np.ascontiguousarray(np.argsort(x, axis=0, kind="stable").T)
        self.values = np.take_along_axis(x.T, self.order, axis=1)
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def numbers(self, bound: int) -> tuple[np.ndarray, np.ndarray]:
        """The vectors and the lists' values as numbers that hold all sums up to bound."""
        bits = next(b for b in (53, 63, bound.bit_length()) if bound < 1 << b)
        if bits not in self.held:
            self.held[bits] = holding(self.x, bound), holding(self.values, bound)
        return self.held[bits]

    def search(self, row: int, query: np.ndarray, k: int, best: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], int]:
        """best, pairs (-score, id) in ascending order, after this block's vectors but the query's own row; and how many were scored."""
        n, bound = len(self.ids), len(query) * self.most * largest(query)
        x, values = self.numbers(bound)
        q = holding(query, bound)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        fresh = np.ones(n, bool)
        scored = depth = 0
        step = FIRST
        while depth < n:
            to = min(n, depth + step)
            # What lies at this depth or below: the last entries read, or before any is read the first ones.
            ceiling = self._ceiling(values, q, up, down, max(depth, 1))
            if len(best) == k and ceiling < -best[-1][0]:
                break
            if len(up) + len(down):
                met = np.zeros(n, bool)
                met[self.order[up, n - to : n - depth].ravel()] = True
                met[self.order[down, depth:to].ravel()] = True
                new = np.flatnonzero(met & fresh)
            else:  # a query of zeros: every vector scores 0
                new, to = np.arange(n), n
            fresh[new] = False
            new = new[self.rows[new] != row]
            scored += len(new)
            scores = x[new] @ q if len(q) else np.zeros(len(new), np.int64)
            if len(best) == k and len(scores):
                good = scores >= -best[-1][0]
                new, scores = new[good], scores[good]
            if len(new):
                best = _smallest(best, scores, self.ids[new], k)
            depth, step = to, step * GROWTH
        return best, scored

    def _ceiling(self, values: np.ndarray, q: np.ndarray, up: np.ndarray, down: np.ndarray, depth: int) -> int:
        """The largest score that a vector can have of which no entry is among the first depth - 1 of any list."""
        n = values.shape[1]
        return int(sum((q[up] * values[up, n - depth]).tolist()) + sum((q[down] * values[down, depth - 1]).tolist()))


def _smallest(best: list[tuple[int, int]], scores: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k best of best and the new ones: by score, ties to the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        over, equal = scores > least, np.flatnonzero(scores == least)
        if len(equal) > k:
            equal = equal[np.argpartition(ids[equal], k)[:k]]
        own = np.concatenate((np.flatnonzero(over), equal))
        scores, ids = scores[own], ids[own]
    return sorted([*best, *((-int(s), int(i)) for s, i in zip(scores.tolist(), ids.tolist(), strict=True))])[:k]


class _Tile:
    """The queries of one block against the vectors of one stripe that come by."""

    def __init__(self, k: int):
        self.k, self.parts, self.rows, self.ids, self.queries = k, [], [], [], []
        self.best: list[list[tuple[int, int]]] = []
        self.waiting = 0

    def ask(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        self.rows += rows.tolist()
        self.ids += ids.tolist()
        self.queries += list(x)
        self.best += [[] for _ in range(len(rows))]

    def read(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        for at in range(0, len(rows), BLOCK):
            self.parts.append((rows[at : at + BLOCK], ids[at : at + BLOCK], x[at : at + BLOCK]))
            self.waiting += len(self.parts[-1][0])
            if self.waiting >= BLOCK:
                self.search()

    def search(self) -> None:
        if not self.parts:
            return
        lists = Lists(*(np.concatenate([p[j] for p in self.parts]) for j in range(3)))
        self.parts, self.waiting = [], 0
        for j, query in enumerate(self.queries):
            self.best[j], _ = lists.search(self.rows[j], query, self.k, self.best[j])

    def found(self) -> pa.RecordBatch:
        self.search()
        out = [(row, own, i, max(-_WIDEST, min(_WIDEST, -s))) for row, own, best in zip(self.rows, self.ids, self.best, strict=True) for s, i in best]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], kind) for j, kind in enumerate([pa.int64()] * 3 + [pa.decimal128(38, 0)])], names=["row", "query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, asks: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, scale: int = 256) -> DataFrame:
    """For every row of vectors that asks holds for, its k best other rows: query_id, rank (from 1), vec_id, score.

    Components become floor(scale * c); the score is the inner product of these, the largest first, ties to the smaller
    id (ids are integers). Vectors that are null or hold a null or non-finite component take no part, nor do rows
    with a null id, nor vectors with a component of 2^58 or more when scaled; vectors are held only against those of
    equally many components. Rows, not ids, are what is compared: of repeated rows each asks, and each is found by the others.
    Scores are exact whatever their size; one that a long can't hold is given as the long nearest to it. An empty table, or
    one in which no row asks, gives no row; other columns are read only by asks.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"ids are integers, not {kind}")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), whole(F.col(f"`{vec_col}`"), scale).alias("x"), F.coalesce(asks, F.lit(False)).alias("asks"))
    rows = stored(rows.where(F.col("id").isNotNull() & F.col("x").isNotNull()).withColumn("row", F.monotonically_increasing_id()).withColumn("dims", F.size("x")))
    n, asking = rows.agg(F.count("*"), F.count_if("asks")).first()
    stripes = max(1, min(math.ceil(n / SMALL), max(STRIPES, math.ceil(n / LARGE))))
    blocks = max(1, math.ceil(asking / QUERIES))
    part = lambda count, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    read = rows.select("dims", part(stripes, 1).alias("stripe"), every(blocks).alias("block"), F.lit(1).alias("role"), "row", "id", "x")
    asked = rows.where("asks").select("dims", every(stripes).alias("stripe"), part(blocks, 2).alias("block"), F.lit(0).alias("role"), "row", "id", "x")
    tiles = read.unionByName(asked).withColumn("tile", F.col("block") * F.lit(stripes) + F.col("stripe"))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, key = None, None
        for batch in batches:
            keys = np.stack([batch.column(j).to_numpy() for j in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                number, dims, role = keys[a].tolist()
                if (number, dims) != key:
                    if tile is not None:
                        yield tile.found()
                    tile, key = _Tile(k), (number, dims)
                own = (batch.column(3)[a:b].to_numpy(), batch.column(4)[a:b].to_numpy(), matrix(batch.column(5)[a:b]))
                tile.read(*own) if role else tile.ask(*own)
        if tile is not None:
            yield tile.found()

    order = ["tile", "dims", "role"]
    dealt = tiles.select(*order, "row", "id", "x").repartitionByRange(min(stripes * blocks, PARTITIONS), "tile").sortWithinPartitions(*order)
    best = arrow_rows(dealt, searched, "row long, query_id long, vec_id long, score decimal(38,0)")
    by_query = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
    score = F.greatest(F.lit(-LONG - 1).cast("decimal(38,0)"), F.least(F.lit(LONG).cast("decimal(38,0)"), F.col("score"))).cast("long")
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", score.alias("score"))
