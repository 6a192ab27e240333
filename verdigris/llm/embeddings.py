"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with cosine c or more are within squared distance 2 - 2c. After a fixed rotation that spreads
every direction over all coordinates, a vector is split into BLOCKS blocks; the blocks' squared distances add
up to the whole one, so a linked pair is, in one block at least, within the block's proportional share of the
squared distance. Each block is a range join: vectors are cut into strips by the block's first coordinate,
at its quantiles, and a vector visits every strip within the share's radius of it. Of two strips one visits the other, and a
strip compares its own vectors with each other and with its visitors, a matrix product a chunk; what passes is verified by the cosine
of the whole vectors in double precision. A pair counts in the first block whose share it keeps, so that the
union of the blocks' candidates holds it once.

Vectors of equal components are one class with a weight. No pair leaves a task: a task returns, for each
vector, the weight of what it links to, and a star for each component that its links make.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, smallest_names
from .shared import arrow_rows, checkpoint, stored

COSINE, BLOCKS = 0.9, 4
#: Vectors of a strip, about; own vectors compared at once; pairs verified at once.
STRIP, CHUNK, VERIFIED = 8192, 512, 1 << 15
_EPS = 1e-9


def rotation(dims: int) -> np.ndarray:
    """An orthogonal matrix, dims x the next power of two: signs by a fixed seed, then a Hadamard matrix, twice."""
    size = 1 << max(0, dims - 1).bit_length()
    h = np.ones((1, 1))
    while len(h) < size:
        h = np.block([[h, h], [h, -h]])
    rng = np.random.default_rng(64)
    out = np.eye(size)
    for _ in range(2):
        out = out * rng.choice((-1.0, 1.0), size) @ h / math.sqrt(size)
    return out[:dims]


def _rotated(raw: np.ndarray) -> np.ndarray:
    x = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    return x @ rotation(raw.shape[1])


def _bounds(size: int) -> np.ndarray:
    return np.linspace(0, size, min(BLOCKS, size) + 1).astype(int)


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of ids to a star for each component: (id, smallest id), without the centres."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


class _Strip:
    """The own vectors of one strip of one block, and what has been found for them and their visitors."""

    def __init__(self, block: int, cosine: float):
        self.block, self.cosine, self.parts = block, cosine, []
        self.links: list[tuple[np.ndarray, np.ndarray]] = []
        self.stars: list[tuple[np.ndarray, np.ndarray]] = []

    def close(self) -> None:
        """All own vectors have come; they meet each other."""
        self.ids, self.weights, self.raw = (np.concatenate([p[k] for p in self.parts]) for k in range(3))
        self.parts = []
        self.turn = rotation(self.raw.shape[1])
        edges = _bounds(self.turn.shape[1])
        self.edges, self.shares = edges, (2 - 2 * self.cosine) * np.diff(edges) / edges[-1]
        self.own = self._reduced(self.raw)
        self._meet(self.ids, self.weights, self.raw, self.own, True)

    def meet(self, ids: np.ndarray, weights: np.ndarray, raw: np.ndarray) -> None:
        self._meet(ids, weights, raw, self._reduced(raw), False)

    def _reduced(self, raw: np.ndarray) -> np.ndarray:
        """The block's coordinates of the unit vectors in single precision, with their square."""
        raw = raw.astype(np.float64)
        x = raw @ self.turn[:, self.edges[self.block] : self.edges[self.block + 1]] / np.linalg.norm(raw, axis=1, keepdims=True)
        return np.column_stack((x, (x * x).sum(axis=1))).astype(np.float32)

    def _meet(self, ids: np.ndarray, weights: np.ndarray, raw: np.ndarray, theirs: np.ndarray, same: bool) -> None:
        limit = np.float32(self.shares[self.block] + 1e-4)
        one = np.ones((len(theirs), 1), np.float32)
        right = np.ascontiguousarray(np.column_stack((theirs[:, :-1], one, theirs[:, -1:])).T)
        for at in range(0, len(self.ids), CHUNK):
            mine = self.own[at : at + CHUNK]
            left = np.column_stack((-2 * mine[:, :-1], mine[:, -1:], np.ones((len(mine), 1), np.float32)))
            for to in range(at if same else 0, len(ids), 4 * CHUNK):
                # One product gives the squared distances: -2xy + x^2 + y^2.
                near = (left @ right[:, to : to + 4 * CHUNK]) <= limit
                if not near.any():
                    continue
                x, y = np.nonzero(near)
                x, y = x + at, y + to
                if same:
                    x, y = x[x < y], y[x < y]
                for k in range(0, len(x), VERIFIED):
                    self._verify(x[k : k + VERIFIED], y[k : k + VERIFIED], ids, weights, raw)

    def _verify(self, x: np.ndarray, y: np.ndarray, ids: np.ndarray, weights: np.ndarray, raw: np.ndarray) -> None:
        p, q = self.raw[x].astype(np.float64), raw[y].astype(np.float64)
        dot, a, b = (np.einsum("ij,ij->i", u, v) for u, v in ((p, q), (p, p), (q, q)))
        a, b = np.sqrt(a), np.sqrt(b)
        linked = (dot / (a * b) >= self.cosine) & (self.ids[x] != ids[y])
        x, y, p, q, a, b = (v[linked] for v in (x, y, p, q, a, b))
        if not len(x):
            return
        gap = ((p / a[:, None] - q / b[:, None]) @ self.turn) ** 2
        kept = np.add.reduceat(gap, self.edges[:-1], axis=1) <= self.shares + _EPS
        first = (kept.argmax(axis=1) == self.block) & kept[:, self.block]
        x, y = x[first], y[first]
        if not len(x):
            return
        both, at = np.unique(np.concatenate((self.ids[x], ids[y])), return_inverse=True)
        self.links.append((both, np.bincount(at, np.concatenate((weights[y], self.weights[x])), len(both)).astype(np.int64)))
        self.stars.append(_stars(self.ids[x], ids[y]))

    def found(self) -> pa.RecordBatch:
        """(id, links, to): weights of what an id links to, and edges of stars."""
        none = np.zeros(0, np.int64)
        ids, links = (np.concatenate(s) for s in zip(*self.links, strict=True)) if self.links else (none, none)
        own, at = np.unique(ids, return_inverse=True)
        counts = np.bincount(at, links, len(own)).astype(np.int64) if len(own) else none
        a, b = _stars(*(np.concatenate(s) for s in zip(*self.stars, strict=True))) if self.stars else (none, none)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate((own, a))), pa.array(np.concatenate((counts, np.zeros(len(a), np.int64)))), pa.array(np.concatenate((own, b)))], names=["id", "links", "to"])


def _matrix(data: pa.Array, dims: int, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(data.to_pylist()), kind).reshape(-1, dims)


def linked_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """A row for each row of vectors: id_col, n_links, component_id and kept (the id is the component's smallest).

    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing, nor do rows with
    a null id (component null, kept) or vectors of different lengths. Repeated vectors link with each
    other. Ids are of any type that sorts; components may be of any finite size. An empty table gives no row;
    other columns aren't read.
    """
    # Single-precision input is dealt as it is, half the bytes, and widened where it is compared.
    single = vectors.schema[vec_col].dataType.simpleString() == "array<float>"
    kind = np.float32 if single else np.float64
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    good = F.col("v").isNotNull() & F.col("id").isNotNull() & (F.size("v") > 0)
    good &= F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("v", F.when(good, F.col("v")))
    # Equal vectors are told by 128 bits, so that rows find their class by two numbers.
    rows = rows.select("id", "v", F.xxhash64("v").alias("x"), F.xxhash64(F.lit("second"), F.col("v")).alias("y"))
    known = rows.where(F.col("v").isNotNull())
    classes = stored(known.groupBy("x", "y").agg(F.min("id").alias("first"), F.count("*").alias("weight"), F.first("v").alias("v")).withColumn("class", F.monotonically_increasing_id()))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(class, weight, dims, data, coordinates): the first rotated coordinate of each block."""
        for batch in batches:
            lists = batch.column(2)
            dims = np.diff(lists.offsets.to_numpy())
            flat, starts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            coords, data = [None] * len(dims), [None] * len(dims)
            for d in np.unique(dims):
                own = np.flatnonzero(dims == d)
                raw = np.stack([flat[starts[k] : starts[k] + d] for k in own])
                if not single:  # by a power of two, which is exact, so that no square over- or underflows
                    raw = np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1))[1][:, None])
                turned = _rotated(raw)
                heads = turned[:, _bounds(turned.shape[1])[:-1]]
                for k, c, r in zip(own, heads.tolist(), raw, strict=True):
                    coords[k], data[k] = c, r.astype(kind).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims.astype(np.int32)), pa.array(data, pa.binary()), pa.array(coords, pa.list_(pa.float64()))], names=["id", "weight", "dims", "data", "coords"])

    spots = stored(arrow_rows(classes.select("class", "weight", "v"), placed, "id long, weight long, dims int, data binary, coords array<double>"))
    # Splitters of every block, for each vector length: strips of STRIP vectors, so as many numbers as strips.
    # A length of few vectors is one strip; all others are cut by one job.
    counts = {r["dims"]: r["n"] for r in spots.groupBy("dims").agg(F.count("*").alias("n")).collect()}
    blocks = {d: len(_bounds(1 << max(0, d - 1).bit_length())) - 1 for d in counts}
    cuts = {(d, b): np.zeros(0) for d in counts for b in range(blocks[d])}
    many = [(d, b, math.ceil(n / STRIP)) for d, n in counts.items() if n > STRIP for b in range(blocks[d])]
    if many:
        at = spots.agg(*(F.percentile_approx(F.when(F.col("dims") == d, F.col("coords")[b]), [k / strips for k in range(1, strips)], 10_000) for d, b, strips in many)).first()
        cuts |= {(d, b): np.unique(found) for (d, b, _), found in zip(many, at, strict=True)}

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every vector to its own strip (role 0) and, in each block, to half of those in reach (role 1).

        Of two strips one visits the other: by the parity of their numbers, so that visits spread evenly.
        """
        for batch in batches:
            take, block, strip, role = [], [], [], []
            for k, (dims, coords) in enumerate(zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                edges = _bounds(1 << max(0, dims - 1).bit_length())
                for b, c in enumerate(coords):
                    r = math.sqrt((2 - 2 * cosine) * (edges[b + 1] - edges[b]) / edges[-1] + _EPS) + _EPS
                    low, home, high = np.searchsorted(cuts[dims, b], (c - r, c, c + r), "right")
                    for s in range(low, high + 1):
                        if s != home and ((s + home) % 2 == 0) != (s < home):
                            continue
                        take.append(k)
                        block.append(b)
                        strip.append(s)
                        role.append(int(s != home))
            rows = pa.Table.from_batches([batch.select(["id", "weight", "dims", "data"])]).take(pa.array(take, pa.int64())).combine_chunks()
            for part in rows.to_batches(max_chunksize=8192):
                at = slice(0, part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(2), pa.array(block[at], pa.int32()), pa.array(strip[at], pa.int32()), pa.array(role[at], pa.int32()), part.column(0), part.column(1), part.column(3)], names=["dims", "block", "strip", "role", "id", "weight", "data"])
                del block[at], strip[at], role[at]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strip, key, closed = None, None, False
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(4)], axis=1)
            cuts_at = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
            for a, b in zip(cuts_at[:-1], cuts_at[1:], strict=True):
                if a == b:
                    continue
                dims, block, number, role = keys[a].tolist()
                part = (batch.column(4)[a:b].to_numpy(), batch.column(5)[a:b].to_numpy(), _matrix(batch.column(6)[a:b], dims, kind))
                if (dims, block, number) != key:
                    if strip is not None:
                        if not closed:
                            strip.close()
                        yield strip.found()
                    strip, key, closed = (_Strip(block, cosine) if role == 0 else None), (dims, block, number), False
                if strip is None:
                    continue  # a strip without vectors of its own
                if role == 0:
                    strip.parts.append(part)
                    continue
                if not closed:
                    strip.close()
                    closed = True
                strip.meet(*part)
        if strip is not None:
            if not closed:
                strip.close()
            yield strip.found()

    order = ["dims", "block", "strip", "role"]
    tiles = arrow_rows(spots, dealt, "dims int, block int, strip int, role int, id long, weight long, data binary").repartition("dims", "block", "strip").sortWithinPartitions(*order)
    found = checkpoint(arrow_rows(tiles, joined, "id long, links long, to long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = smallest_names(components(found.select(F.col("id").alias("a"), F.col("to").alias("b"))), classes.select(F.col("class").alias("id"), "first"))
    named = classes.select("x", "y", "weight", "first", F.col("class").alias("id")).join(links, "id", "left").join(roots, "id", "left")
    named = named.select("x", "y", "weight", F.coalesce("links", F.lit(0).cast("long")).alias("links"), F.coalesce("root", "first").alias("root"))
    none = F.lit(None).cast("long")
    keyed = rows.select("id", *(F.when(F.col("v").isNotNull(), F.col(c)).otherwise(none).alias(c) for c in ("x", "y")))
    out = keyed.join(named, ["x", "y"], "left").withColumn("root", F.coalesce("root", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce(F.col("links") + F.col("weight") - 1, F.lit(0).cast("long")).alias("n_links"), F.col("root").alias("component_id"), F.coalesce(F.col("id") == F.col("root"), F.lit(True)).alias("kept"))
