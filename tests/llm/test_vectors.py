"""Top-k search, whitening and clustering against plain versions."""

import hashlib
import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.llm import centroids, topk, whitening
from verdigris.llm.vectors import LONG

NAN, INF = float("nan"), float("inf")


def table(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumns({"x": F.lit("own"), "row": F.lit(1), "n": F.lit(2), "cluster": F.lit("c"), "asks": F.lit(0), "distance": F.lit(0)})


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def whole(v, scale, plus=0):
    return [math.floor(scale * c) + plus for c in v]


def plain_top_k(rows, k, scale, every):
    own = [(i, whole(v, scale)) for i, v in rows if i is not None and usable(v)]
    out = []
    for at, (i, q) in enumerate(own):
        if i % every:
            continue
        scores = sorted((-sum(a * b for a, b in zip(q, x, strict=True)), j) for to, (j, x) in enumerate(own) if to != at and len(x) == len(q))
        out += [(i, rank, j, max(-LONG - 1, min(LONG, -s))) for rank, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def vectors(seed, n, dims, clusters=4):
    """Clusters with noise, a vector that a third of the rows has, and some rows that count for nothing."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims))
    x = np.float32(centres[rng.integers(0, clusters, n)] + 0.3 * rng.normal(size=(n, dims))) / 8
    x[rng.random(n) < 0.33] = x[0]
    rows = [(k, v) for k, v in enumerate(x.tolist())]
    odd = [None, [], [NAN] * dims, [None] + [0.5] * (dims - 1), [INF] + [0.0] * (dims - 1), [0.0] * dims, [0.25] * (dims - 1)]
    return rows + [(n + 50 * k, v) for k, v in enumerate(odd)] + [rows[0], rows[50], (None, rows[1][1]), (None, None)]


@pytest.mark.parametrize(("block", "queries", "small"), [(8192, 4096, 4096), (32, 3, 40)])
def test_top_k_equals_brute_force(spark, monkeypatch, block, queries, small):
    for name, value in {"BLOCK": block, "QUERIES": queries, "SMALL": small}.items():
        monkeypatch.setattr(topk, name, value)
    rows = vectors(1, 300, 12)
    found = topk.top_k(table(spark, rows), F.col("vec_id") % 10 == 0)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, found.collect())) == plain_top_k(rows, 5, 256, 10)


def test_top_k_of_few_and_large(spark):
    few = [(0, [1.0, -1.0]), (50, [1.0, -1.0]), (7, [0.0, 0.0])]
    assert sorted(map(tuple, topk.top_k(table(spark, few), F.col("vec_id") % 50 == 0).collect())) == plain_top_k(few, 5, 256, 50)
    for size in (1e6, 1e9, 1e14):  # doubles, longs and beyond hold the scores
        rows = [(k, [size * (k - 3), -size / 3, k / 7.0]) for k in range(8)]
        assert sorted(map(tuple, topk.top_k(table(spark, rows, "double"), F.lit(True)).collect())) == plain_top_k(rows, 5, 256, 1)
    assert topk.top_k(table(spark, few).where("false"), F.lit(True)).count() == 0
    assert topk.top_k(table(spark, few), F.lit(None).cast("boolean")).count() == 0
    with pytest.raises(TypeError):
        topk.top_k(table(spark, few).withColumn("vec_id", F.lit("a")), F.lit(True))


def test_the_threshold_stops_early():
    """Vectors of one direction and others: what can't beat the k-th best isn't scored, and best so far ends it at once."""
    rng = np.random.default_rng(5)
    x = np.concatenate((rng.integers(90, 110, (50, 8)), rng.integers(-10, 10, (950, 8))))
    lists = topk.Lists(np.arange(1000), np.arange(1000), x)
    query = np.full(8, 100)
    best, scored = lists.search(0, query, 5, [])
    assert best == sorted((-int(x[i] @ query), i) for i in range(1, 1000))[:5] and scored < 300
    assert lists.search(-1, query, 1, [(-(10**6), 5)]) == ([(-(10**6), 5)], 0)


def plain_whitening(rows, scale):
    lengths = Counter(len(v) for _, v in rows if usable(v) and v)
    d = max(lengths, key=lambda k: (lengths[k], k))
    own = [(i, whole(v, scale, whitening.SHIFT)) for i, v in rows if usable(v) and len(v) == d]
    distinct = sorted({tuple(x) for _, x in own})
    n = len(distinct)
    sums = [sum(x[k] for x in distinct) for k in range(d)]
    cov = np.array([[float(Fraction(sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in distinct), n**3)) for j in range(d)] for i in range(d)])
    return own, distinct, n, sums, cov


@pytest.mark.parametrize("dims", [5, 20])
def test_whitening_equals_exact_covariance(spark, dims):
    rows = vectors(2, 120, dims)
    own, distinct, n, sums, cov = plain_whitening(rows, 64)
    found = whitening.whitened(table(spark, rows).repartition(7), scale=64).collect()
    used = min(dims, whitening.COMPONENTS)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    assert Counter((r["vec_id"], r["component"]) for r in found) == Counter((i, c) for i, _ in own for c in range(1, used + 1))
    assert {r["n"] for r in found} == {n} and len({r["identity_error"] for r in found}) == 1 and found[0]["identity_error"] < 1e-9
    deviation = {i: sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for i, x in own}
    assert all(r["deviation"] == deviation[r["vec_id"]] for r in found)
    for c in range(used):
        z = {i: float(sum(float(Fraction(n * a - s, n)) * w for a, s, w in zip(x, sums, axes[:, c], strict=True)) / math.sqrt(values[c])) for i, x in own}
        mine = {r["vec_id"]: r["whitened"] for r in found if r["component"] == c + 1}
        sign = np.sign(sum(z[i] * mine[i] for i in z))
        assert all(math.isclose(sign * mine[i], z[i], rel_tol=1e-7, abs_tol=1e-7) for i in z)
        assert all(math.isclose(r["explained"], values[c] / np.trace(cov), rel_tol=1e-9) for r in found if r["component"] == c + 1)


def test_whitening_edges(spark):
    none = whitening.whitened(table(spark, [(1, None), (2, [NAN])]))
    assert none.count() == 0 and none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whitened(table(spark, [(1, [1.0, 2.0])] * 3)).count() == 0
    assert whitening.whitened(table(spark, [(1, [1.0])]).where("false")).count() == 0
    flat = whitening.whitened(table(spark, [(k, [k / 4.0, 1.0, k / 2.0]) for k in range(9)])).collect()  # one direction only
    assert {r["component"] for r in flat} == {1} and math.isclose(flat[0]["explained"], 1.0) and flat[0]["identity_error"] < 1e-9
    huge = whitening.whitened(table(spark, [(k, [1e15 * (k - 2), k / 64.0]) for k in range(5)], "double")).collect()
    assert any(r["deviation"] is None for r in huge) and all(math.isfinite(r["whitened"]) for r in huge)


def plain_clusters(rows, clusters, rounds, dims, scale):
    own = [(i, whole(v, scale)) for i, v in rows if usable(v) and len(v) == dims]
    order = sorted(own, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [x for _, x in order[:clusters]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(centres))
    for _ in range(rounds):
        members = [[] for _ in centres]
        for _, x in own:
            members[near(x)[1]].append(x)
        centres = [[sum(col) // len(m) for col in zip(*m, strict=True)] if m else c for m, c in zip(members, centres, strict=True)]
    placed = [(i, *near(x)) for i, x in own]
    total = Counter()
    for _, d, c in placed:
        total[c] += d
    fits = lambda v: v if v <= LONG else None
    return Counter((i, c, fits(d), fits(total[c]), fits(sum(total.values())), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, d, c in placed)


@pytest.mark.parametrize("rounds", [0, 1, 10])
def test_clusters_equal_lloyd(spark, rounds):
    rows = vectors(3, 300, 6)
    found = centroids.clustered(table(spark, rows).repartition(5), rounds=rounds, components=6)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(map(tuple, found.collect())) == plain_clusters(rows, 8, rounds, 6, 1024)


def test_clusters_of_few_large_and_none(spark):
    for rows, kind in (([(1, [0.5, 1.0]), (1, [0.5, 1.0]), (None, [2.0, 1.0])], "float"), ([(k, [1e7 * k, -3.0]) for k in range(12)], "double"), ([(k, [1e12 * k, -3.0]) for k in range(12)], "double")):
        assert Counter(map(tuple, centroids.clustered(table(spark, rows, kind), components=2).collect())) == plain_clusters(rows, 8, 10, 2, 1024)
    assert centroids.clustered(table(spark, rows).where("false"), components=2).count() == 0
    assert centroids.clustered(table(spark, [(1, None), (2, [1.0])]), components=2).count() == 0
