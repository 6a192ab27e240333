"""Masks as intervals, budgeted batches, shared prefixes, epoch orders: against plain versions."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from verdigris.operators import attention, batching, epochs
from verdigris.store import numbered

SEGS = [[0, 0, 0, 1, 1, 2, 2, 2], [0], [], None, [0, 1, 0, 1, 2, 0], [3, 3, 1, 3], [1, 0, 0, 2, 0, 2]]


def seen_by(seg, i):
    return [j for j in range(i + 1) if seg[j] == 0 or seg[j] == seg[i]]


def test_token_view_equals_the_mask(spark):
    rows = spark.createDataFrame(list(enumerate(SEGS)), "record_id long, seg array<int>").withColumns({"runs": F.lit(1), "start": F.lit(2), "length": F.lit(9)})
    found = {(r["record_id"], r["token"]): r for r in attention.token_view(rows).collect()}
    assert found.keys() == {(k, i) for k, s in enumerate(SEGS) for i in range(len(s or []))}
    for (k, i), r in found.items():
        want = seen_by(SEGS[k], i)
        assert [j for a, b in r["spans"] for j in range(a, b)] == want and r["sees"] == len(want) and r["seg"] == SEGS[k][i]
        assert all(x[1] < y[0] for x, y in zip(r["spans"], r["spans"][1:]))  # neighbours are joined
    cells = {r["record_id"]: r for r in attention.mask_cells(rows, length="length").collect()}
    for k, r in cells.items():
        s = SEGS[k]
        assert (r["tokens"], r["allowed"], r["cells"]) == (len(s), sum(len(seen_by(s, i)) for i in range(len(s))) + 9 - len(s), 81)
    assert attention.token_view(rows.where("false")).count() == 0


def greedy(lengths, budget):
    """The batches of lengths in order, one row at a time."""
    out, start = [], 0
    while start < len(lengths):
        end = start + 1
        while end < len(lengths) and (end + 1 - start) * lengths[end] <= budget:
            end += 1
        out.append((start, end))
        start = end
    return out


def test_batch_plan_equals_the_greedy_fold():
    rng = random.Random(3)
    for _ in range(300):
        lengths = sorted(rng.choice((rng.randint(0, 9), rng.randint(0, 60))) for _ in range(rng.randint(0, 80)))
        budget = rng.randint(1, 120)
        want = [b for b, (s, e) in enumerate(greedy(lengths, budget)) for _ in range(s, e)]
        steps = {x[0]: x for x in batching.batch_plan(sorted(Counter(lengths).items()), budget)}
        got = []
        for place, n in enumerate(lengths):
            _, first, more, own, after, size = steps[n]
            got.append(own if place - first < more else after + (place - first - more) // size)
        if 0 not in lengths:
            assert got == want, (lengths, budget)
        assert got == sorted(got) and len(set(got)) == (max(got) + 1 if got else 0)


def test_budgeted_batches(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice((None, 7, 7, 7, rng.randint(1, 90)))) for k in range(500)]
    table = spark.createDataFrame(rows, "id long, n long").withColumns({"batch": F.lit("x"), "place": F.lit("y")}).drop("batch", "place")
    found = batching.budgeted(table.repartition(7), "n", 200, "id").collect()
    in_order = sorted((n or 0, k) for k, n in rows)
    assert sorted((r["place"], r["n"] or 0, r["id"]) for r in found) == [(p, *x) for p, x in enumerate(in_order)]
    report = batching.batch_report(spark.createDataFrame(found), "n").collect()
    assert sum(r["rows"] for r in report) == 500 and all(r["padded"] <= 200 or r["rows"] == 1 for r in report)
    assert all(r["waste"] == r["padded"] - r["tokens"] for r in report)
    assert batching.budgeted(table.where("false"), "n", 200, "id").count() == 0
    with pytest.raises(ValueError):
        batching.budgeted(table, "n", 0, "id")


def test_numbers_have_no_gaps(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), F.lit(0).alias("number x"))
    assert [r[0] for r in numbered(rows.repartition(9), "v").orderBy("number").select("v").collect()] == list(range(1000))


def test_prefix_plan(spark):
    rng = random.Random(5)
    texts = [[rng.choice("ab") for _ in range(rng.randint(0, 6))] for _ in range(120)] + [["x"] * 300 + [str(k)] for k in range(5)] + [None, []]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, ["a", "b"])]
    table = spark.createDataFrame(rows, "doc_id long, words array<string>").withColumns({"id": F.lit(1), "n": F.lit(2), "part": F.lit(3)})
    found = {r["doc_id"]: r for r in batching.prefix_plan(table.repartition(5), "doc_id", "words").collect()}
    assert len(found) == len(rows)
    prefixes = set()
    order = sorted((tuple(t or ()), k) for k, t in enumerate(texts))
    for p, (t, k) in enumerate(order):
        before = order[p - 1][0] if p else ()
        shared = next((i for i, (a, b) in enumerate(zip(t, before)) if a != b), min(len(t), len(before)))
        assert (found[k]["n"], found[k]["reused"], found[k]["computed"]) == (len(t), shared, len(t) - shared)
        if shared:
            assert tuple(texts[found[k]["source"]])[:shared] == t[:shared]
        else:
            assert found[k]["source"] is None or not t
        prefixes |= {t[:i] for i in range(1, len(t) + 1)}
    assert sum(r["computed"] for k, r in found.items() if k is not None) == len(prefixes)  # every beginning once
    assert (found[None]["n"], found[None]["computed"]) == (2, 2)
    assert batching.prefix_plan(table.where("false"), "doc_id", "words").count() == 0


def test_common_prefix(spark):
    pairs = [(["a", "b"], ["a", "c"], 1), (["a"], ["a", "c"], 1), ([], ["a"], 0), (["a", None], ["a", None], 2), (["x"], ["y"], 0)]
    rows = spark.createDataFrame(pairs, "a array<string>, b array<string>, want int")
    assert rows.where(batching.common_prefix(F.col("a"), F.col("b")) != F.col("want")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1009, 5000])
def test_every_epoch_is_a_permutation(spark, n):
    row = spark.range(n)
    found = row.select(*(epochs.permuted(F.col("id"), n, 7, e).alias(f"e{e}") for e in range(3))).collect()
    for e in range(3):
        assert sorted(r[e] for r in found) == list(range(n))
    if n > 50:
        assert len({tuple(r[e] for r in found) for e in range(3)}) == 3
        assert abs(sum(r[0] > k for k, r in enumerate(found)) / n - 0.5) < 0.2


def test_epoch_plan(spark):
    table = spark.createDataFrame([(f"r{k:02d}",) for k in range(13)], "record_id string").withColumn("epoch", F.lit("x"))
    plan = epochs.epoch_plan(table, "record_id", epochs=2, accumulation=4, seed=1, top_rate=0.5, rising=0.25)
    rows = plan.collect()
    assert plan.columns == ["record_id", "epoch", "position", "step", "slot", "weight", "rate"]
    assert Counter(r["step"] for r in rows) == {0: 4, 1: 4, 2: 4, 3: 1, 4: 4, 5: 4, 6: 4, 7: 1}
    for e in range(2):
        assert sorted(r["position"] for r in rows if r["epoch"] == e) == list(range(13))
    assert all(math.isclose(sum(r["weight"] for r in rows if r["step"] == s), 1.0) for s in range(8))
    assert {(r["step"], r["slot"]) for r in rows} == {(s, k) for s in range(8) for k in range(1 if s in (3, 7) else 4)}
    rate = {r["step"]: r["rate"] for r in rows}
    assert math.isclose(rate[0], 0.02) and math.isclose(rate[1], 0.5) and math.isclose(rate[7], 0.02 / 1e4)
    later = epochs.epoch_plan(table, "record_id", epochs=2, accumulation=4, seed=1, top_rate=0.5, rising=0.25, from_step=5).collect()
    assert sorted(later) == sorted(r for r in rows if r["step"] >= 5)
    assert epochs.epoch_plan(table.where("false"), "record_id", epochs=1, accumulation=2, seed=1).count() == 0
    with pytest.raises(ValueError):
        epochs.epoch_plan(table, "record_id", epochs=0, accumulation=2, seed=1)


LAYOUT = "record_id long, status string, n_state int, ids array<int>, decide_idx array<int>"


def test_pass_costs(spark):
    rows = [(1, "ok", 4, list(range(14)), [8, 13]), (2, "row_over_limit", 0, None, None), (3, "ok", 10, list(range(16)), [12, 15])]
    table = spark.createDataFrame(rows, LAYOUT)
    cost = lambda **x: {r["record_id"]: tuple(r)[1:] for r in attention.pass_costs(table, **x).collect()}
    assert cost(form="packed", packed_limit=15) == {1: ("packed", 2, 2, 1, 14, 4), 3: ("cached", 2, 2, 2, 16, 10)}
    assert cost(form="cached", budget=13) == {1: ("cached", 2, 1, 3, 14, 4), 3: ("cached", 2, 1, 3, 16, 10)}
    assert cost(form="rows") == {1: ("rows", 2, 2, 1, 18, 0), 3: ("rows", 2, 2, 1, 26, 0)}
    with pytest.raises(ValueError):
        attention.pass_costs(table, form="other")


def test_padded(spark):
    row = spark.createDataFrame([([1, 2], 4)], "t array<int>, n int")
    assert [tuple(x) for x in row.select(attention.padded(F.col("t"), F.col("n"), 0), attention.padded(F.col("t"), F.col("n"), 0, left=True)).first()] == [(1, 2, 0, 0), (0, 0, 1, 2)]
