import hashlib
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from verdigris.functions import numeric as nm
from verdigris.functions import policy as pl
from verdigris.functions import python_udfs as py
from verdigris.functions import questions as qs
from verdigris.functions import text as tx


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def doubles(values):
    return F.array(*(F.lit(float(v)) for v in values))


def test_text_hash_golden(spark):
    rows = spark.createDataFrame([("  Straße  is\tLONG\n",), ("strasse is long",)], "t string").select(tx.text_hash(F.col("t")).alias("h"), py.casefold_hash("t").alias("c")).collect()
    assert {x for r in rows for x in r} == {"7c702d9f284e79ba14781420a4de349c16a3f970134777b7e3d123dab655af86"}


def test_bucket_golden(spark):
    rows = spark.createDataFrame([("agnews/abc",), ("support/0",), ("doc/42",)], "g string").select(tx.split_of(F.col("g"), 20260924)).collect()
    assert [r[0] for r in rows] == ["train", "test", "train"]
    ids = [f"x/{i}" for i in range(300)]
    want = [int.from_bytes(hashlib.sha256(f"5:split:{i}".encode()).digest()[:8], "big") % 10 for i in ids]
    rows = spark.createDataFrame([(i,) for i in ids], "g string").select("g", (tx.hash64(F.concat(F.lit("5:split:"), F.col("g"))) % 10).cast("int").alias("b")).collect()
    assert [r["b"] for r in rows] == want


def test_numeric_golden(spark):
    layouts = F.array(doubles([0.7, 0.2, 0.1]), doubles([0, 0.5, 0.5]))
    assert one(spark, nm.cyclic_combine(layouts))[0] == pytest.approx([4.900800774228753e-05, 0.5857577294006344, 0.4141932625916233], abs=1e-12)
    p = doubles([0.2, 0.5, 0.3])
    row = one(spark, nm.nll(p, F.lit(1)), nm.brier(p, F.lit(1)), nm.expected_level(p), nm.argmax(p))
    assert list(row) == pytest.approx([0.6931471805599453, 0.38, 1.1, 1])
    assert one(spark, nm.argmax(doubles([0.5, 0.5])))[0] == 0


def test_softmax_and_losses(spark):
    z = [1.0, -2.0, 0.5, 30.0]
    for t in (0.25, 1.0, 4.0):
        e = [math.exp((v - 30) / t) for v in z]
        got = one(spark, nm.softmax(doubles(z), t), nm.nll_at(doubles(z), F.lit(2), t))
        assert got[0] == pytest.approx([v / sum(e) for v in e]) and got[1] == pytest.approx(math.log(sum(e)) - (0.5 - 30) / t)
    target = [0.1, 0.2, 0.3, 0.4]
    norm = math.log(sum(math.exp(v) for v in z))
    assert one(spark, nm.soft_ce(doubles(z), doubles(target)))[0] == pytest.approx(-sum(t * (v - norm) for t, v in zip(target, z, strict=True)))
    grid = nm.temperature_grid()
    assert len(grid) == 121 and grid[0] == pytest.approx(0.25) and grid[60] == pytest.approx(1) and grid[-1] == pytest.approx(4)


def test_cyclic_layouts_cancel_position_bias(spark):
    """Options scored with a bias by place: the raw order is off, the combination over rotations is not."""
    lp, bias = [-1.0, -2.0, -0.5, -3.0, -1.5], [0.0, 0.4, -0.3, 0.9, 0.2]
    soft = lambda v: [math.exp(x) / sum(map(math.exp, v)) for x in v]
    perms = one(spark, qs.layouts(F.lit("choice"), F.lit(5)))[0]
    assert perms[0] == [0, 1, 2, 3, 4] and [len(set(p)) for p in perms] == [5] * 5
    by_key = []
    for perm in perms:
        at = soft([lp[o] + bias[j] for j, o in enumerate(perm)])
        by_key.append([at[perm.index(k)] for k in range(5)])
    combined = one(spark, nm.cyclic_combine(F.array(*(doubles(p) for p in by_key))))[0]
    assert combined == pytest.approx(soft(lp), abs=1e-12) and max(abs(a - b) for a, b in zip(by_key[0], soft(lp), strict=True)) > 0.05


def test_layout_counts(spark):
    counts = lambda k, n: len(one(spark, qs.layouts(F.lit(k), F.lit(n)))[0])
    assert (counts("choice", 5), counts("noul", 2), counts("score", 3)) == (5, 2, 1)
    assert one(spark, qs.layouts(F.lit("noul"), F.lit(2), cyclic=False))[0] == [[0, 1]]
    assert one(spark, qs.answer_labels(F.lit("choice"), F.lit(3)), qs.answer_labels(F.lit("noul"), F.lit(2)), qs.answer_labels(F.lit("score"), F.lit(2))) == (["A", "B", "C"], ["Yes", "No"], ["0", "1"])


def value_of(tree, atoms):
    """Three-valued logic in plain Python."""
    if isinstance(tree, int):
        return atoms[tree]
    v = [value_of(t, atoms) for t in tree[1:]]
    negated = lambda x: None if x is None else not x
    every = lambda *x: False if False in x else None if None in x else True
    some = lambda *x: True if True in x else None if None in x else False
    if tree[0] == "if":
        return v[1] if v[0] else v[2] if v[0] is False else v[1] if v[1] == v[2] else None
    return {"not": lambda: negated(v[0]), "and": lambda: every(*v), "or": lambda: some(*v), "unless": lambda: every(v[0], negated(v[1]))}[tree[0]]()


def test_rules_are_three_valued(spark):
    truths = list(itertools.product((True, False, None), repeat=4))
    atoms = [F.col(f"a{i}") for i in range(4)]
    rows = spark.createDataFrame(truths, ", ".join(f"a{i} boolean" for i in range(4))).select("*", *(pl.compiled(t, atoms).alias(n) for n, t in pl.SHAPES.items())).collect()
    assert len(rows) == 81 and all(r[n] == value_of(t, r[:4]) for r in rows for n, t in pl.SHAPES.items())


def test_rule_texts():
    a = [pl.atom_text("lt", ["x"], 3), pl.atom_text("elapsed", ["d", "e"], 9), pl.atom_text("flag", ["vip"])]
    tree = ("or", ("unless", 0, 1), ("not", 2))
    assert pl.rule_text(tree, a, 0) == "((x is less than 3) holds and the exception (the elapsed days from d to e are at most 9) does not hold) OR (NOT (vip is yes))"
    assert pl.rule_text(tree, a, 4) == "[ANY of: [x is less than 3 UNLESS the elapsed days from d to e are at most 9] | [NOT: vip is yes]]"
    assert pl.rule_text(("if", 0, 1, 2), a, 3).startswith("when x is less than 3 the requirement is that")
    assert pl.rule_text(("and", 0, 2), a, 2) == pl.rule_text(("and", 0, 2), a, 1) == "both these conditions hold: [(x is less than 3); (vip is yes)]"
    assert pl.used_atoms(("if", 2, ("not", 0), 2)) == [2, 0]


def test_atoms_and_families(spark):
    row = one(spark, pl.atom("range", F.lit(30), F.lit(20)), pl.atom("range", F.lit(31), F.lit(20)), pl.atom("elapsed", F.to_date(F.lit("2026-01-01")), F.lit(5), F.to_date(F.lit("2026-01-07"))), pl.atom("lt", F.lit(None).cast("int"), F.lit(1)))
    assert list(row) == [True, False, False, None]
    qty = lambda n: pl.FAMILIES["quantity_limit"]({"qty": F.lit(n).cast("int"), "limit": F.lit(3)})
    assert list(one(spark, qty(3), qty(6), qty(7), qty(None))) == ["within_limit", "slightly_over", "far_over", None]
    tier = lambda n: pl.FAMILIES["volume_discount"]({"units": F.lit(n), "t1": 10, "t2": 50})
    assert list(one(spark, tier(9), tier(10), tier(50))) == [0, 1, 2]


def test_json_and_rendering(spark):
    raw = '{"a": true, "b": null, "c": {"d": [1, "x", {"e": 2}]}, "f": 1.5}'
    texts = [raw, "plain text", '["x", ["y"]]', None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(py.render_content("t")).collect()
    assert [r[0] for r in rows] == ["a: True\nb: \nc:\n  d:\n    - 1\n    - x\n    - e: 2\nf: 1.5", "plain text", "- x\n- - y", None]
    found = spark.createDataFrame([("a {b} {\"k\": 1} {\"k\": 2}",), ("none",), (None,), ('{"a": {"b": [1]}} rest',)], "t string").select(py.first_json_object("t")).collect()
    assert [r[0] for r in found] == ['{"k": 1}', None, None, '{"a": {"b": [1]}}']
    hashes = spark.createDataFrame([('{"a": "one two three four five", "b": "short"}',)], "t string").select(py.state_hashes("t")).first()[0]
    assert hashlib.sha256(b"one two three four five").hexdigest() in hashes and len(hashes) == 2


def test_text_functions(spark):
    s = lambda v: F.lit(v)
    row = one(spark, tx.escape_control(s("<|im_start|>x<|a|b|>")), tx.option_text(s("a"), s("")), tx.option_text(s("a"), s("b")), tx.after_thinking(s("x</think>y"), True), tx.after_thinking(s("xy"), True), tx.after_thinking(s("xy"), False), tx.question_mark(s(" why??  ")), tx.word_count(s("  ")), tx.word_clip(s("a  b\nc"), 2))
    assert list(row) == ["<¦im_start¦>x<|a|b|>", "a", "a: b", "y", "", "xy", "why?", 0, "a b"]


def test_uniform_draws(spark):
    rng = random.Random(1)
    keys = [str(rng.random()) for _ in range(500)]
    u = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k string").select(tx.uniform(F.col("k"))).collect()]
    assert all(0 <= x < 1 for x in u) and 0.4 < sum(u) / len(u) < 0.6
