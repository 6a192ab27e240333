"""Generated cases against labels read back from their texts alone."""

import itertools
import json
import re
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from verdigris.functions import policy as pl
from verdigris.operators import cases

PAIRS = 12


def day(text):
    return datetime.strptime(text, "%B %d, %Y").date()


def numbers(text):
    return [int(x.replace(",", "")) for x in re.findall(r"\d[\d,]*", text)]


DATE = r"([A-Z][a-z]+ \d+, \d{4})"


def read_label(family, policy, case):
    """What the policy's words say about the case's words."""
    p = numbers(policy)
    between = lambda first, second: (day(re.search(second, case)[1]) - day(re.search(first, case)[1])).days
    level = lambda x, *bounds: str(sum(x > b for b in bounds))
    if family == "return_window":
        return str(between(f"bought .*? on {DATE}", f"submitted on {DATE}") <= p[0]).lower()
    if family == "spend_threshold":
        return "auto_approved" if numbers(re.search(r"total is \$([\d,]+)", case)[1])[0] <= p[0] else "director_signoff"
    if family == "authorization":
        return str(re.search(r"Only (\w+) may", case)[1] == re.search(r"signed by (\w+)", case)[1]).lower()
    if family == "age_eligibility":
        return str(int(re.search(r"is (\d+) years", case)[1]) >= p[0]).lower()
    if family == "quantity_limit":
        return ("within_limit", "slightly_over", "far_over")[int(level(int(re.search(r"quantity is (\d+)", case)[1]), p[0], 2 * p[0]))]
    if family == "deadline":
        return level(between(f"report was {DATE}", f"received on {DATE}"), 0, p[0])
    if family == "warranty_claim":
        return level(between(f"purchased .*? on {DATE}", f"filed on {DATE}"), p[0], p[1])
    if family == "sla_response":
        return level(int(re.search(r"arrived (\d+) hours", case)[1]), p[0], p[2])
    if family == "late_fee":
        return level(int(re.search(r"received (\d+) days", case)[1]), p[0], p[2])
    if family == "volume_discount":
        return level(int(re.search(r"is for (\d+) units", case)[1]), p[0] - 1, p[2])
    return level(between(f"promised for {DATE}", f"delivered on {DATE}"), p[0], p[2])


def test_contrastive_pairs(spark):
    found, report = cases.contrastive(spark, PAIRS, 7)
    rows = found.collect()
    assert Counter(r["family"] for r in rows) == dict.fromkeys(cases.FAMILIES, 2 * PAIRS) and len({r["record_id"] for r in rows}) == len(rows)
    pairs = {}
    for r in rows:
        state = json.loads(r["state"])
        assert "{" not in r["state"][1:] and r["gold"] in r["keys"] and len(r["keys"]) == len(r["descriptions"])
        assert read_label(r["family"], state["policy"], state["case"]) == r["gold"], (r["family"], state, r["gold"])
        pairs.setdefault(r["group_id"], {})[r["sibling"]] = (state, r["gold"])
    for both in pairs.values():
        (a, x), (b, y) = both["a"], both["b"]
        assert x != y and a["policy"] == b["policy"]
        one, two = re.split(r"(?<=\.) ", a["case"]), re.split(r"(?<=\.) ", b["case"])
        assert len(one) == len(two) and sum(s != t for s, t in zip(one, two, strict=True)) == 1
    assert {r["why"] for r in report.collect()} == {None}
    again = cases.contrastive(spark, PAIRS, 7, ["deadline"])[0].collect()
    assert sorted(again) == sorted(r for r in rows if r["family"] == "deadline")


def test_too_few_pairs_are_told(spark, monkeypatch):
    monkeypatch.setitem(cases.FAMILIES, "deadline", cases.FAMILIES["deadline"] | {"levels": (("-3", "0"), ("-3", "0"))})
    with pytest.raises(ValueError, match="deadline"):
        cases.contrastive(spark, 3, 1, ["deadline"])


def holds(words, facts):
    """An atom's words against the facts' words."""
    value = lambda name: facts[name]
    if m := re.fullmatch(r"(.*) is between (\d+) and (\d+), including both endpoints", words):
        return int(m[2]) <= int(value(m[1])) <= int(m[3])
    if m := re.fullmatch(r"(.*) is the same person as (.*)", words):
        return value(m[1]) == value(m[2])
    if m := re.fullmatch(r"the elapsed days from (.*) to (.*) are at most (\d+)", words):
        return (datetime.fromisoformat(value(m[2])) - datetime.fromisoformat(value(m[1]))).days <= int(m[3])
    if m := re.fullmatch(r"(.*) is yes", words):
        return value(m[1]) == "yes"
    m = re.fullmatch(r"(.*) is (less than|at most|greater than|at least|equal to) (\d+)", words)
    x, t = int(value(m[1])), int(m[3])
    return {"less than": x < t, "at most": x <= t, "greater than": x > t, "at least": x >= t, "equal to": x == t}[m[2]]


SHAPES = {"atom": "A", "negation": "not (A)", "conjunction": "(A) and (B)", "exception": "(A) and not (B)", "final_combination": "((B) if (A) else (C)) and (D)"}
STYLED = {
    "atom": r"(.+)", "negation": r"NOT \((.+)\)", "conjunction": r"\((.+)\) AND \((.+)\)", "exception": r"\((.+)\) holds and the exception \((.+)\) does not hold",
    "final_combination": r"\(if \((.+)\), use \((.+)\); otherwise use \((.+)\)\) AND \((.+)\)",
}


def test_compositions(spark):
    rows = cases.compositions(spark, 6, 3, tuple(SHAPES), styles=(0,)).collect()
    assert Counter((r["family"], r["pair_kind"], r["sibling"]) for r in rows) == {(s, k, x): 6 for s in SHAPES for k in ("relevant", "irrelevant") for x in "ab"}
    by = {}
    for r in rows:
        state = json.loads(r["state"])
        facts = dict(re.fullmatch(r"The (.+) is (.+)", s).groups() for s in state["case"].rstrip(".").split(". "))
        rule = re.fullmatch(r"Approve exactly when (.*)\. Otherwise deny\. The routing reference does not affect eligibility\.", state["policy"])[1]
        atoms = {c: holds(w, facts) for c, w in zip("ABCD", re.fullmatch(STYLED[r["family"]], rule).groups(), strict=False)}
        assert eval(SHAPES[r["family"]], {}, atoms) == (r["gold"] == "accept")
        by[r["group_id"], r["pair_kind"], r["sibling"]] = (facts, r["gold"], r["deciding_field"])
    for (group, kind, sibling), (facts, gold, deciding) in by.items():
        if sibling == "a":
            other, label, _ = by[group, kind, "b"]
            assert [k for k in facts if facts[k] != other[k]] == [deciding if kind == "relevant" else "routing reference"]
            assert (gold != label) == (kind == "relevant")


def test_other_shapes_and_styles(spark):
    shapes = ("disjunction", "conditional", "nested_or", "final_negation")
    rows = cases.compositions(spark, 3, 5, shapes, styles=(1, 2, 3, 4)).collect()
    assert len(rows) == 4 * 3 * len(shapes) and all("{" not in r["state"][1:] for r in rows)


def test_every_group_of_rare_deciding_facts_has_cases(spark):
    """Shapes in which a draw seldom decides: all groups have their four cases, whose labels hold for the facts told."""
    ids = spark.range(400).select((F.col("id") * 14 + 6).alias("id"))  # all of nested_and
    rows = cases.compositions(spark, ids, 11, styles=(0,)).collect()
    assert Counter((r["family"], r["pair_kind"], r["sibling"]) for r in rows) == {("nested_and", k, x): 400 for k in ("relevant", "irrelevant") for x in "ab"}
    golds = {}
    for r in rows:
        state = json.loads(r["state"])
        facts = dict(re.fullmatch(r"The (.+) is (.+)", s).groups() for s in state["case"].rstrip(".").split(". "))
        rule = re.fullmatch(r"Approve exactly when \(\((.+)\) AND \((.+)\)\) AND \((.+)\)\. Otherwise deny\..*", state["policy"]).groups()
        assert all(holds(w, facts) for w in rule) == (r["gold"] == "accept")
        golds.setdefault((r["group_id"], r["pair_kind"]), set()).add(r["gold"])
    assert all(len(g) == (2 if kind == "relevant" else 1) for (_, kind), g in golds.items())


@pytest.mark.parametrize("shape", list(pl.SHAPES))
def test_deciding_vectors(spark, shape):
    """The tree's values by plain Python equal the compiled columns', and the deciding atoms are those that a search finds."""
    tree = pl.SHAPES[shape]
    n = max(pl.used_atoms(tree)) + 1
    every = list(itertools.product((True, False, None), repeat=n))
    table = spark.createDataFrame(every, ",".join(f"a{i} boolean" for i in range(n)))
    got = {tuple(r)[:n]: r["v"] for r in table.withColumn("v", pl.compiled(tree, [F.col(f"a{i}") for i in range(n)])).collect()}
    assert got == {t: pl.evaluated(tree, t) for t in every}
    change = lambda t, i, v: (*t[:i], v, *t[i + 1 :])
    want = [(t, tuple(i for i in pl.used_atoms(tree) if got[change(t, i, not t[i])] != got[t] and got[change(t, i, None)] is None)) for t in every if None not in t]
    assert pl.deciding_vectors(tree) == [(t, d) for t, d in want if d] and pl.deciding_vectors(tree)


def test_drawn_facts_are_uniform_among_the_deciding(spark):
    """Of two atoms under `and`, the combinations come as often as they have assignments."""
    rows = cases.compositions(spark, 3000, 5, ("conjunction",), styles=(0,)).where("pair_kind = 'relevant' and sibling = 'a'").collect()
    seen, want, total = Counter(), Counter(), 0
    for r in rows:
        state = json.loads(r["state"])
        facts = dict(re.fullmatch(r"The (.+) is (.+)", s).groups() for s in state["case"].rstrip(".").split(". "))
        words = re.fullmatch(r"Approve exactly when \((.+)\) AND \((.+)\)\. Otherwise.*", state["policy"]).groups()
        seen[tuple(holds(w, facts) for w in words)] += 1
        ways = [{"less": (1, 4), "at m": (2, 3), "grea": (3, 2), "at l": (4, 1), "equa": (1, 4), "betw": (3, 2)}.get(w.split(" is ")[-1][:4], (2, 2) if "elapsed" in w else (1, 1) if w.endswith("is yes") else (3, 6)) for w in words]
        own = {(True, True): ways[0][0] * ways[1][0], (True, False): ways[0][0] * ways[1][1], (False, True): ways[0][1] * ways[1][0]}
        for k, v in own.items():
            want[k] += v / sum(own.values())
        total += 1
    assert seen.keys() == want.keys() and all(abs(seen[k] - want[k]) < 5 * total**0.5 for k in want)


def test_pairs_of_a_table(spark):
    ids = spark.createDataFrame([(k * 10_007,) for k in range(44)], "id long")
    rows, report = cases.contrastive(spark, ids, 3)
    found = rows.collect()
    assert len(found) == 88 and {r["family"] for r in found} == {f for k, f in enumerate(cases.FAMILIES) if any(i * 10_007 % 11 == k for i in range(44))}
    assert sum(r["n"] for r in report.collect()) == 44 and len({r["group_id"] for r in found}) == 44


def test_certificates_give_the_labels(spark):
    """Atoms and facts of every certificate, by plain Python, give the label that it certifies, and without the deciding fact none."""
    rows = cases.compositions(spark, 4, 21, styles=(0, 1, 2, 3, 4)).collect()
    for r in rows:
        own = json.loads(r["certificate"])
        facts = {x["field"]: x["value"] for x in own["facts"]}
        assert json.loads(r["state"])["case"] == " ".join(f"The {k} is {v}." for k, v in facts.items()) and r["render_style"] in range(5)

        def truth(atom, facts):
            values = [facts.get(f) for f in atom["fields"]]
            if None in values:
                return None
            text = pl.atom_text(atom["kind"], atom["fields"], atom["threshold"])
            return holds(text, facts)

        label = lambda f: pl.evaluated(pl.SHAPES[own["shape"]], [truth(a, f) for a in own["atoms"]])
        assert label(facts) is own["label"] is (r["gold"] == "accept") and own["deciding_field"] == r["deciding_field"]
        if (r["pair_kind"], r["sibling"]) == ("relevant", "a"):
            assert label({k: v for k, v in facts.items() if k != own["deciding_field"]}) is None


def test_groups_of_a_small_table_are_dealt_to_many_tasks(spark, tmp_path):
    spark.range(1, 400, numPartitions=1).write.parquet(f"{tmp_path}/ids")
    rows = cases.compositions(spark, spark.read.parquet(f"{tmp_path}/ids"), 7)
    parts = rows.groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == 4 and sum(r["count"] for r in parts) == 4 * 399
