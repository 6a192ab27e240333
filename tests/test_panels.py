"""Panels through systems, against the same walk in plain Python."""

import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from verdigris.operators import panels, scoring

Q = "array<struct<qid:string,type:string,keys:array<string>,gold:string,task:string>>"
MARKS = scoring.MarkerScorer({"de": "ä", "fr": "é"}, 30.0, 1.0)
BIAS = [0.7, 0.0, -0.2, 0.0]
CHOICE = ("lang", "choice", ["de", "en", "fr"], "de", "t")
RECORDS = [
    ("r1", "ääx é", [CHOICE, ("ok", "noul", ["false", "true"], "true", None), ("lv", "score", ["0", "1", "2"], "2", None)], "ok"),
    ("r2", "too long", [CHOICE], "state_over_limit"),
    ("r3", "éé", [("ok", "noul", ["false", "true"], None, None)], "ok"),
    ("r4", "x", [("many", "choice", [f"o{k}" for k in range(27)], "o3", None)], "ok"),
]


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame([(i, "s", "f", t, q, c) for i, t, q, c in RECORDS], f"record_id string, source_family string, schema_family string, state string, questions {Q}, context string")


def logits(text, shown, biased=True):
    low = text.lower()
    own = {"de": 30.0 * low.count("ä") / len(low), "fr": 30.0 * low.count("é") / len(low)}
    return [own.get(k, 1.0) + (BIAS[j] if biased and j < len(BIAS) else 0.0) for j, k in enumerate(shown)]


def softmax(z, t=1.0):
    e = [math.exp(x / t) for x in z]
    return [x / sum(e) for x in e]


def answers(rows):
    return scoring.score(rows, scoring.PositionBiased(MARKS, BIAS), keys="shown")


class Few(scoring.PositionBiased):
    def score(self, states, keys):
        return [[a + (self.bias[j] if j < len(self.bias) else 0.0) for j, a in enumerate(z)] for z in self.inner.score(states, keys)]


def few(rows):
    return scoring.score(rows, Few(MARKS, BIAS), keys="shown")


def drawn(record, v, keys):
    return sorted(keys, key=lambda k: (hashlib.sha256(f"42:{record}/{v}|{k}".encode()).hexdigest(), k))


def test_converted_rows(records):
    found = panels.converted_rows(records, few, "test", 2.0, order_variants=2)
    rows = {(r["record_id"], r["question"], r["system"], r["variant"]): r for r in found.collect()}
    want = {}
    for i, text, asked, context in RECORDS:
        several = any(t == "choice" and len(k) > 1 for _, t, k, _, _ in asked)
        for v in (-1, 0, 1) if several else (-1,):
            for q, t, keys, gold, _ in asked:
                shown = drawn(i, v, keys) if v >= 0 and t == "choice" else keys
                for system, temp in (("converted_raw", 1.0), ("converted_cal", 2.0))[: 2 if v < 0 else 1]:
                    p = dict(zip(shown, softmax(logits(text, shown), temp), strict=True)) if context == "ok" else None
                    want[i, q, system, "canonical" if v < 0 else f"order{v}"] = p, keys, gold
    assert rows.keys() == want.keys()
    for key, (p, keys, gold) in want.items():
        r = rows[key]
        assert r["eligible"] == (p is not None) and r["reason"] == (None if p else "admission: state_over_limit") and r["keys"] == keys
        if p:
            assert all(math.isclose(a, p[k]) for a, k in zip(r["probs"], keys, strict=True)) and math.isclose(p[r["pred"]], max(p.values()))
        assert r["correct"] == (None if gold is None else r["pred"] == gold)


def test_scorer_rows(records):
    found = panels.scorer_rows(records, answers, "test", order_variants=1)
    rows = {(r["record_id"], r["question"], r["system"], r["variant"]): r for r in found.collect()}
    assert len(rows) == 2 * (3 + 3 + 2 + 1 + 2)  # modes times the questions of all variants, in the order of RECORDS
    for (i, q, system, variant), r in rows.items():
        _, text, asked, _ = next(x for x in RECORDS if x[0] == i)
        kind, keys = next((t, k) for n, t, k, _, _ in asked if n == q)
        if len(keys) > 26:
            assert not r["eligible"] and "27 options" in r["reason"] and r["probs"] is None and r["layouts"] == 0
            continue
        shown = drawn(i, 0, keys) if variant == "order0" and kind == "choice" else ["true", "false"] if kind == "noul" else keys
        turns = [shown[s:] + shown[:s] for s in range(len(shown) if kind != "score" else 1)]
        by = [dict(zip(t, softmax(logits(text, t)), strict=True)) for t in (turns if system == "parent_cyclic" else turns[:1])]
        mean = softmax([sum(math.log(max(p[k], 1e-9)) for p in by) / len(by) for k in keys])
        assert r["layouts"] == len(by) and all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(r["probs"], mean, strict=True))
    with pytest.raises(ValueError):
        panels.scorer_rows(records, answers, "test", modes=("other",))


def test_json_rows(records):
    said = {"r1": 'so {"lang": "fr", "ok": "TRUE", "lv": 9}', "r2": "nothing", "r3": '{"ok": false}', "r4": None}
    text = F.create_map(*(F.lit(x) for k, v in said.items() if v for x in (k, v)))[F.col("record_id")]
    rows = {(r["record_id"], r["question"]): r for r in panels.json_rows(records, lambda r: r.withColumn("text", text), "test").collect()}
    assert {k: r["pred"] for k, r in rows.items()} == {("r1", "lang"): "fr", ("r1", "ok"): "true", ("r1", "lv"): None, ("r2", "lang"): None, ("r3", "ok"): "false", ("r4", "many"): None}
    assert [rows["r1", "lv"][c] for c in ("parse_ok", "answered", "text")] == [True, False, said["r1"]] and not rows["r2", "lang"]["parse_ok"]
    assert rows["r1", "lang"]["text"] is None and rows["r1", "lang"]["correct"] is False and json.loads(rows["r3", "ok"]["pred"]) is False
