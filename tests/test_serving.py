"""Requests from documents to typed answers."""

import json

import pytest
from pyspark.sql import functions as F

from verdigris.operators import serving

IDS = {"state": 1, "question": 2, "option": 3, "end_option": 4, "decide": 5}
CHOICE = {"type": "choice", "instructions": "Who?", "criteria": {"ops": None, "dev": {"what": "builds"}}}
NOUL = {"type": "noul", "instructions": None, "criteria": {"true": "it is"}}
SCORE = {"type": "score", "instructions": {"ask": "How"}, "criteria": ["low", "high"]}
REQUESTS = {
    "all": {"state": {"a": "x y"}, "questions": {"z": SCORE, "a": CHOICE, "m": NOUL}},
    "true": {"state": True, "questions": {"m": {"type": "noul"}}},
    "long": {"state": "w " * 40, "questions": {"m": NOUL}},
    "none": {"state": "x", "questions": {}},
    "many": {"state": "x", "questions": {f"q{k}": NOUL for k in range(33)}},
    "kind": {"state": "x", "questions": {"a": CHOICE, "b": {"type": "other"}}},
    "empty": {"state": "x", "questions": {"a": {"type": "choice", "criteria": {"": None}}}},
    "options": {"state": "x", "questions": {"a": {"type": "score", "criteria": []}}},
    "keys": {"state": "x", "questions": {"a": {"type": "noul", "criteria": {"maybe": None}}}},
    "list": [1],
}


def words(text):
    return F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.length(w) + 100)


@pytest.fixture(scope="module")
def requests(spark):
    rows = [(k, json.dumps(v)) for k, v in REQUESTS.items()] + [("broken", "{"), ("null", None)]
    return spark.createDataFrame(rows, "name string, body string").withColumns({"state": F.lit(1), "status": F.lit("x"), "layout": F.lit("y")})


def test_layouts_and_refusals(requests):
    rows = {r["name"]: r for r in serving.encoded_requests(requests.select("name", "body"), "body", words, IDS, max_state=20).collect()}
    assert {k: r["status"] for k, r in rows.items()} == {
        "all": "ok", "true": "ok", "long": "state_over_limit", "none": "question_count", "many": "question_count", "kind": "unknown_type", "empty": "empty_option_id", "options": "option_count", "keys": "noul_keys", "list": "no_request", "broken": "no_request", "null": "no_request",
    }
    own = rows["all"]["layout"]
    assert rows["all"]["state"] == "a: x y" and own["n_state"] == 4 and [q["qid"] for q in rows["all"]["questions"]] == ["z", "a", "m"]  # the document's order
    assert own["ids"][:4] == [1, 102, 101, 101] and len(own["decide_idx"]) == 3 and all(own["ids"][k] == 5 for k in own["decide_idx"])
    assert rows["true"]["state"] == "True" and rows["long"]["layout"] is None and rows["kind"]["questions"] is None


def test_answers(requests):
    rising = lambda rows: rows.withColumn("logits", F.transform("shown", lambda k, i: i.cast("double")))
    rows = {r["name"]: r for r in serving.answered(requests, "name", "body", rising, words, IDS, max_state=20).collect()}
    assert len(rows) == 12 and all((r["answers"] is None) == (r["status"] != "ok") for r in rows.values())
    a = {x["qid"]: x["answer"] for x in rows["all"]["answers"]}
    assert list(a) == ["z", "a", "m"] and (a["z"]["level"], a["a"]["choice"], a["m"]["decision"]) == (1, "dev", True)
    assert a["z"]["expected_level"] == pytest.approx(0.7310585786) and a["a"]["top_probability"] == pytest.approx(0.7310585786) and a["m"]["p_true"] == pytest.approx(0.7310585786)
    assert (rows["all"]["state_tokens"], rows["all"]["questions"], rows["all"]["form"]) == (4, 3, "packed") and rows["long"]["state_tokens"] is None or rows["long"]["form"] is None
    flat = serving.answered(requests.where("name = 'true'"), "name", "body", rising, words, IDS, temperature=1e9).first()
    assert flat["answers"][0]["answer"]["p_true"] == pytest.approx(0.5) and flat["branch_tokens"] == 8
    assert serving.answered(requests.where("false"), "name", "body", rising, words, IDS).count() == 0


def test_questions_of_all_requests_are_not_broadcast(spark):
    """Neither where a scorer joins its own rows nor where answers meet requests, however small Spark takes them for."""
    from verdigris.plans import encoding

    plan = encoding.answered_requests(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 2
