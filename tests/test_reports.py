import json

import pytest
from pyspark.sql import functions as F

from verdigris.operators import reports
from verdigris.plans import fixtures as fx


def test_evaluation_is_written_once_and_read_by_system(spark, small, tmp_path):
    rows = fx.evaluation_rows(spark, small)
    counts = rows.groupBy("system").agg(F.count("*").alias("n"), F.max(F.lit(None).cast("double")).alias("missing"))
    reports.write_evaluation(str(tmp_path / "e"), rows, {"summary": counts})
    back = reports.read_evaluation(spark, str(tmp_path / "e"))
    assert back.where("system = 'parent_raw'").count() == rows.where("system = 'parent_raw'").count() > 0
    lines = [json.loads(x) for f in (tmp_path / "e" / "summary").glob("*.json") for x in f.read_text().splitlines()]
    assert len(lines) == 3 and all(x["missing"] is None for x in lines)
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        reports.write_evaluation(str(tmp_path / "e"), rows, {})


def test_rows_of_ties_missing_probabilities_and_unlabelled_questions(spark):
    schema = "record_id int, source_family string, schema_family string, question string, type string, names array<string>, gold string, task string, by_key map<string,double>, said string, eligible boolean, reason string"
    given = [
        (1, "s", "f", "q", "noul", [], "true", None, {"true": 0.5, "false": 0.5}, None, True, None),
        (2, "s", "f", "q", "choice", ["a", "b"], None, "t", {"b": 0.9, "a": 0.1}, None, True, None),
        (3, "s", "f", "q", "score", ["x", "y"], "1", None, None, "1", True, None),
        (4, "s", "f", "q", "score", ["x", "y"], "1", None, None, None, False, "too long"),
    ]
    rows = {r["record_id"]: r for r in reports.evaluation_rows(spark.createDataFrame(given, schema), "test", "one").collect()}
    assert (rows[1]["keys"], rows[1]["pred"], rows[1]["correct"], rows[1]["task"]) == (["false", "true"], "false", False, "f")
    assert (rows[2]["probs"], rows[2]["pred"], rows[2]["correct"], rows[2]["task"]) == ([0.1, 0.9], "b", None, "t")
    assert (rows[3]["probs"], rows[3]["correct"], rows[3]["expected_level"]) == (None, True, 1.0)
    assert (rows[4]["pred"], rows[4]["correct"], rows[4]["expected_level"], rows[4]["reason"]) == (None, False, None, "too long")
    assert reports.evaluation_rows(spark.createDataFrame([], schema), "test", "one").isEmpty()


def test_side_by_side_leaves_refused_systems_out(spark):
    schema = "record_id int, question string, system string, variant string, keys array<string>, probs array<double>, pred string"
    given = [
        (1, "q", "base", "canonical", ["a", "b"], [0.2, 0.8], "b"),
        (1, "q", "other", "canonical", ["b", "a"], [0.4, 0.6], "a"),
        (1, "q", "other", "order0", ["a", "b"], [0.0, 1.0], "b"),
        (2, "q", "base", "canonical", ["a", "b"], [0.2, 0.8], "b"),
        (2, "q", "other", "canonical", ["a", "b"], None, None),
        (3, "q", "other", "canonical", ["a", "b"], [1.0, 0.0], "a"),
    ]
    rows = {(r["record_id"], r["option"]): r for r in reports.side_by_side(spark.createDataFrame(given, schema), ["base", "other"], "base").collect()}
    assert len(rows) == 6 and [k for k, r in sorted(rows.items()) if r["disagreement"]] == [(1, "a"), (1, "b")]
    assert (rows[1, "a"]["base"], rows[1, "a"]["other"], rows[1, "a"]["other_top"]) == (0.2, 0.6, True)
    assert (rows[2, "b"]["other"], rows[2, "b"]["other_top"], rows[3, "a"]["base"]) == (None, False, None)


def test_profile_tells_what_was_not_measured(spark):
    given = [("x", "warmup", 99.0, 1, 1), ("x", "single", 1.0, 10, 1), ("x", "single", 3.0, 20, 1)]
    row = reports.profile(spark.createDataFrame(given, "system string, phase string, ms double, tokens int, passes int"), 32, 8, "system").first()
    assert (row["requests"], row["p50_ms"], row["p95_ms"], row["tokens_per_request"]) == (2, 1.0, 3.0, 15.0)
    assert row["batches"] == 0 and row["decisions_per_second"] is None
