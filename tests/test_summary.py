"""The report of an evaluation: its cells and its text."""

import pytest
from pyspark.sql import functions as F

from verdigris.plans import summary

ROWS = "system string, variant string, record_id string, question string, type string, task string, source_family string, keys array<string>, probs array<double>, pred string, gold string, eligible boolean, expected_level double"


def row(system, i, pred, gold, variant="canonical", kind="choice", eligible=True, probs=None):
    keys = ["a", "b"] if kind == "choice" else ["0", "1", "2"]
    p = probs or [1.0 if k == pred else 0.0 for k in keys]
    return (system, variant, f"r{i}", "q", kind, f"t{i % 2}", "s", keys, p if eligible and pred else None, pred if eligible else None, gold, eligible, float(pred) if kind == "score" and pred else None)


@pytest.fixture(scope="module")
def found(spark):
    rows = [row("model", 1, "a", "a"), row("model", 2, "b", "a"), row("model", 3, "2", "0", kind="score"), row("model", 1, "b", "a", "order0"), row("model", 2, "b", "a", "order0", probs=[0.4, 0.6]), row("json", 1, None, "a"), row("json", 2, "a", "a"), row("json", 3, "0", "0", kind="score"), row("parent", 1, "a", "a"), row("parent", 2, "b", "a", eligible=False), row("parent", 3, "2", "0", kind="score")]
    return summary.cells(spark.createDataFrame(rows, ROWS), "json", "parent", ["parent"])


def test_cells(found):
    got = {(r["section"], r["line"], r["column"]): (r["value"], r["n"]) for r in found.collect()}
    assert got["systems", "model", "accuracy"] == (pytest.approx(1 / 3), 3) and got["systems", "json", "accuracy"] == (pytest.approx(2 / 3), 3)
    assert got["systems", "model", "vs_base"] == (pytest.approx(-100 / 3), 3) and got["systems", "json", "vs_base"] == (None, 3)
    assert got["systems", "parent", "ineligible"] == (1.0, 3) and got["systems", "model", "agreement"] == (1.0, 2) and ("systems", "parent", "agreement") not in got
    assert got["task", "t1", "model"] == (0.5, 2) and got["source_family", "s", "parent"] == (0.5, 2)
    assert got["like_for_like", "parent", "model"] == (0.5, 2) and got["like_for_like", "parent", "json"] == (0.5, 2)
    assert got["score", "model", "mae_expected"] == (2.0, 1) and got["order", "model", "flip_rate"] == (0.5, 2) and got["order", "model", "mean_max_dp"] == (pytest.approx(0.7), 2)


def test_markdown(spark, found):
    timed = spark.createDataFrame([("model", 32, 5.25, None)], "system string, requests int, p50_ms double, p95_ms double")
    text = summary.markdown("Run", found.unionByName(summary.measured(timed, "performance", "system", "requests", "p50_ms", "p95_ms")), {"batch": "32"}, ["a small run"], ["memory"])
    assert text.startswith("# Run\n\n- batch: 32\n\n**Note:** a small run\n") and text.endswith("- Not measured in this run: memory\n")
    assert "| model | 33.3% | 100.0% | 0 | -33.3 | 3 |" in text and "| json | 66.7% | 0.0% | 0 | not measured | 3 |" in text
    assert "| model | 5.25 | not measured | 32 |" in text and text.index("## Systems") < text.index("## Accuracy by task") < text.index("## Performance")
    assert summary.markdown("Empty", found.where("false")) == "# Empty\n"


def test_large_reports_are_refused(found, monkeypatch):
    monkeypatch.setattr(summary, "MOST", 3)
    with pytest.raises(ValueError, match="small"):
        summary.markdown("Run", found.withColumn("line", F.lit("x")))
