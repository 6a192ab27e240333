"""The whole corpus from small tables: every record has one fate, and the fates are those of a plain walk."""

import json
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from verdigris.operators import cases
from verdigris.plans import build, corpora
from verdigris.plans.corpora import _word_lengths
from verdigris.sources import catalog
from verdigris.sources import requests as rq

IDS = {k: i for i, k in enumerate(("state", "question", "option", "end_option", "decide"), 1)}
RECIPE = build.Recipe(seed=3, pool=60, train=12, test=6, showcase=4, variants=2, unseen=3, max_state=200)


def news(spark, n, start=0):
    """Rows of news; some texts are repeated, some rows have no label, some are too long."""
    rows = [(k, f"Story {k % 40} of the day" + " and on" * (150 if k % 11 == 0 else 2), -1 if k % 13 == 0 else k % 4) for k in range(start, start + n)]
    return spark.createDataFrame(rows, "id long, text string, label int")


@pytest.fixture(scope="module")
def corpus(spark):
    parts = [build.Part(catalog.SPECS["agnews"], "id", "text", news(spark, 30), news(spark, 60, 100)), build.Part(catalog.SPECS["emotion"], "id", "text", news(spark, 20, 300))]
    rules = build.policy_records(cases.compositions(spark, spark.range(8), 1), "composition")
    held = build.policy_records(cases.contrastive(spark, 2, 1, ("deadline",))[0], "contrastive")
    records, report = build.build(parts, RECIPE, _word_lengths, IDS, {"pool": rules, "test": held}, build.support_records(spark))
    return records.collect(), {(r["source_family"], r["fate"]): r["n"] for r in report.collect()}


def test_every_candidate_has_a_fate(corpus):
    records, report = corpus
    kept = Counter((r["source_family"], r["split"]) for r in records)
    assert kept == {k: n for k, n in report.items() if k[1] in build.SPLITS}
    assert report["support", "showcase"] == 8 and report["contrastive", "test"] == 4 and sum(n for (s, _), n in report.items() if s == "composition") == 32
    assert kept["agnews", "train"] <= 12 and report["emotion", "unseen"] == 3
    looked = sum(n for (s, f), n in report.items() if s == "agnews")
    evaluation = sum(k % 13 != 0 for k in range(30))
    assert looked == min(2 * (4 + 6), evaluation) + 60 + min(2, kept["agnews", "showcase"])  # official, pool, variants
    assert report["agnews", "unlabelled"] == sum(k % 13 == 0 for k in range(100, 160)) and report["agnews", "official_overlap"] > 0 and report["agnews", "context"] > 0


def test_records_are_whole(corpus):
    records, _ = corpus
    assert len({r["record_id"] for r in records}) == len(records)
    for r in records:
        assert r["packed_tokens"] > 0 and json.loads(r["provenance"])["text_sha256"] == r["text_sha256"]
        assert all(q["gold"] in q["keys"] and len(q["keys"]) == len(q["descriptions"]) for q in r["questions"])
    own = [r for r in records if r["source_family"] == "agnews" and not r["record_id"].endswith("/variant")]
    assert all([q["task"] for q in r["questions"]] == ["agnews", "agnews_yn", "agnews_yn"] for r in own)  # three questions over one state
    variants = [r for r in records if r["record_id"].endswith("/variant")]
    assert len(variants) == 2 and all(r["split"] == "showcase" and r["schema_family"] == "agnews.variant" and [q["qid"] for q in r["questions"]] == ["topic"] for r in variants)
    assert {r["group_id"] for r in variants} <= {r["group_id"] for r in own if r["split"] == "showcase"}
    owner = {}
    for r in records:
        assert owner.setdefault(r["group_id"], r["split"]) == r["split"]
    official = {r["text_sha256"] for r in own if "/evaluation/" in r["record_id"]}
    assert not official & {r["text_sha256"] for r in own if "/train/" in r["record_id"]}
    composed = [r for r in records if r["source_family"] == "composition"]
    assert all(json.loads(json.loads(r["provenance"])["certificate"])["deciding_field"] for r in composed) and {r["schema_family"].split(".")[0] for r in composed} == {"composition"}


def test_a_text_in_two_splits_is_refused(spark):
    rows = build.support_records(spark)
    other = rows.withColumn("group_id", F.concat("group_id", F.lit("x"))).withColumn("record_id", F.concat("record_id", F.lit("x")))
    part = build.Part(catalog.SPECS["emotion"], "id", "text", news(spark, 5))
    with pytest.raises(ValueError, match="two splits"):
        build.build([part], RECIPE, _word_lengths, IDS, {"test": other}, rows)


def test_extended_panel(spark):
    trained = spark.createDataFrame([("Story 3 of the day and on and on", "train"), ("Story 4 of the day and on and on", "showcase")], "state string, split string")
    part = build.Part(catalog.SPECS["tweet_offensive"], "id", "text", news(spark, 39).withColumn("label", F.when(F.col("label") >= 0, F.col("label") % 2).otherwise(-1).cast("int")))
    panel, report = build.extended_panel([part], trained, RECIPE, _word_lengths, IDS, 5)
    told = {r["fate"]: r["n"] for r in report.collect()}
    assert panel.count() == 5 == told["extended"] and {r["split"] for r in panel.collect()} == {"extended"}
    every, whole = build.extended_panel([part], trained, RECIPE, _word_lengths, IDS, 500)
    told = {r["fate"]: r["n"] for r in whole.collect()}
    assert told == {"unlabelled": 3, "context": sum(k % 11 == 0 and k % 13 != 0 for k in range(39)), "text_collision": 1, "extended": every.count()} and sum(told.values()) == 39


def test_groups_of_short_rules_share_no_text(spark, small, tmp_path):
    """Of these suppliers two and two draw the same case (routing reference included) of the same short rule, and go to different splits."""
    spark.createDataFrame([(k,) for k in (45872, 49072, 23601, 57705, 3)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.read.parquet(f"{small}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for name in ("supplier", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    told = sorted(tuple(r) for r in corpora.corpus_fates(spark, str(tmp_path)).collect())
    assert told == sorted(con.execute(corpora.SQL["corpus_fates"]).fetchall())


def test_many_groups_by_number_share_no_text(spark):
    rows = cases.compositions(spark, 40, 3, ("atom", "negation"), apart=True)
    told = rows.groupBy("state").agg(F.count_distinct("group_id").alias("groups"))
    assert told.where("groups > 1").isEmpty() and rows.count() == 4 * 80


def test_custom_records_of_every_fate(spark, tmp_path):
    """A custom corpus' records: forbidden by a long string in any field, without a valid label, too long, no request, or in their split."""
    ask = {"topic": {"type": "choice", "instructions": "Which?", "criteria": {"a": "x", "b": None}, "label": "b"}, "also": {"type": "noul", "label": "TRUE"}}
    line = lambda state, questions=ask: json.dumps({"state": state, "questions": questions})
    said = "I was charged twice for my March invoice and need the duplicate refunded."
    lines = [line({"n": 1, "body": said.upper()}), line("short one"), line("bad", {"topic": ask["topic"] | {"label": "c"}}), line("word " * 300), "no request", line("none", {}), "", line("short  ONE")]
    (tmp_path / "own.jsonl").write_text("\n".join(lines))
    own = build.custom_as_records(rq.labelled_requests(spark, str(tmp_path)), "own", 3, several=True)
    part = build.Part(catalog.SPECS["emotion"], "id", "text", news(spark, 5))
    records, report = build.build([part], RECIPE, _word_lengths, IDS, support=build.support_records(spark), custom=own)
    told = {r["fate"]: r["n"] for r in report.where("source_family = 'own'").collect()}
    found = {r["record_id"]: r for r in records.where("source_family = 'own'").collect()}
    assert {k: told.pop(k) for k in ("forbidden_text", "invalid_label", "context")} == {"forbidden_text": 1, "invalid_label": 3, "context": 1}
    assert sum(told.values()) == 2 and set(told) <= {"train", "dev", "calibration", "test"} and set(found) == {"own/own.jsonl/1", "own/own.jsonl/7"}
    one, two = found.values()
    assert one["group_id"] == two["group_id"] and one["split"] == two["split"] and one["schema_family"] == "own.custom"
    assert [(q["qid"], q["gold"], q["task"]) for q in one["questions"]] == [("also", "true", "own_also"), ("topic", "b", "own_topic")]
    assert json.loads(one["provenance"])["file"] == "own.jsonl" and json.loads(one["provenance"])["text_sha256"] == one["text_sha256"]
