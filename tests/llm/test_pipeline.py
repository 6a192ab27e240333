import itertools
import math
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from verdigris.llm import language_id, queries, toxicity

from .test_near_duplicates import shingles, smallest_reachable
from .test_texts import overlap


def test_stages_equal_plain_versions(spark, small):
    """Each stage's decisions against a plain version on its own input."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    steps = {}
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, small)
        rows = out.collect()
        steps[name] = (at.collect(), rows)
        at = spark.createDataFrame(rows, out.schema)
        if name != "sentencepiece":
            assert out.columns == docs.columns
    before, after = steps["toxicity"]
    model = toxicity.fit(docs, "doc_id", "text", spark.read.parquet(f"{small}/labels.parquet"))
    machine, w = toxicity.automaton(model["lexicon"]), model["coefficients"]
    logit = lambda t: sum(a * b for a, b in zip(toxicity._features(*toxicity.matched(t, machine)), w, strict=False)) + w[3]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if 1 / (1 + math.exp(-logit(r["text"]))) < corpus_pipeline.TOXIC}
    before, after = steps["language_id"]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if any(c.isalpha() for c in r["text"])}
    before, after = steps["minhash_dedup"]
    sets = {r["doc_id"]: shingles(r["text"], 5) for r in before}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    label = smallest_reachable(sets, links)
    assert {r["doc_id"] for r in after} == {i for i, c in label.items() if i == c} and len(after) < len(before)
    before, after = steps["decontamination"]
    import re

    cut = lambda t: re.findall(r"[^\W_]+", t.lower())
    items = [cut(r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    hit = {r["doc_id"] for r in before if any(set(i) & set(cut(r["text"])) and overlap(cut(r["text"]), i) is not None for i in items if len(set(i) & set(cut(r["text"]))) > 8)}
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before} - hit
    before, after = steps["sentencepiece"]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before} and all(r["round_trip"] for r in after)


def test_language_stage_without_labels_keeps_all(spark, small, edge_docs):
    unlabelled = edge_docs.withColumn("lang", F.lit(None).cast("string"))
    out = corpus_pipeline.language_stage(spark, unlabelled, small)
    assert out.columns == edge_docs.columns and out.count() == unlabelled.count()


def test_every_operator_has_a_query():
    names = list(queries.queries())
    numbers = [int(n[2:].split("_")[0]) for n in names if n[:2] == "op" and n[2].isdigit()]
    assert sorted(numbers) == list(range(1, 14)) and set(queries.oracle_sql()) < set(names)


def test_no_local_checkpoint_and_native_modules_have_no_python():
    for path in Path(queries.__file__).parent.glob("*.py"):
        source = path.read_text()
        assert "localCheckpoint" not in source and "crossJoin" not in source
        if path.stem in ("hilbert", "decontaminate", "url_reputation"):
            assert not any(w in source for w in ("pandas", "mapInArrow", "pyarrow", ".rdd", "udf("))


def test_learned_language_columns(spark, small):
    out = queries.op9_language_id(spark, small)
    assert out.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    assert np.isfinite(out.agg(F.sum("score")).first()[0]) and language_id.UNKNOWN == "und"


def test_all_stages_over_odd_rows(spark, small, edge_docs):
    """Nulls, empty and very long texts, repeated rows and clashing names: the whole chain, and over no rows at all."""
    odd = edge_docs.withColumns({"row": F.lit("x"), "a.b": F.lit(1), "toxic_score": F.lit(2.0), "lang_pred": F.lit("q")})
    for docs, want in ((odd, True), (odd.where("false"), False)):
        at = docs
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, at, small)
            if name != "sentencepiece":
                assert out.columns == docs.columns
            at = spark.createDataFrame(out.collect(), out.schema)
        rows = at.collect()
        assert all(r["round_trip"] for r in rows) and len(rows) == (len({r["n_tokens"] for r in rows}) if want else 0)
        assert not want or {r["doc_id"] for r in rows} >= {1, 5, 7}


def test_decontamination_leaves_rows_where_they_are(spark, small, monkeypatch):
    """The documents of the fourth stage aren't dealt by key and sorted while the overlapping ones are few; both ways give the same rows."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near = corpus_pipeline.decontamination_stage(spark, docs, small)
        assert "SortMergeJoin" not in near._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(corpus_pipeline, "BROADCAST_KEYS", 0)
        dealt = corpus_pipeline.decontamination_stage(spark, docs, small)
        assert "SortMergeJoin" in dealt._jdf.queryExecution().executedPlan().toString()
        assert sorted(near.collect()) == sorted(dealt.collect()) and near.count() < docs.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
