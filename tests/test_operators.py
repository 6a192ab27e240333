import hashlib
import random
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from verdigris.functions import text as tx
from verdigris.operators import evaluation, leakage, splits, targets
from verdigris.plans import registry
from verdigris.plans.pipeline import Stages, markdown
from verdigris.sources import readers, sinks
from verdigris.streaming import resume

ROOT = Path(__file__).resolve().parent.parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v != v:
        return None
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    df = registry.queries()[name](spark, small)
    found = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((repr([plain(v) for v in r]) for r in found.fetchall()))
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == want


def test_greedy_cap_passes_over_what_does_not_fit(spark):
    rng = random.Random(3)
    groups = [(s, f"{s}/{i}", rng.randint(1, 9)) for s in ("a", "b", "c") for i in range(40)]
    rows = splits.take_groups(spark.createDataFrame(groups, "source string, group_id string, n long"), "source", "n", 7, cap=30).collect()
    import hashlib

    want = set()
    for s in ("a", "b", "c"):
        total = 0
        for _, g, n in sorted((x for x in groups if x[0] == s), key=lambda x: hashlib.sha256(f"7:order:{x[1]}".encode()).hexdigest()):
            if total + n <= 30:
                total += n
                want.add(g)
    assert {r["group_id"] for r in rows} == want


@pytest.mark.parametrize("partitions", [1, 7])
def test_results_do_not_depend_on_partitions(spark, small, partitions):
    docs = spark.read.parquet(f"{small}/documents.parquet").repartition(partitions)
    rows = splits.with_groups(docs, "documents", "text", 42).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in rows} == {r["split"]: r["count"] for r in splits.with_groups(spark.read.parquet(f"{small}/documents.parquet"), "documents", "text", 42).groupBy("split").count().collect()}


def test_splits_are_disjoint(spark, small):
    docs = splits.with_groups(spark.read.parquet(f"{small}/documents.parquet"), "documents", "text", 42).withColumn("source_family", F.lit("documents"))
    assert [r["violations"] for r in splits.disjointness(docs).collect()] == [0, 0]


def test_leak_exclusion(spark):
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"]), (3, [])], "id long, hashes array<string>")
    assert [r["id"] for r in leakage.colliding(rows, "id", "hashes", spark.createDataFrame([("b",), ("z",)], "hash string")).collect()] == [1]


def test_metrics_keep_ineligible_apart(spark):
    keys = ["a", "b"]
    rows = [
        ("s", "r1", "a", "a", keys, [0.8, 0.2], True), ("s", "r2", "a", "b", keys, [0.4, 0.6], True), ("s", "r3", None, "b", keys, None, True), ("s", "r4", None, "b", keys, None, False), ("s", "r5", "a", None, keys, [0.8, 0.2], True),
    ]
    df = spark.createDataFrame(rows, "system string, record_id string, pred string, gold string, keys array<string>, probs array<double>, eligible boolean").withColumns({"type": F.lit("choice"), "expected_level": F.lit(None).cast("double")})
    m = evaluation.metrics(df, "system").first()
    assert (m["n"], m["n_total"], m["answered"], m["ineligible"], m["unanswered"]) == (3, 4, 2, 1, 1)
    assert m["accuracy"] == pytest.approx(1 / 3) and m["accuracy_answered"] == 0.5


def test_targets_resume_and_last_wins(spark):
    rows = spark.createDataFrame([("r/1", "q", 1, "old"), ("r/1", "q", 2, "new"), ("r/2", "q", 1, None)], "record_id string, qid string, ord int, v string")
    assert {(r["record_id"], r["v"]) for r in targets.latest(rows, "ord").collect()} == {("r/1", "new"), ("r/2", None)}
    assert targets.incomplete(rows, rows.where("ord = 2")) and not targets.incomplete(rows, rows)


def test_stages_skip_and_refuse(spark, tmp_path):
    stages, runs = Stages(str(tmp_path)), []
    make = lambda: runs.append(1) or spark.range(3)
    assert stages.run("a", {"x": 1}, make) == stages.run("a", {"x": 1}, make) and len(runs) == 1
    with pytest.raises(ValueError):
        stages.run("a", {"x": 2}, make)
    assert "| 2 |" in markdown("t", spark.range(3))


def test_sources_and_sinks(spark, tmp_path):
    rows = spark.range(5).withColumn("text", tx.normalised(F.lit("A  b")))
    out = str(tmp_path / "p")
    sinks.append_targets(rows, out)
    sinks.append_targets(rows, out)
    assert readers.verified(spark, out, 10, readers.folder_digest(spark, out)).count() == 10
    with pytest.raises(ValueError):
        readers.verified(spark, out, 9)
    sinks.write_json_lines(rows, str(tmp_path / "j"))
    assert readers.json_lines(spark, str(tmp_path / "j")).count() == 5 and readers.json_lines(spark, str(tmp_path / "j"), "id long").agg(F.sum("id")).first()[0] == 10
    registry_ = readers.Registry()
    registry_.add(readers.Source("s", out, "text", lambda df: df.select("id")))
    assert registry_.records(spark, "trainable").count() == 10 and readers.panel(rows, "id", 2).count() == 2
    with pytest.raises(ValueError):
        sinks.write_json(float("nan"), str(tmp_path / "x.json"))


def test_stream_resumes(spark, tmp_path):
    src, target, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    score = lambda df: df.withColumn("scored", F.col("id") * 2)
    spark.range(4).write.parquet(src)
    for _ in range(2):
        resume.collect_stream(spark.readStream.schema("id long").parquet(src), score, target, mark, ["id"]).awaitTermination()
    spark.range(2, 6).write.mode("append").parquet(src)
    last = resume.collect_stream(spark.readStream.schema("id long").parquet(src), score, target, mark, ["id"])
    last.awaitTermination()
    log = resume.session_log(last)
    assert sum(b["rows"] for b in log) == 4 and all(b["seconds"] >= 0 and b["began"] for b in log)
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == list(range(6))


def test_stream_windows(spark, small, tmp_path):
    events = str(tmp_path / "e")
    spark.read.parquet(f"{small}/events.parquet").write.parquet(events)
    stream = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double, props string").parquet(events)
    q = resume.windowed_counts(stream, "ts", "1 day", "1 hour", "event_type").writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").count() > 0


def test_core_stands_without_the_subpackage(tmp_path):
    """The entry file imports, and has the engine's queries, in a copy without llm and the pipeline."""
    import shutil

    shutil.copytree(ROOT / "verdigris", tmp_path / "verdigris", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 60 and set(e.oracle_sql()) <= set(e.queries()) and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"} | {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"})


def test_groups_beyond_any_pool(spark):
    """The fold over all groups of a source, against a plain one: later groups that fit are taken."""
    rng = random.Random(5)
    rows = [(s, f"{s}/{k}", rng.choice((1, 1, 2, 7, 30)), ) for s in ("p", "q") for k in range(400)] + [("r", "r/0", 90), ("r", "r/1", 3)]
    df = spark.createDataFrame(rows, "source string, group_id string, rows long")
    for cap in (3, 25, 60):
        want = {}
        for s in ("p", "q", "r"):
            total = 0
            for g, n in sorted(((g, n) for x, g, n in rows if x == s), key=lambda x: hashlib.sha256(f"9:order:{x[0]}".encode()).hexdigest()):
                if total + n <= cap:
                    total += n
                    want[g] = n
        assert {r["group_id"]: r["rows"] for r in splits.take_groups(df, "source", "rows", 9, cap).collect()} == want
    many = spark.range(3000).selectExpr("'s' AS source", "concat('s/', id) AS group_id", "1L AS rows")
    assert splits.take_groups(many, "source", "rows", 1, 2000).count() == 2000


def test_pool_draw(spark):
    """The rows whose keys hash lowest: as many as asked for, the same in any partitioning, others under another seed."""
    rows = spark.range(500).withColumn("k", F.col("id").cast("string"))
    want = sorted(range(500), key=lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest())[:40]
    for n in (1, 7):
        assert sorted(r["id"] for r in splits.sampled(rows.repartition(n), F.col("k"), 3, 40).collect()) == sorted(want)
    assert sorted(r["id"] for r in splits.sampled(rows, F.col("k"), 4, 40).collect()) != sorted(want) and splits.sampled(rows, F.col("k"), 3, 900).count() == 500


def test_costs_and_paths(spark):
    rows = spark.createDataFrame([(True, 2, 10), (False, None, None), (True, 1, None)], "eligible boolean, layouts int, prompt_tokens int")
    assert targets.costs(rows).first().asDict() == {"targets": 3, "eligible": 2, "layouts": 3, "prompt_tokens": 10}
    assert targets.costs(rows.where("false")).first().asDict() == {"targets": 0, "eligible": 0, "layouts": 0, "prompt_tokens": 0}
    assert targets.target_path("runs/", "0123456789abcdef") == "runs/0123456789ab/targets"
