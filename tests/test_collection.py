"""Collection by sessions and from streams: nothing twice, whatever was cut off."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from verdigris.streaming import resume


def questions(spark, n):
    rows = [(f"p/{k:03d}", f"q{j}", f"text {k}") for k in range(n) for j in range(1 + k % 2)]
    return spark.createDataFrame(rows, "record_id string, qid string, text string")


def scored(rows):
    return rows.withColumns({"eligible": F.lit(True), "layouts": F.lit(2), "prompt_tokens": F.length("text")})


def keys(rows):
    return sorted((r["record_id"], r["qid"]) for r in rows.collect())


def test_a_killed_session_is_gone_on_with(spark, tmp_path):
    target, wanted = str(tmp_path / "t"), questions(spark, 40)
    calls = []

    def dies(batch):
        calls.append(batch.count())
        rows = scored(batch)
        return rows if len(calls) < 3 else rows.withColumn("layouts", F.raise_error(F.lit("killed")).cast("int"))

    assert resume.collected(spark, target) is None
    with pytest.raises(StreamingQueryException):
        resume.collect(spark, wanted, dies, target, "in", per_batch=10)
    first = keys(resume.collected(spark, target))
    assert len(first) == len(set(first)) == 30 and calls == [15, 15, 15]  # two batches of ten whole records
    meta = resume.collect(spark, wanted.union(wanted), scored, target, "in", per_batch=10)
    assert keys(resume.collected(spark, target)) == keys(wanted)
    assert [(s["records"], s["batches"], s["questions"], s["failed"]) for s in meta["sessions"]] == [(40, 2, 30, True), (20, 2, 30, False)]
    assert meta["complete"] and meta["sessions"][1]["layouts"] == 60 and meta["sessions"][1]["prompt_tokens"] == 30 * 7
    assert [b["rows"] for b in meta["sessions"][1]["log"]] == [15, 15] and all(b["seconds"] > 0 for b in meta["sessions"][1]["log"])
    meta = resume.collect(spark, wanted, scored, target, "in")
    assert meta["sessions"][2]["records"] == 0 and keys(resume.collected(spark, target)) == keys(wanted)
    more = resume.collect(spark, questions(spark, 43), scored, target, "in", per_batch=2)
    assert more["sessions"][3]["batches"] == 2 and keys(resume.collected(spark, target)) == keys(questions(spark, 43))
    with pytest.raises(ValueError, match="other inputs"):
        resume.collect(spark, wanted, scored, target, "changed")


def test_a_stream_scores_each_key_once(spark, tmp_path):
    source, target, mark = (str(tmp_path / n) for n in ("s", "t", "c"))
    seen = []

    def score(rows, fail=None):
        seen.append(sorted(r["id"] for r in rows.collect()))
        return rows if fail is None else rows.withColumn("bad", F.raise_error(F.lit("killed")))

    run = lambda f: resume.collect_stream(spark.readStream.schema("id long").parquet(source), f, target, mark, ["id"]).awaitTermination()
    spark.createDataFrame([(k,) for k in (1, 2, 2, 3)], "id long").write.parquet(source)
    run(score)
    spark.createDataFrame([(k,) for k in (3, 4, 1, 5)], "id long").write.mode("append").parquet(source)
    with pytest.raises(StreamingQueryException):
        run(lambda rows: score(rows, True))
    run(score)
    assert seen == [[1, 2, 3], [4, 5], [4, 5]]  # the cut-off batch again, without keys of before
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == [1, 2, 3, 4, 5]


def test_an_empty_session(spark, tmp_path):
    meta = resume.collect(spark, questions(spark, 1).where("false"), scored, str(tmp_path / "t"), "in")
    assert meta["complete"] and meta["sessions"][0]["batches"] == 0
