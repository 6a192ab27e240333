"""Digests by byte ranges and manifests counted while writing."""

import json
import random

import pytest
from pyspark.sql import functions as F

from verdigris.functions import text as tx
from verdigris.plans import corpora
from verdigris.sources import digests, readers, sinks


def changed(spark, a, b):
    return sorted(tuple(r) for r in digests.changed_ranges(digests.range_digests(spark, str(a), 100), digests.range_digests(spark, str(b), 100)).collect())


def test_one_byte_names_its_file_and_range(spark, tmp_path):
    rng = random.Random(1)
    data = {"x.bin": bytes(rng.randrange(256) for _ in range(5000)), "sub/y.txt": b"line\n" * 100, "z.txt": b"end"}
    folders = [tmp_path / n for n in ("one", "two")]
    for folder in folders:
        (folder / "sub").mkdir(parents=True)
        for name, content in data.items():
            (folder / name).write_bytes(content)
    one, two = folders
    assert changed(spark, one, two) == [] and digests.tree_digest(spark, str(one), 100) == digests.tree_digest(spark, str(two), 100)
    before = digests.tree_digest(spark, str(one))
    ranges = digests.range_digests(spark, str(one), 100)
    assert {r["file"]: r["n"] for r in ranges.groupBy("file").agg(F.sum("bytes").alias("n")).collect()} == {"x.bin": 5001, "y.txt": 500, "z.txt": 4}  # a last stretch counts as ended
    at = next(k for k in range(2000, 5000) if 10 not in data["x.bin"][k - 40 : k + 1] and data["x.bin"][k] != 11)
    begins = data["x.bin"].rfind(b"\n", 0, at) + 1
    (two / "x.bin").write_bytes(data["x.bin"][:at] + bytes([data["x.bin"][at] ^ 1 if data["x.bin"][at] ^ 1 != 10 else 200]) + data["x.bin"][at + 1 :])
    assert changed(spark, one, two) == [("x.bin", begins // 100, "changed")]
    (two / "x.bin").write_bytes(data["x.bin"])
    (two / "z.txt").write_bytes(b"end\n")  # a line feed at the end is a change
    assert changed(spark, one, two) == [("z.txt", 0, "changed")]
    (two / "z.txt").unlink()
    lines = data["sub/y.txt"].replace(b"line\nline", b"line\nLINE", 1)
    (two / "sub/y.txt").write_bytes(lines)
    (two / "new").write_bytes(b"n")
    assert changed(spark, one, two) == [("new", 0, "added"), ("y.txt", 0, "changed"), ("z.txt", 0, "removed")]
    assert digests.tree_digest(spark, str(two)) != before == digests.tree_digest(spark, str(one))


def test_ranges_do_not_depend_on_how_files_are_read(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"".join(f"{k * k}\n".encode() for k in range(3000)))
    whole = sorted(map(tuple, digests.range_digests(spark, str(tmp_path), 1000).collect()))
    old = [(k, spark.conf.get(k)) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")]
    try:
        spark.conf.set(old[0][0], "500b")
        spark.conf.set(old[1][0], "1b")
        assert sorted(map(tuple, digests.range_digests(spark, str(tmp_path), 1000).collect())) == whole and len(whole) > 15
    finally:
        for k, v in old:
            spark.conf.set(k, v)


LEVELS = {"split": ("train", "dev", "test"), "source_family": ("p", "q", "none"), "schema_family": ("s",)}


def records(spark, n=40):
    rows = [(f"r{k}", ("train", "train", "dev")[k % 3], "pq"[k % 2], "s", [(f"q{j}", ("noul", "choice", "score")[(k + j) % 3]) for j in range(k % 4)]) for k in range(n)]
    return spark.createDataFrame(rows, "record_id string, split string, source_family string, schema_family string, questions array<struct<qid:string,type:string>>")


def test_manifest_is_counted_while_writing(spark, tmp_path):
    rows, path = records(spark), str(tmp_path / "out")
    manifest = sinks.write_counted(rows, path, LEVELS, modules=(tx,))
    plain = rows.collect()
    for split in LEVELS["split"]:
        own = [r for r in plain if r["split"] == split]
        assert manifest["files"][split]["records"] == len(own) and manifest["files"][split]["questions"] == sum(len(r["questions"]) for r in own)
        assert manifest["counts"][split]["source_family"] == {s: n for s in "pq" if (n := sum(r["source_family"] == s for r in own))}
        assert manifest["counts"][split]["questions_by_type"] == {t: n for t in ("noul", "choice", "score") if (n := sum(q["type"] == t for r in own for q in r["questions"]))}
    assert sinks.read_document(spark, f"{path}/_manifest") == json.loads(json.dumps(manifest)) and len(manifest["code_sha256"][tx.__name__]) == 64
    assert spark.read.parquet(path).count() == 40
    for split in LEVELS["split"]:
        part = sinks.read_counted(spark, path, split)
        assert part.rows.repartition(3).count() == manifest["files"][split]["records"] and part.check() == manifest["files"][split]["sha256"]


def test_changed_rows_are_told_by_the_scan(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_counted(records(spark), path, LEVELS)
    kept = spark.read.parquet(path)
    kept.where("record_id <> 'r1'").union(kept.where("record_id = 'r4'")).write.parquet(str(tmp_path / "other"))  # as many rows
    sinks.write_document(spark, sinks.read_document(spark, f"{path}/_manifest"), str(tmp_path / "other/_manifest"))
    entry = sinks.read_document(spark, f"{path}/_manifest")["files"]["train"]
    other = digests.Watched(spark.read.parquet(str(tmp_path / "other")).where("split = 'train'").drop("split"), entry["records"], entry["sha256"])
    assert other.rows.count() == entry["records"]
    with pytest.raises(ValueError, match="differ"):
        other.check()
    fewer = readers.watched(spark, str(tmp_path / "other"), 39, "")
    fewer.rows.count()
    with pytest.raises(ValueError, match="39"):
        fewer.check()


def test_strange_levels_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="no level"):
        sinks.write_counted(records(spark), str(tmp_path / "a"), LEVELS | {"source_family": ("p",)})
    with pytest.raises(ValueError, match="no level"):
        sinks.write_counted(records(spark), str(tmp_path / "b"), LEVELS, types=("noul", "choice"))
    empty = sinks.write_counted(records(spark).where("false"), str(tmp_path / "c"), LEVELS)
    assert empty["files"]["train"]["records"] == 0 and empty["counts"]["dev"]["source_family"] == {}


def test_copies_of_many_events_differ_where_one_line_does(spark, tmp_path):
    n = F.col("id")
    events = spark.range(200_000).select(n.alias("event_id"), F.concat(F.lit("t"), (n % 3).cast("string")).alias("event_type"), F.concat(F.lit('{"k":'), (n % 97).cast("string"), F.lit("}")).alias("props"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    found = {r["event_type"]: (r["bytes"], r["changed"]) for r in corpora.changed_files(spark, str(tmp_path)).collect()}
    sizes = {t: sum(len(f'{k}:{{"k":{k % 97}}}') + 1 for k in range(t, 200_000, 3)) for t in range(3)}
    assert found == {f"t{t}": (sizes[t], t == 17 % 3) for t in range(3)}
