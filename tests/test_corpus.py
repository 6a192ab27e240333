import pytest
from pyspark.sql import functions as F

from verdigris.plans import corpus


def test_corpus_build(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.lit("documents").alias("source_family"), F.col("doc_id").cast("string").alias("row_key"), F.col("text").alias("state"), F.lit("choice").alias("type"), (F.col("doc_id") % 5 == 0).alias("official"))
    limits = corpus.Limits(pool=400, train=120, test=40, showcase=10)
    built = corpus.prepare(docs.where("not official").drop("official"), docs.where("official").drop("official"), 42, limits).cache()
    counts = {r["split"]: r["count"] for r in built.groupBy("split").count().collect()}
    assert counts["train"] <= 120 and counts["showcase"] <= 10 and counts["train"] > 80 and set(counts) == {"train", "dev", "calibration", "test", "showcase"}
    assert sum(r["questions"] for r in corpus.manifest(built).collect()) == built.count()
    held = corpus.held_out_panel(docs.drop("official").withColumn("source_family", F.lit("other")), built, 42, 30)
    assert 0 < held.count() <= 30
    assert held.join(built.where("split = 'train'"), "text_sha256", "left_semi").isEmpty()
    with pytest.raises(ValueError):
        corpus.manifest(built.unionByName(built.withColumn("split", F.lit("unseen"))))
    built.unpersist()
