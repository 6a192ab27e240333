import itertools
import zlib

from pyspark.sql import functions as F

from verdigris.llm import hilbert


def test_curve_visits_every_cell_and_steps_by_one(spark):
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = list(itertools.product(range(1 << bits), repeat=dims))
        df = spark.createDataFrame(cells, ", ".join(f"c{i} int" for i in range(dims)))
        rows = df.withColumn("h", hilbert.hilbert_index([F.col(f"c{i}") for i in range(dims)], bits)).orderBy("h").collect()
        assert [r["h"] for r in rows] == list(range(len(cells)))
        for a, b in itertools.pairwise(rows):
            assert sum(abs(x - y) for x, y in zip(a[:dims], b[:dims], strict=True)) == 1


def test_shards_hold_the_law(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = hilbert.hilbert_shards(docs, "doc_id", "text", ["source", "lang", "n_chars", "doc_id"], 40, keep=("lang",)).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    counts = {}
    for r in rows:
        counts.setdefault(r["shard"], []).append(r["slot"])
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
    assert set(counts) <= set(range(40)) and max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in counts.values())
    ordered = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve_index"] for r in ordered] == sorted(r["curve_index"] for r in rows)


def test_manifest_prunes(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    shards = hilbert.hilbert_shards(docs, "doc_id", "text", ["lang", "doc_id"], 20, keep=("lang",))
    found = hilbert.shard_manifest(shards, ["lang", "doc_id"]).collect()
    assert sum(r["rows"] for r in found) == docs.count()
    assert sum(r["min_lang"] <= "es" <= r["max_lang"] for r in found) < len(found)


def test_edges(spark, edge_docs, no_docs):
    rows = hilbert.hilbert_shards(edge_docs, "doc_id", "text", ["source", "lang", "n_chars", "doc_id"], 5).collect()
    assert len(rows) == edge_docs.count()
    assert sorted(r["size"] for r in rows if r["text_crc32"] is None) == [16, 16]
    assert {r["size"] for r in rows if r["doc_id"] == 4} == {16}
    assert hilbert.hilbert_shards(no_docs, "doc_id", "text", ["source", "doc_id"], 5).count() == 0
