"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chat_format, decontaminate, embeddings, hilbert, language_id, minhash, oracles, pieces, token_counts, topk, toxicity, url_reputation, whitening
from .shared import table


def op1_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return hilbert.hilbert_shards(docs, "doc_id", "text", ["source", "lang", "n_chars", "doc_id"], n_shards=40)


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=2)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), keep=(F.col("doc_id"),), round_trip=True)


def sentencepiece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same texts and vocabulary, cut where the sum of the pieces' scores is largest: forward sums over the trie of words."""
    return pieces.encode(table(spark, sf_dir, "documents"), keep=(F.col("doc_id"),), round_trip=True, largest_sum=True)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    labelled = pages.select(url_reputation.host_of(F.col("url")).alias("host"), url_reputation.page_outcome(F.col("html")).alias("outcome"))
    return url_reputation.filter_urls(pages, labelled)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return chat_format.read_back(chat_format.format_chats(turns.unionByName(own)))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.linked_vectors(table(spark, sf_dir, "embeddings"))


def _remainder(divisor: int) -> Column:
    """crc32 of the id as text, modulo the divisor; null ids: null."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(_remainder(3) != 1))
    out = language_id.predict(docs, model, keep=(F.col("doc_id"),))
    return out.select("doc_id", F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(_remainder(5) != 0)
    model = toxicity.fit(docs, "doc_id", "text", labels)
    out = toxicity.score(docs, model, keep=(F.col("doc_id"),))
    return out.select("doc_id", F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"), "toxic_hits", "toxic_words")


def op11_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op12_tsqr_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"), scale=64)


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """By name: op1 to op13, and op3's second way."""
    found = (op1_hilbert_sharding, op2_minhash_dedup, op3_sentencepiece, sentencepiece_viterbi, op4_decontamination, op5_url_filter, op6_chat_format, op7_token_counts, op8_embedding_dedup, op9_language_id, op10_toxicity, op11_threshold_topk, op12_tsqr_whitening, op13_centroid_clusters)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """SQL of op2, op4, op5, op6, op8, op11 and op13; the others are beyond DuckDB (CRC-32, learned models, vocabularies, eigenvectors)."""
    return oracles.oracle_sql()
