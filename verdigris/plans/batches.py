"""Queries over masks, batches, shared prefixes and epoch orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators import attention, batching, epochs
from verdigris.plans.encoding import LAYOUT_SQL, order_layouts
from verdigris.session import table
from verdigris.sources import workloads

Q, SQL = {}, {}
SEED, EPOCHS, ACCUMULATION, RATE, RISING = 42, 2, 32, 1e-4, 0.1


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _words(text: str) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda w: w != "")


_WORDS = "list_filter(string_split(coalesce(text, ''), ' '), lambda w: w <> '')"
_SEGMENTS = f"{LAYOUT_SQL}, g AS (SELECT o_orderkey, list_transform(s, lambda x: 0) || list_transform(b1, lambda x: 1) || list_transform(b2, lambda x: 2) AS seg FROM s), t AS (SELECT o_orderkey, unnest(seg) AS seg, unnest(range(len(seg))) AS i FROM g)"
_PAIRS = "p AS (SELECT a.o_orderkey, a.i, b.i AS j FROM t a JOIN t b ON a.o_orderkey = b.o_orderkey AND b.i <= a.i AND (b.seg = 0 OR b.seg = a.seg))"


@query(
    f"""WITH {_SEGMENTS}, {_PAIRS}, k AS (SELECT *, j - row_number() OVER (PARTITION BY o_orderkey, i ORDER BY j) AS island FROM p),
    v AS (SELECT o_orderkey, i, min(j) AS a, max(j) + 1 AS b, count(*) AS n FROM k GROUP BY o_orderkey, i, island),
    w AS (SELECT o_orderkey, i, sum(n) AS sees, string_agg(a || '-' || b, ' ' ORDER BY a) AS spans FROM v GROUP BY 1, 2)
    SELECT o_orderkey AS record_id, string_agg(CAST(sees AS VARCHAR), ',' ORDER BY i) AS sees, string_agg(spans, ',' ORDER BY i) AS spans FROM w GROUP BY 1"""
)
def token_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every packed layout, how many tokens each token sees, and which."""
    view = attention.token_view(order_layouts(spark, sf_dir))
    spans = F.array_join(F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["stop"].cast("string"))), " ")
    told = view.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("token", F.col("sees").cast("string").alias("sees"), spans.alias("spans")))).alias("t"))
    return told.select("record_id", *(F.array_join(F.col(f"t.{c}"), ",").alias(c) for c in ("sees", "spans")))


@query(f"WITH {_SEGMENTS}, {_PAIRS}, n AS (SELECT o_orderkey, max(i) + 1 AS tokens FROM t GROUP BY 1), c AS (SELECT o_orderkey, count(*) AS allowed FROM p GROUP BY 1) SELECT tokens, CAST(allowed + 32 - tokens AS BIGINT) AS allowed, CAST(1024 AS BIGINT) AS cells, count(*) AS layouts FROM n JOIN c USING (o_orderkey) GROUP BY ALL")
def padded_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of layouts padded to 32 tokens: allowed and all cells, by size."""
    layouts = order_layouts(spark, sf_dir).withColumn("to", F.lit(32))
    return attention.mask_cells(layouts, length="to").groupBy("tokens", "allowed", "cells").agg(F.count("*").alias("layouts"))


@query(
    f"""WITH {LAYOUT_SQL} SELECT o_orderkey AS record_id, 'cached' AS form, 2 AS questions, CAST(CASE WHEN len(s) + 12 <= 14 THEN 2 ELSE 1 END AS INTEGER) AS rows_a_pass, CAST(CASE WHEN len(s) + 12 <= 14 THEN 2 ELSE 3 END AS INTEGER) AS passes, CAST(len(s) + 21 AS INTEGER) AS computed, CAST(len(s) AS INTEGER) AS saved FROM s"""
)
def cached_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passes of layouts that run cached, under a budget that one or two questions fit."""
    return attention.pass_costs(order_layouts(spark, sf_dir), "cached", budget=28)


_GREEDY = f"""l AS (SELECT doc_id, len({_WORDS}) AS n FROM documents), o AS (SELECT doc_id, n, row_number() OVER (ORDER BY n, doc_id) - 1 AS place FROM l),
    f AS (SELECT place, n, 0 AS batch, 1 AS filled FROM o WHERE place = 0
      UNION ALL SELECT o.place, o.n, CASE WHEN (f.filled + 1) * greatest(o.n, 1) <= 4096 THEN f.batch ELSE f.batch + 1 END, CASE WHEN (f.filled + 1) * greatest(o.n, 1) <= 4096 THEN f.filled + 1 ELSE 1 END FROM f JOIN o ON o.place = f.place + 1)"""


def _batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.size(_words("text")).alias("n"))
    return batching.budgeted(docs, "n", 4096, "doc_id")


@query(f"WITH RECURSIVE {_GREEDY} SELECT o.doc_id, o.n, o.place, CAST(f.batch AS BIGINT) AS batch FROM f JOIN o USING (place)")
def budgeted_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in order of length, in batches of 4,096 padded tokens."""
    return _batched(spark, sf_dir).select("doc_id", F.col("n").cast("long").alias("n"), "place", "batch")


@query(f"WITH RECURSIVE {_GREEDY} SELECT CAST(batch AS BIGINT) AS batch, count(*) AS rows, CAST(sum(n) AS BIGINT) AS tokens, max(n) AS longest, count(*) * max(n) AS padded, CAST(count(*) * max(n) - sum(n) AS BIGINT) AS waste FROM f GROUP BY batch")
def batch_waste(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each batch pads."""
    return batching.batch_report(_batched(spark, sf_dir), "n")


@query(
    f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), c AS (SELECT w, min(doc_id) AS first FROM w GROUP BY w), o AS (SELECT w, first, lag(w) OVER (ORDER BY w) AS b, lag(first) OVER (ORDER BY w) AS before FROM c),
    l AS (SELECT w, first, before, CASE WHEN b IS NULL THEN 0 ELSE coalesce(list_position(list_transform(range(1, least(len(w), len(b)) + 1), lambda i: w[i] = b[i]), false) - 1, least(len(w), len(b))) END AS shared FROM o)
    SELECT doc_id, CAST(len(w.w) AS INTEGER) AS n, CAST(CASE WHEN doc_id = first THEN shared ELSE len(w.w) END AS INTEGER) AS reused, CAST(CASE WHEN doc_id = first THEN len(w.w) - shared ELSE 0 END AS INTEGER) AS computed,
      CASE WHEN doc_id <> first THEN first WHEN shared > 0 THEN before END AS source FROM w JOIN l ON w.w = l.w"""
)
def prefix_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as requests: words that are computed and words that a shared beginning gives."""
    docs = table(spark, sf_dir, "documents").select("doc_id", _words("text").alias("words"))
    return batching.prefix_plan(docs, "doc_id", "words")


def _key(j: int, at: int) -> str:
    return f"(1 + CAST('0x' || substr(sha256('{SEED}:epoch:' || e || ':{j}'), {at}, 7) AS BIGINT))"


def _rounds_sql(source: str) -> str:
    """source (i, e, v, n, a, b) with v taken through the network once."""
    out = f"SELECT i, e, n, a, b, v // b AS l, v % b AS r FROM {source}"
    for j in range(epochs.ROUNDS):
        out = f"SELECT i, e, n, a, b, l, r, {'r' if j % 2 == 0 else 'l'} + {_key(j, 1)} AS x FROM ({out})"
        mixed = f"((x * x) % {epochs.PRIME} * {_key(j, 8)} + x) % {epochs.PRIME}"
        digits = f"(l + {mixed}) % a AS l, r" if j % 2 == 0 else f"l, (r + {mixed}) % b AS r"
        out = f"SELECT i, e, n, a, b, {digits} FROM ({out})"
    return f"SELECT i, e, l * b + r AS v, n, a, b, 1 AS t FROM ({out})"


_RATE = f"CASE WHEN step <= peak THEN {RATE} + ({RATE} / 25 - {RATE}) / 2 * (1 + cos(pi() * step / peak)) ELSE {RATE} / 25 / 1e4 + ({RATE} - {RATE} / 25 / 1e4) / 2 * (1 + cos(pi() * (step - peak) / (total - 1 - peak))) END"


@query(
    f"""WITH RECURSIVE c AS (SELECT count(*) AS n, CAST(floor(sqrt(count(*) - 1)) + 1 AS BIGINT) AS a FROM orders), d AS (SELECT n, a, CAST(ceil(n / a) AS BIGINT) AS b FROM c),
    o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders),
    s AS (SELECT i, e, i AS v, n, a, b FROM o, d, range({EPOCHS}) AS r(e)),
    w AS ({_rounds_sql("s")} UNION ALL {_rounds_sql("(SELECT * FROM w WHERE v >= n)")}),
    p AS (SELECT i, e, v, n, CAST(ceil(n / {ACCUMULATION}) AS BIGINT) AS steps FROM w WHERE v < n),
    q AS (SELECT o_orderkey, e AS epoch, v AS position, e * steps + v // {ACCUMULATION} AS step, v % {ACCUMULATION} AS slot, least({ACCUMULATION}, n - v // {ACCUMULATION} * {ACCUMULATION}) AS held, {EPOCHS} * steps AS total, {RISING} * {EPOCHS} * steps - 1 AS peak FROM p JOIN o USING (i))
    SELECT o_orderkey, CAST(epoch AS INTEGER) AS epoch, position, step, CAST(slot AS INTEGER) AS slot, round(1.0 / held, 6) AS weight, round(1e6 * ({_RATE}), 4) AS rate FROM q"""
)
def epoch_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two epochs over the orders: each one's place, step, slot, weight and learning rate (in millionths)."""
    plan = epochs.epoch_plan(table(spark, sf_dir, "orders"), "o_orderkey", epochs=EPOCHS, accumulation=ACCUMULATION, seed=SEED, top_rate=RATE, rising=RISING)
    return plan.select("o_orderkey", "epoch", "position", "step", "slot", F.round("weight", 6).alias("weight"), F.round(F.col("rate") * 1e6, 4).alias("rate"))


_SAID = ("The parcel came two weeks late and the box was torn.", "I was charged twice for the same order.", "Please send the smaller size instead.", "My account does not let me change the address.")


@query("SELECT c_custkey, profile, CAST(questions AS INTEGER) AS questions, CAST(size - 1 AS BIGINT) AS tokens, 'Ticket ' || (1000 + c_custkey) AS begins FROM customer, (VALUES ('state128_q1', 128, 1), ('state512_q8', 512, 8), ('state2048_q32', 2048, 32)) AS p(profile, size, questions)")
def workload_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three requests a customer, of the profiles' sizes: their tokens as the installed tokenizer counts them."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = workloads.profiled(table(spark, sf_dir, "customer"), "c_custkey", _SAID, path)
    return rows.select("c_custkey", "profile", "questions", workloads.counted(F.col("state"), path).alias("tokens"), F.substring_index("state", ".", 1).alias("begins"))
