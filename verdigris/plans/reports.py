"""Queries over evaluation rows, timings, systems side by side and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import numeric as nm
from verdigris.operators import panels, reports, scoring
from verdigris.plans import fixtures as fx
from verdigris.plans import summary
from verdigris.session import table

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


_P3 = fx.softmax_sql("embedding[1:3]::DOUBLE[]")


@query(
    f"""WITH s AS (SELECT vec_id, label, vec_id % 7 <> 0 AS eligible, vec_id % 5 = 0 AS told, {_P3} AS p FROM embeddings),
    r AS (SELECT *, CASE WHEN eligible AND NOT told THEN p END AS probs, CASE WHEN eligible AND told THEN '1' WHEN eligible THEN (list_position(p, list_max(p)) - 1)::VARCHAR END AS pred FROM s)
    SELECT vec_id AS record_id, CASE WHEN vec_id % 2 = 0 THEN 'levels' ELSE 'vectors' END AS task, '0,1,2' AS keys, pred, (label % 4)::VARCHAR AS gold, coalesce(pred = (label % 4)::VARCHAR, false) AS correct, eligible,
    round(probs[3], 6) AS p_last, round(coalesce(probs[2] + 2 * probs[3], CAST(pred AS DOUBLE)), 6) AS expected_level FROM r"""
)
def system_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score questions answered with probabilities by a shuffled map, with a bare answer, or refused."""
    head = F.slice(F.col("embedding").cast("array<double>"), 1, 3)
    eligible, told = F.col("vec_id") % 7 != 0, F.col("vec_id") % 5 == 0
    by_key = F.map_from_arrays(F.array(*(F.lit(k) for k in "210")), F.reverse(nm.softmax(head)))
    answers = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("record_id"),
        F.lit("embeddings").alias("source_family"),
        F.lit("vectors").alias("schema_family"),
        F.lit("level").alias("question"),
        F.lit("score").alias("type"),
        F.array(*(F.lit(k) for k in ("low", "middle", "high"))).alias("names"),
        (F.col("label") % 4).cast("string").alias("gold"),
        F.when(F.col("vec_id") % 2 == 0, "levels").alias("task"),
        F.when(eligible & ~told, by_key).alias("by_key"),
        F.when(eligible & told, "1").alias("said"),
        eligible.alias("eligible"),
        F.when(~eligible, "admission").alias("reason"),
    )
    rows = reports.evaluation_rows(answers, "test", "converted_raw")
    rows = rows.select("record_id", "task", F.array_join("keys", ",").alias("keys"), "pred", "gold", "correct", "eligible", F.get("probs", F.lit(2)).alias("p_last"), "expected_level")
    return _rounded(rows, "p_last", "expected_level")


@query(
    """WITH t AS (SELECT event_type, value AS ms, user_id % 100 AS tokens, event_id % 4 AS passes, CASE WHEN event_id % 10 = 0 THEN 'warmup' WHEN event_id % 10 < 7 OR event_type = 'click' THEN 'single' ELSE 'batch' END AS phase FROM events),
    a AS (SELECT event_type, count(*) FILTER (WHERE phase = 'single') AS requests, round(quantile_disc(ms, 0.5) FILTER (WHERE phase = 'single'), 6) AS p50_ms, round(quantile_disc(ms, 0.95) FILTER (WHERE phase = 'single'), 6) AS p95_ms,
    round(avg(ms) FILTER (WHERE phase = 'single'), 6) AS mean_ms, round(avg(tokens) FILTER (WHERE phase = 'single'), 6) AS tokens_per_request, round(avg(passes) FILTER (WHERE phase = 'single'), 6) AS passes_per_request,
    count(*) FILTER (WHERE phase = 'batch') AS batches, median(ms / 1000) FILTER (WHERE phase = 'batch') AS m FROM t GROUP BY 1)
    SELECT * EXCLUDE (m), round(m, 6) AS median_batch_seconds, round(32 / m, 3) AS requests_per_second, round(256 / m, 3) AS decisions_per_second FROM a"""
)
def profile_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as timings: warm-ups, single requests and batches of 32 with eight questions; one type has no batches."""
    last = F.col("event_id") % 10
    phase = F.when(last == 0, "warmup").when((last < 7) | (F.col("event_type") == "click"), "single").otherwise("batch")
    rows = table(spark, sf_dir, "events").select("event_type", F.col("value").alias("ms"), (F.col("user_id") % 100).alias("tokens"), (F.col("event_id") % 4).alias("passes"), phase.alias("phase"))
    out = _rounded(reports.profile(rows, 32, 8, "event_type"), "p50_ms", "p95_ms", "mean_ms", "tokens_per_request", "passes_per_request", "median_batch_seconds")
    return out.withColumns({n: F.round(n, 3) for n in ("requests_per_second", "decisions_per_second")})


@query(
    f"""WITH {fx.EVAL_SQL}, c AS (SELECT * FROM ev WHERE system = 'converted_raw'), p AS (SELECT * FROM ev WHERE system = 'parent_raw'),
    j AS (SELECT c.record_id, c.probs AS cp, p.probs AS pp, c.pred AS a, p.pred AS b, unnest([1, 2, 3, 4]) AS i FROM c JOIN p USING (record_id))
    SELECT record_id, (['de','en','es','fr'])[i] AS option, round(cp[i], 6) AS converted_raw, coalesce(a = (['de','en','es','fr'])[i], false) AS converted_raw_top, round(pp[i], 6) AS parent_raw,
    coalesce(b = (['de','en','es','fr'])[i], false) AS parent_raw_top, coalesce(a <> b, false) AS disagreement FROM j"""
)
def side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two systems' probabilities of every option, their marks and where they disagree."""
    out = reports.side_by_side(fx.evaluation_rows(spark, sf_dir), ["converted_raw", "parent_raw"], "converted_raw")
    return _rounded(out.drop("question"), "converted_raw", "parent_raw")


@query(
    f"""WITH {fx.GROUPS_SQL}, q AS (SELECT split, source AS source_family, lang AS schema_family, unnest(['choice', 'noul']) AS type, doc_id FROM grouped)
    SELECT split, CASE WHEN grouping(source_family) = 0 THEN 'source' WHEN grouping(schema_family) = 0 THEN 'schema' WHEN grouping(type) = 0 THEN 'type' ELSE 'all' END AS level,
    coalesce(source_family, schema_family, type) AS value, count(DISTINCT doc_id) AS records, count(*) AS questions FROM q GROUP BY GROUPING SETS ((split), (split, source_family), (split, schema_family), (split, type))"""
)
def manifest_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest's counts of records and questions, two questions a document."""
    rows = fx.scored_documents(spark, sf_dir)
    return reports.manifest_counts(rows.select("split", "source_family", F.col("lang").alias("schema_family"), F.col("doc_id").alias("record_id"), F.explode(F.array(F.lit("choice"), F.lit("noul"))).alias("type")))


@query(f"WITH {fx.SCORED_SQL} SELECT count(*) AS questions, round(avg({fx.nll_sql('1.0')}), 6) AS nll FROM scored WHERE split = 'dev' AND label IS NOT NULL")
def development_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(reports.dev_loss(fx.scored_documents(spark, sf_dir)), "nll")


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test documents as records of one choice between languages; those of 400 words and more are refused."""
    docs = fx.scored_documents(spark, sf_dir).where(F.col("split") == "test").select("doc_id", "lang", "source_family")
    texts = table(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split("text", " ")).alias("words"))
    keys = F.array(*(F.lit(k) for k in fx.LANGS))
    one = F.struct(F.lit("language").alias("qid"), F.lit("choice").alias("type"), keys.alias("keys"), F.col("lang").alias("gold"), F.lit(None).cast("string").alias("task"))
    rows = docs.join(texts, "doc_id")
    return rows.select(F.col("doc_id").alias("record_id"), "source_family", F.lit("documents.language").alias("schema_family"), F.col("text").alias("state"), F.array(one).alias("questions"), F.when(F.col("words") < 400, "ok").otherwise("state_over_limit").alias("context"))


_PANEL_SQL = f"""{fx.GROUPS_SQL}, b AS (SELECT doc_id, lang AS gold, len(string_split(text, ' ')) < 400 AS fine, {fx.logits_sql()} AS lg FROM grouped WHERE split = 'test')"""
_ROW = "(['de','en','es','fr'])[list_position(p, list_max(p))] AS pred, round(list_max(p), 6) AS top, round(p[2], 6) AS p_en"


@query(
    f"""WITH {_PANEL_SQL}, s AS (SELECT *, unnest([{{'system': 'converted_raw', 'variant': 'canonical', 't': 1.0}}, {{'system': 'converted_cal', 'variant': 'canonical', 't': 2.0}}, {{'system': 'converted_raw', 'variant': 'order0', 't': 1.0}}], recursive := true) FROM b),
    q AS (SELECT doc_id, gold, fine, system, variant, CASE WHEN fine THEN {fx.softmax_sql("lg", "t::DOUBLE")} END AS p FROM s)
    SELECT doc_id AS record_id, system, variant, fine AS eligible, CASE WHEN NOT fine THEN 'admission: state_over_limit' END AS reason, {_ROW}, coalesce((['de','en','es','fr'])[list_position(p, list_max(p))] = gold, CASE WHEN gold IS NOT NULL THEN false END) AS correct FROM q"""
)
def converted_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A panel through the marker scorer: raw and calibrated, in the canonical and in a drawn order of options; refusals."""
    answers = lambda rows: scoring.score(rows, scoring.MarkerScorer(fx.MARKERS, fx.SCALE, fx.ENGLISH), keys="shown")
    rows = panels.converted_rows(_panel(spark, sf_dir), answers, "test", 2.0, order_variants=1, seed=fx.SEED)
    return _rounded(rows.select("record_id", "system", "variant", "eligible", "reason", "pred", F.array_max("probs").alias("top"), F.get("probs", F.lit(1)).alias("p_en"), "correct"), "top", "p_en")


def _turned(s: int) -> str:
    """Logits with a half more for the option that is shown first in rotation s."""
    return f"list_transform(lg, lambda v, i: v + CASE WHEN i = {s + 1} THEN 0.5 ELSE 0.0 END)"


_TURNS = ", ".join(fx.softmax_sql(_turned(s)) for s in range(4))


@query(
    f"""WITH {_PANEL_SQL}, t AS (SELECT doc_id, gold, [{_TURNS}] AS turns FROM b), m AS (SELECT *, list_transform(range(1, 5), lambda k: list_sum(list_transform(turns, lambda u: ln(greatest(u[k], 1e-9)))) / 4) AS logs FROM t),
    q AS (SELECT doc_id, 'parent_raw' AS system, 1 AS layouts, turns[1] AS p FROM t UNION ALL SELECT doc_id, 'parent_cyclic', 4, {fx.softmax_sql("logs")} FROM m)
    SELECT doc_id AS record_id, system, CAST(layouts AS INTEGER) AS layouts, {_ROW} FROM q"""
)
def teacher_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same panel through a scorer that favours what is shown first: one layout, and all rotations combined."""
    biased = scoring.PositionBiased(scoring.MarkerScorer(fx.MARKERS, fx.SCALE, fx.ENGLISH), [0.5, 0.0, 0.0, 0.0])
    rows = panels.scorer_rows(_panel(spark, sf_dir), lambda r: scoring.score(r, biased, keys="shown"), "test", seed=fx.SEED)
    return _rounded(rows.select("record_id", "system", "layouts", "pred", F.array_max("probs").alias("top"), F.get("probs", F.lit(1)).alias("p_en")), "top", "p_en")


@query(
    f"""WITH {_PANEL_SQL} SELECT doc_id AS record_id, doc_id % 3 <> 2 AS parse_ok, doc_id % 3 = 0 AS answered, CASE WHEN doc_id % 3 = 0 THEN (['de','en','es','fr'])[1 + doc_id % 4] END AS pred,
    CASE WHEN gold IS NOT NULL THEN coalesce(doc_id % 3 = 0 AND (['de','en','es','fr'])[1 + doc_id % 4] = gold, false) END AS correct, CASE WHEN doc_id % 3 = 1 THEN '{{"language": "it"}} is it' WHEN doc_id % 3 = 2 THEN 'none' END AS text FROM b"""
)
def generated_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same panel answered by texts: with an object that names a key, one that names none, and without an object."""
    k = F.col("record_id")
    right = F.concat(F.lit('I say {"language": "'), F.get(F.array(*(F.lit(x) for x in fx.LANGS)), (k % 4).cast("int")), F.lit('"}.'))
    text = F.when(k % 3 == 0, right).when(k % 3 == 1, '{"language": "it"} is it').otherwise("none")
    rows = panels.json_rows(_panel(spark, sf_dir), lambda r: r.withColumn("text", text), "test")
    return rows.select("record_id", "parse_ok", "answered", "pred", "correct", "text")


_RIGHT = "CASE WHEN eligible THEN CASE WHEN pred = gold THEN 1.0::DOUBLE ELSE 0.0 END END"
_N = "count(*) FILTER (WHERE eligible)"


@query(
    f"""WITH {fx.EVAL_SQL}, l AS (SELECT * FROM ev WHERE gold IS NOT NULL), o AS (SELECT system, avg({_RIGHT}) AS a, {_N} AS n, count(*) AS t, count(*) FILTER (WHERE NOT eligible) AS i FROM l GROUP BY 1),
    s AS (SELECT c.system, count(*) AS n, avg(CASE WHEN c.pred = p.pred THEN 1.0::DOUBLE ELSE 0.0 END) AS g FROM ev c JOIN ev p ON p.record_id = c.record_id AND p.system = 'parent_raw' AND c.system <> 'parent_raw' AND c.pred IS NOT NULL AND p.pred IS NOT NULL GROUP BY 1),
    k AS (SELECT record_id FROM ev WHERE system = 'parent_raw' AND eligible)
    SELECT section, line, "column", round(value, 6) AS value, n FROM (
      SELECT 'systems' AS section, system AS line, 'accuracy' AS "column", a AS value, n FROM o UNION ALL SELECT 'systems', system, 'vs_base', CASE WHEN system <> 'parent_raw' THEN 100 * (a - (SELECT a FROM o WHERE system = 'parent_raw')) END, n FROM o
      UNION ALL SELECT 'systems', system, 'ineligible', i, t FROM o UNION ALL SELECT 'systems', system, 'agreement', g, n FROM s
      UNION ALL SELECT 'task', task, system, avg({_RIGHT}), {_N} FROM ev GROUP BY 2, 3 UNION ALL SELECT 'source_family', source_family, system, avg({_RIGHT}), {_N} FROM l GROUP BY 2, 3
      UNION ALL SELECT 'like_for_like', 'parent_raw', system, avg({_RIGHT}), {_N} FROM l WHERE record_id IN (SELECT record_id FROM k) GROUP BY 3)"""
)
def summary_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every figure of three systems' report."""
    return _rounded(summary.cells(fx.evaluation_rows(spark, sf_dir), "parent_raw", "parent_raw", ["parent_raw"]), "value")
