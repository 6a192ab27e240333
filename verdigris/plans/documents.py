"""Queries over documents and embeddings: calibration, splits, leakage, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import numeric as nm
from verdigris.functions import text as tx
from verdigris.operators import calibration, evaluation, leakage, splits
from verdigris.plans import fixtures as fx
from verdigris.session import table
from verdigris.sources import sinks

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


GRID = nm.temperature_grid()
_GRID_SQL = "grid AS (SELECT i AS t_index, exp(ln(0.25) + i * (ln(4.0) - ln(0.25)) / 120) AS t FROM range(121) r(i))"
_LOSS_SQL = f"losses AS (SELECT t_index, t, avg({fx.nll_sql('t')}) AS loss FROM scored CROSS JOIN grid WHERE split = 'calibration' GROUP BY ALL)"
_BEST_SQL = "best AS (SELECT t_index, t, loss FROM losses ORDER BY loss, t_index LIMIT 1)"


@query(f"WITH {fx.SCORED_SQL}, {_GRID_SQL}, {_LOSS_SQL} SELECT CAST(t_index AS INTEGER) AS t_index, round(t, 6) AS temperature, round(loss, 6) AS loss FROM losses")
def fit_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.scored_documents(spark, sf_dir).where(F.col("split") == "calibration")
    return rounded(calibration.grid_losses(rows, GRID), "temperature", "loss")


def _best(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = fx.scored_documents(spark, sf_dir)
    return rows, calibration.best_temperature(calibration.grid_losses(rows.where(F.col("split") == "calibration"), GRID))


_ARGMAX = "list_position(logits, list_max(logits)) - 1"


@query(
    f"""WITH {fx.SCORED_SQL}, {_GRID_SQL}, {_LOSS_SQL}, {_BEST_SQL},
    p AS (SELECT s.*, b.t, b.t_index, {fx.softmax_sql('logits')} AS raw, {fx.softmax_sql('logits', 'b.t')} AS cal FROM scored s CROSS JOIN best b WHERE split = 'test')
    SELECT count(*) AS n, CAST(max(t_index) AS INTEGER) AS t_index, max(t_index) IN (0, 120) AS grid_edge,
      round(avg(CASE WHEN {_ARGMAX} = label THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS accuracy,
      round(avg({fx.nll_sql('1.0')}), 6) AS nll_raw, round(avg({fx.nll_sql('t')}), 6) AS nll_calibrated,
      round(avg(list_sum(list_transform(raw, lambda p, i: (p - CASE WHEN i = label + 1 THEN 1.0 ELSE 0.0 END) ** 2))), 6) AS brier_raw,
      round(avg(list_sum(list_transform(cal, lambda p, i: (p - CASE WHEN i = label + 1 THEN 1.0 ELSE 0.0 END) ** 2))), 6) AS brier_calibrated
    FROM p"""
)
def calibrated_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: split by text group, temperature fitted on calibration, accuracy and losses on test."""
    rows, best = _best(spark, sf_dir)
    rows = rows.where(F.col("split") == "test").withColumn("best", best.select(F.struct("temperature", "t_index")).scalar())  # one plan of the grid
    rows = rows.withColumns({"t": F.col("best.temperature"), "t_index": F.col("best.t_index")})
    scored = rows.select("t_index", "label", (nm.argmax(F.col("logits")) == F.col("label")).cast("double").alias("right"), nm.nll_at(F.col("logits"), F.col("label")).alias("raw"), nm.nll_at(F.col("logits"), F.col("label"), F.col("t")).alias("cal"), nm.softmax(F.col("logits")).alias("p"), nm.softmax(F.col("logits"), F.col("t")).alias("q"))
    out = scored.agg(
        F.count("*").alias("n"),
        F.max("t_index").cast("int").alias("t_index"),
        F.max("t_index").isin(0, 120).alias("grid_edge"),
        F.avg("right").alias("accuracy"),
        F.avg("raw").alias("nll_raw"),
        F.avg("cal").alias("nll_calibrated"),
        F.avg(nm.brier(F.col("p"), F.col("label"))).alias("brier_raw"),
        F.avg(nm.brier(F.col("q"), F.col("label"))).alias("brier_calibrated"),
    )
    return rounded(out, "accuracy", "nll_raw", "nll_calibrated", "brier_raw", "brier_calibrated")


@query(
    f"""WITH {fx.SCORED_SQL}, {_GRID_SQL}, {_LOSS_SQL}, {_BEST_SQL},
    r AS (SELECT s.*, b.t FROM scored s CROSS JOIN best b WHERE split = 'test')
    SELECT CASE WHEN grouping(type) = 1 AND grouping(source_family) = 1 THEN 'overall' WHEN grouping(type) = 0 THEN 'type' ELSE 'source_family' END AS level,
      coalesce(type, source_family) AS value, count(*) AS questions, round(avg(CASE WHEN {_ARGMAX} = label THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS accuracy,
      round(avg({fx.nll_sql('1.0')}), 6) AS nll_raw, round(avg({fx.nll_sql('t')}), 6) AS nll_calibrated
    FROM r GROUP BY GROUPING SETS ((), (type), (source_family))"""
)
def calibration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, best = _best(spark, sf_dir)
    return rounded(calibration.summary(rows.where(F.col("split") == "test"), best), "accuracy", "nll_raw", "nll_calibrated")


@query(
    f"""WITH o AS (SELECT list(embedding ORDER BY vec_id) AS opts FROM embeddings WHERE vec_id < 4),
    z AS (SELECT vec_id, list_transform(opts, lambda o: list_inner_product(o::DOUBLE[], embedding::DOUBLE[]) / sqrt(64.0)) AS logits FROM embeddings CROSS JOIN o),
    p AS (SELECT vec_id, {fx.softmax_sql('logits')} AS p FROM z)
    SELECT vec_id, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS choice, round(list_max(p), 6) AS top_probability, round(p[1], 6) AS p_first FROM p"""
)
def pointer_head_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled dot products of every vector with four option vectors, softmax, first largest."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("h"))
    options = vectors.where("vec_id < 4").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "h"))), lambda x: x["h"]))
    logits = F.transform("options", lambda o: nm.dot(o, F.col("h")) / 8.0)
    p = vectors.withColumn("options", options.scalar()).select("vec_id", logits.alias("z")).select("vec_id", nm.softmax(F.col("z")).alias("p"))
    return p.select("vec_id", nm.argmax(F.col("p")).alias("choice"), F.round(F.array_max("p"), 6).alias("top_probability"), F.round(F.col("p")[0], 6).alias("p_first"))


@query(f"WITH {fx.GROUPS_SQL} SELECT text_sha256, count(*) AS documents, min(doc_id) AS first_doc FROM grouped GROUP BY 1")
def norm_hash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = splits.with_groups(table(spark, sf_dir, "documents"), "documents", "text", fx.SEED)
    return docs.groupBy("text_sha256").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"))


@query(f"WITH {fx.GROUPS_SQL} SELECT doc_id, group_id, split FROM grouped")
def group_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.with_groups(table(spark, sf_dir, "documents"), "documents", "text", fx.SEED).select("doc_id", "group_id", "split")


def _source_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = splits.with_groups(table(spark, sf_dir, "documents"), "documents", "text", fx.SEED)
    return docs.groupBy("source", "group_id").agg(F.count("*").alias("rows"))


_SOURCE_GROUPS = f"sg AS (SELECT source, group_id, count(*) AS rows FROM grouped GROUP BY ALL), ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha256('{fx.SEED}:order:' || group_id), group_id) AS rank FROM sg)"


@query(f"WITH {fx.GROUPS_SQL}, {_SOURCE_GROUPS} SELECT source, group_id, rows, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 5")
def hash_order_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five groups of each source in hash order: a top-k report."""
    return splits.first_groups(_source_groups(spark, sf_dir), "source", fx.SEED, 5)


@query(
    f"""WITH RECURSIVE {fx.GROUPS_SQL}, {_SOURCE_GROUPS},
    fold AS (SELECT source, rank, group_id, rows, rows <= 20 AS taken, CASE WHEN rows <= 20 THEN rows ELSE 0 END AS total FROM ranked WHERE rank = 1
      UNION ALL SELECT r.source, r.rank, r.group_id, r.rows, f.total + r.rows <= 20, f.total + CASE WHEN f.total + r.rows <= 20 THEN r.rows ELSE 0 END
      FROM fold f JOIN ranked r ON r.source = f.source AND r.rank = f.rank + 1)
    SELECT source, group_id, CAST(rank AS INTEGER) AS rank, CAST(rows AS BIGINT) AS rows FROM fold WHERE taken"""
)
def greedy_group_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole groups of each source up to 20 documents: the cap is what the operator samples by."""
    return splits.take_groups(_source_groups(spark, sf_dir), "source", "rows", fx.SEED, cap=20)


@query(f"WITH {fx.GROUPS_SQL} SELECT split, lang, count(*) AS documents, count(DISTINCT group_id) AS groups FROM grouped GROUP BY 1, 2")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = splits.with_groups(table(spark, sf_dir, "documents"), "documents", "text", fx.SEED)
    return docs.groupBy("split", "lang").agg(F.count("*").alias("documents"), F.count_distinct("group_id").alias("groups"))


@query(
    f"""WITH {fx.GROUPS_SQL}, bad AS (SELECT source, text_sha256, group_id, CASE WHEN doc_id % 2 = 0 THEN 'test' ELSE split END AS split FROM grouped)
    SELECT 'group' AS kind, count(*) FILTER (WHERE n > 1) AS violations FROM (SELECT count(DISTINCT split) AS n FROM bad GROUP BY group_id)
    UNION ALL SELECT 'text', count(*) FILTER (WHERE n > 1) FROM (SELECT count(DISTINCT split) AS n FROM bad GROUP BY source, text_sha256)
    UNION ALL SELECT 'group_rule', count(*) FILTER (WHERE n > 1) FROM (SELECT count(DISTINCT split) AS n FROM grouped GROUP BY group_id)
    UNION ALL SELECT 'text_rule', count(*) FILTER (WHERE n > 1) FROM (SELECT count(DISTINCT split) AS n FROM grouped GROUP BY source, text_sha256)"""
)
def check_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations under the rule (none) and under a broken one that puts even documents into test."""
    docs = splits.with_groups(table(spark, sf_dir, "documents"), "documents", "text", fx.SEED).withColumn("source_family", F.col("source"))
    broken = docs.withColumn("split", F.when(F.col("doc_id") % 2 == 0, "test").otherwise(F.col("split")))
    return splits.disjointness(broken).unionByName(splits.disjointness(docs).withColumn("kind", F.concat("kind", F.lit("_rule"))))


@query(f"WITH {fx.SCORED_SQL} SELECT split, source_family, type, count(*) AS questions, count(DISTINCT doc_id) AS records FROM scored GROUP BY ALL")
def manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.manifest(fx.scored_documents(spark, sf_dir).withColumn("record_id", F.col("doc_id")))


@query(f"WITH {fx.GROUPS_SQL}, h AS (SELECT DISTINCT source, text_sha256 FROM grouped WHERE split = 'test' OR doc_id % 10 = 3) SELECT g.doc_id, g.source FROM grouped g LEFT JOIN h USING (source, text_sha256) WHERE h.source IS NULL")
def official_overlap_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text isn't among the same source's held rows (its test split and every tenth document)."""
    docs = splits.with_groups(table(spark, sf_dir, "documents"), "documents", "text", fx.SEED).select("doc_id", "source", "text_sha256", "split")
    held = docs.where((F.col("split") == "test") | (F.col("doc_id") % 10 == 3))
    return leakage.excluding(docs, held, "source", "text_sha256").select("doc_id", "source")


_LINES = r"""lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
bl AS (SELECT unnest(string_split(text, chr(10))) AS line FROM benchmark),
hl AS (SELECT doc_id, trim(regexp_replace(replace(lower(line), 'ß', 'ss'), '\s+', ' ', 'g')) AS n FROM lines),
hb AS (SELECT DISTINCT trim(regexp_replace(replace(lower(line), 'ß', 'ss'), '\s+', ' ', 'g')) AS n FROM bl)"""


def _line_hashes(df: DataFrame) -> DataFrame:
    """Hashes of the lines with five words or more: a normalised line has a space between two words, so no regex counts them."""
    lines = F.filter(F.transform(F.split("text", "\n"), tx.normalised), lambda s: F.length(s) - F.length(F.translate(s, " ", "")) >= 4)
    return df.withColumn("hashes", F.array_distinct(F.transform(lines, lambda s: F.sha2(s, 256))))


@query(rf"WITH {_LINES} SELECT DISTINCT doc_id FROM hl JOIN hb USING (n) WHERE len(string_split(n, ' ')) >= 5")
def state_hash_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a line of five words or more that a benchmark item has too."""
    docs, bench = (_line_hashes(table(spark, sf_dir, t)) for t in ("documents", "benchmark"))
    return leakage.colliding(docs, "doc_id", "hashes", bench.select(F.explode("hashes").alias("hash")))


@query(f"WITH {fx.GROUPS_SQL}, t AS (SELECT DISTINCT text_sha256 FROM grouped WHERE source = 'src0') SELECT doc_id, text_sha256 FROM grouped WHERE source <> 'src0' AND text_sha256 NOT IN (SELECT text_sha256 FROM t)")
def heldout_panel_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the other sources whose text isn't in the first one: the check across sources."""
    docs = splits.with_groups(table(spark, sf_dir, "documents"), "documents", "text", fx.SEED).select("doc_id", "source", "text_sha256")
    return leakage.excluding(docs.where("source <> 'src0'"), docs.where("source = 'src0'"), "text_sha256").select("doc_id", "text_sha256")


@query(
    f"""WITH {fx.GROUPS_SQL}, f AS (SELECT text_sha256, min(doc_id) AS first_doc FROM grouped GROUP BY 1),
    r AS (SELECT source, CASE WHEN g.doc_id <> f.first_doc THEN 'overlap' WHEN len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) > 1000 THEN 'context' END AS reason FROM grouped g JOIN f USING (text_sha256))
    SELECT source, count(*) AS read, count(*) FILTER (WHERE reason IS NULL) AS kept, count(*) FILTER (WHERE reason = 'overlap') AS dropped_overlap, count(*) FILTER (WHERE reason = 'context') AS dropped_context FROM r GROUP BY 1"""
)
def exclusion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = splits.with_groups(table(spark, sf_dir, "documents"), "documents", "text", fx.SEED).select("doc_id", "source", "text_sha256", tx.word_count(F.col("text")).alias("words"))
    first = docs.groupBy("text_sha256").agg(F.min("doc_id").alias("first_doc"))
    reason = F.when(F.col("doc_id") != F.col("first_doc"), "overlap").when(F.col("words") > 1000, "context")
    return leakage.exclusion_report(docs.join(first, "text_sha256").withColumn("reason", reason), "source", "reason")


def _round_metrics(df: DataFrame) -> DataFrame:
    return rounded(df, "accuracy", "accuracy_answered", "nll", "brier")


@query(
    f"""WITH {fx.EVAL_SQL} SELECT system, CASE WHEN grouping(task) = 0 THEN 'task' WHEN grouping(source_family) = 0 THEN 'source_family' WHEN grouping(type) = 0 THEN 'type' ELSE 'overall' END AS level,
    coalesce(task, source_family, type) AS value, {fx.METRICS_SQL} FROM ev GROUP BY GROUPING SETS ((system), (system, task), (system, source_family), (system, type))"""
)
def metrics_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.panel_metrics(fx.evaluation_rows(spark, sf_dir))
    return _round_metrics(out.select("system", "level", "value", *fx.METRIC_NAMES))


@query(
    f"""WITH {fx.EVAL_SQL} SELECT 'converted_raw_vs_parent_raw' AS pair, count(*) AS n, round(avg(CASE WHEN a.pred = b.pred THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS agreement
    FROM ev a JOIN ev b USING (record_id) WHERE a.system = 'converted_raw' AND b.system = 'parent_raw' AND a.pred IS NOT NULL AND b.pred IS NOT NULL"""
)
def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.agreement(fx.evaluation_rows(spark, sf_dir), "converted_raw", "parent_raw")
    return rounded(out.select(F.lit("converted_raw_vs_parent_raw").alias("pair"), "n", "agreement"), "agreement")


@query(f"WITH {fx.EVAL_SQL} SELECT system, {fx.METRICS_SQL} FROM ev WHERE record_id IN (SELECT record_id FROM ev WHERE system = 'parent_raw' AND eligible) GROUP BY system")
def like_for_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_metrics(evaluation.like_for_like(fx.evaluation_rows(spark, sf_dir), "parent_raw").select("system", *fx.METRIC_NAMES))


@query(
    f"""WITH {fx.EVAL_SQL}, base AS (SELECT * FROM ev WHERE probs IS NOT NULL),
    var AS (SELECT system, record_id, pred AS base_pred, probs AS base, list_transform(probs, lambda p, i: abs(p - probs[len(probs) + 1 - i])) AS d, (['fr','es','en','de'])[list_position(probs, list_max(probs))] AS vpred FROM base)
    SELECT system, count(*) AS n, round(avg(CASE WHEN vpred <> base_pred THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS flip_rate, round(avg(list_max(d)), 6) AS mean_max_dp, round(max(list_max(d)), 6) AS max_dp FROM var GROUP BY 1"""
)
def order_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against a scorer that looks at positions only: options reversed, probabilities as they were."""
    rows = fx.evaluation_rows(spark, sf_dir)
    turned = rows.withColumn("variant", F.lit("reversed")).withColumn("keys", F.reverse("keys"))
    turned = turned.withColumn("pred", F.when(F.col("probs").isNotNull(), F.get("keys", nm.argmax(F.col("probs")))))
    return rounded(evaluation.order_sensitivity(rows.unionByName(turned)), "flip_rate", "mean_max_dp", "max_dp")


@query(
    f"""WITH {fx.EVAL_SQL}, a AS (SELECT * FROM ev WHERE system = 'converted_raw'), b AS (SELECT * FROM ev WHERE system = 'parent_raw' AND probs IS NOT NULL),
    j AS (SELECT list_max(list_transform(a.probs, lambda p, i: abs(p - b.probs[i]))) AS change, a.pred <> b.pred AS flip, list_reverse_sort(a.probs)[1] - list_reverse_sort(a.probs)[2] AS margin FROM a JOIN b USING (record_id))
    SELECT count(*) AS n, round(max(change), 6) AS max_dp, count(*) FILTER (WHERE flip) AS flips, round(max(margin) FILTER (WHERE flip), 6) AS max_flip_margin FROM j"""
)
def compare_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two systems with other constants, so that answers flip."""
    rows = fx.evaluation_rows(spark, sf_dir).where(F.col("probs").isNotNull())
    out = evaluation.compared(*(rows.where(F.col("system") == s) for s in ("converted_raw", "parent_raw")), "record_id")
    return rounded(out, "max_dp", "max_flip_margin")
