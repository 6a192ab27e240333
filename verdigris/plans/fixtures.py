"""Scored rows over the test tables: a marker scorer over documents and evaluation rows of three systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import numeric as nm
from verdigris.operators import splits
from verdigris.session import table

SEED = 42
LANGS = ("de", "en", "es", "fr")
#: Characters that mark a language; English has a constant instead.
MARKERS = {"de": "äöüß", "es": "ñáíóú", "fr": "éèêçà"}
SCALE, ENGLISH = 200.0, 4.0


def marker_logits(text: Column, english: float = ENGLISH) -> Column:
    """A logit for each of LANGS: marker characters a text, scaled."""
    low = F.lower(text)
    share = lambda marks: F.lit(SCALE) * (F.length(low) - F.length(F.translate(low, marks, ""))) / F.greatest(F.length(low), F.lit(1))
    return F.array(*(F.lit(english) if k == "en" else share(MARKERS[k]) for k in LANGS))


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with split, logits and label: a projection of the scan."""
    docs = splits.with_groups(table(spark, sf_dir, "documents"), "documents", "text", SEED)
    label = (F.array_position(F.array(*(F.lit(k) for k in LANGS)), F.col("lang")) - 1).cast("int")
    return docs.select("doc_id", "lang", "group_id", "text_sha256", "split", F.lit("choice").alias("type"), F.col("source").alias("source_family"), label.alias("label"), marker_logits(F.col("text")).alias("logits"))


def evaluation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of systems converted_raw, converted_cal (T = 2) and parent_raw (other constant; not eligible for every 7th document, unanswered for every 11th)."""
    docs = splits.with_groups(table(spark, sf_dir, "documents"), "documents", "text", SEED).where(F.col("split") == "test")
    keys = F.array(*(F.lit(k) for k in LANGS))
    base = docs.select("doc_id", F.col("lang").alias("gold"), F.col("source").alias("source_family"), marker_logits(F.col("text")).alias("z"), marker_logits(F.col("text"), 2.0).alias("zp"))
    systems = F.array(
        F.struct(F.lit("converted_raw").alias("system"), F.col("z").alias("logits"), F.lit(1.0).alias("t"), F.lit(True).alias("eligible"), F.lit(True).alias("answers")),
        F.struct(F.lit("converted_cal").alias("system"), F.col("z").alias("logits"), F.lit(2.0).alias("t"), F.lit(True).alias("eligible"), F.lit(True).alias("answers")),
        F.struct(F.lit("parent_raw").alias("system"), F.col("zp").alias("logits"), F.lit(1.0).alias("t"), (F.col("doc_id") % 7 != 0).alias("eligible"), (F.col("doc_id") % 11 != 0).alias("answers")),
    )
    rows = base.select("doc_id", "gold", "source_family", F.inline(systems))
    rows = rows.select("*", nm.softmax(F.col("logits"), F.col("t")).alias("p"))
    probs = F.when(F.col("eligible") & F.col("answers"), F.col("p"))
    rows = rows.withColumn("probs", probs).withColumn("keys", keys)
    return rows.select(
        "system",
        F.lit("canonical").alias("variant"),
        F.col("doc_id").alias("record_id"),
        F.lit("language").alias("question"),
        F.lit("choice").alias("type"),
        F.concat(F.lit("lang_"), F.col("gold")).alias("task"),
        "source_family",
        "keys",
        "probs",
        F.when(F.col("probs").isNotNull(), F.get("keys", nm.argmax(F.col("probs")))).alias("pred"),
        "gold",
        "eligible",
        F.lit(None).cast("double").alias("expected_level"),
    )


#: The same in DuckDB SQL, as common table expressions.
NORM = r"trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g'))"
GROUPS_SQL = rf"""
g0 AS (SELECT *, sha256({NORM}) AS text_sha256 FROM documents),
g1 AS (SELECT *, 'documents/' || substr(text_sha256, 1, 20) AS group_id FROM g0),
g2 AS (SELECT *, CAST(('0x' || substr(sha256('{SEED}:split:' || group_id), 1, 16)) AS UBIGINT) % 10 AS b FROM g1),
grouped AS (SELECT *, CASE WHEN b < 7 THEN 'train' WHEN b = 7 THEN 'dev' WHEN b = 8 THEN 'calibration' ELSE 'test' END AS split FROM g2)"""


def logits_sql(english: float = ENGLISH) -> str:
    part = lambda m: f"{SCALE}::DOUBLE * (length(lower(text)) - length(translate(lower(text), '{m}', ''))) / greatest(length(lower(text)), 1)"
    return "[" + ", ".join(f"{english}::DOUBLE" if k == "en" else part(MARKERS[k]) for k in LANGS) + "]"


SCORED_SQL = f"""{GROUPS_SQL},
scored AS (SELECT doc_id, lang, group_id, text_sha256, split, 'choice' AS type, source AS source_family,
  list_position(['de','en','es','fr'], lang) - 1 AS label, {logits_sql()} AS logits FROM grouped)"""


def nll_sql(t: str, logits: str = "logits", label: str = "label") -> str:
    return f"(ln(list_sum(list_transform({logits}, lambda z: exp((z - list_max({logits})) / {t})))) - ({logits}[{label} + 1] - list_max({logits})) / {t})"


def softmax_sql(logits: str, t: str = "1.0") -> str:
    powers = f"list_transform({logits}, lambda z: exp((z - list_max({logits})) / {t}))"
    return f"list_transform({powers}, lambda e: e / list_sum({powers}))"


EVAL_SQL = f"""{GROUPS_SQL},
eb AS (SELECT doc_id, lang AS gold, source AS source_family, {logits_sql()} AS z, {logits_sql(2.0)} AS zp FROM grouped WHERE split = 'test'),
es AS (SELECT doc_id, gold, source_family, 'converted_raw' AS system, z AS logits, 1.0::DOUBLE AS t, true AS eligible, true AS answers FROM eb
 UNION ALL SELECT doc_id, gold, source_family, 'converted_cal', z, 2.0, true, true FROM eb
 UNION ALL SELECT doc_id, gold, source_family, 'parent_raw', zp, 1.0, doc_id % 7 <> 0, doc_id % 11 <> 0 FROM eb),
ep AS (SELECT *, CASE WHEN eligible AND answers THEN {softmax_sql('logits', 't')} END AS probs FROM es),
ev AS (SELECT system, doc_id AS record_id, 'choice' AS type, 'lang_' || gold AS task, source_family, probs, gold, eligible,
  CASE WHEN probs IS NOT NULL THEN (['de','en','es','fr'])[list_position(probs, list_max(probs))] END AS pred FROM ep)"""

METRICS_SQL = """count(*) FILTER (WHERE eligible) AS n, count(*) AS n_total, count(*) FILTER (WHERE eligible AND pred IS NOT NULL) AS answered,
 count(*) FILTER (WHERE NOT eligible) AS ineligible, count(*) FILTER (WHERE eligible AND pred IS NULL) AS unanswered,
 round(avg(CASE WHEN eligible THEN CASE WHEN pred = gold THEN 1.0::DOUBLE ELSE 0.0 END END), 6) AS accuracy,
 round(avg(CASE WHEN eligible AND pred IS NOT NULL THEN CASE WHEN pred = gold THEN 1.0::DOUBLE ELSE 0.0 END END), 6) AS accuracy_answered,
 round(avg(CASE WHEN eligible AND probs IS NOT NULL THEN -ln(greatest(probs[list_position(['de','en','es','fr'], gold)], 1e-12)) END), 6) AS nll,
 round(avg(CASE WHEN eligible AND probs IS NOT NULL THEN list_sum(list_transform(probs, lambda p, i: (p - CASE WHEN i = list_position(['de','en','es','fr'], gold) THEN 1.0 ELSE 0.0 END) ** 2)) END), 6) AS brier"""
METRIC_NAMES = ("n", "n_total", "answered", "ineligible", "unanswered", "accuracy", "accuracy_answered", "nll", "brier")
