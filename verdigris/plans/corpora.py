"""Queries over files that Spark writes of the tables: custom corpora, digests, counted manifests, collected targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import policy as pl
from verdigris.functions import python_udfs as py
from verdigris.operators import cases, encoding, splits
from verdigris.plans import build
from verdigris.plans import fixtures as fx
from verdigris.session import table
from verdigris.sources import catalog, digests, sinks
from verdigris.sources import requests as rq
from verdigris.store import new_path
from verdigris.streaming import resume

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_CUSTOM = rf"""f AS (SELECT DISTINCT sha256({fx.NORM}) AS hash FROM documents WHERE doc_id % 10 = 0),
    c AS (SELECT doc_id, lang, 'note: ' || coalesce(lang, '') || chr(10) || 'body: ' || text AS state, sha256({fx.NORM}) AS body, len(string_split({fx.NORM}, ' ')) AS words FROM documents),
    r AS (SELECT *, sha256({fx.NORM.replace("text", "state")}) AS text_sha256, words >= 5 AND body IN (SELECT hash FROM f) AS excluded FROM c),
    s AS (SELECT *, CAST('0x' || substr(sha256('{fx.SEED}:split:own/' || substr(text_sha256, 1, 20)), 1, 16) AS UBIGINT) % 10 AS b FROM r)"""


def _custom_files(spark: SparkSession, sf_dir: str) -> str:
    """Where documents are written as a labelled corpus, in files of JSON lines."""
    docs = table(spark, sf_dir, "documents")
    names = F.create_map(*(F.lit(x) for k in fx.LANGS for x in (k, "")))
    asked = F.struct(F.lit("choice").alias("type"), F.lit("Which language?").alias("instructions"), names.alias("criteria"), F.col("lang").alias("label"))
    line = F.to_json(F.struct(F.struct(F.col("lang").alias("note"), F.col("text").alias("body")).alias("state"), F.struct(asked.alias("language")).alias("questions"), F.col("doc_id").cast("string").alias("notes")), {"ignoreNullFields": "false"})
    path = new_path(spark)
    docs.where(F.col("text").isNotNull()).select(line.alias("value")).write.text(path)
    return path


def _custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """That corpus' records; every tenth document's text is forbidden."""
    forbidden = table(spark, sf_dir, "documents").where("doc_id % 10 = 0").select(F.explode(py.state_hashes("text")).alias("hash"))
    return rq.custom_records(rq.labelled_lines(spark, _custom_files(spark, sf_dir)), "own", fx.SEED, forbidden, several=True)


@query(f"WITH {_CUSTOM} SELECT doc_id, CASE WHEN b < 7 THEN 'train' WHEN b = 7 THEN 'dev' WHEN b = 8 THEN 'calibration' ELSE 'test' END AS split, text_sha256, excluded, lang AS gold, lang IS NOT NULL AS valid FROM s WHERE state IS NOT NULL")
def custom_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A custom corpus: splits by text, and what shares a field of five words or more with a forbidden text."""
    return _custom(spark, sf_dir).select(F.col("notes").cast("long").alias("doc_id"), "split", "text_sha256", "excluded", "gold", "valid")


@query(f"WITH {_CUSTOM} SELECT 'own' AS source_family, count(*) AS read, count(*) FILTER (WHERE excluded) AS excluded_text_collision, CAST(0 AS BIGINT) AS no_question, count(*) FILTER (WHERE lang IS NULL AND NOT excluded) AS invalid_labels FROM s WHERE state IS NOT NULL")
def custom_corpus_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rq.custom_report(_custom(spark, sf_dir))


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'true' WHEN 1 THEN 'True' WHEN 2 THEN '1.50' WHEN 3 THEN '' WHEN 4 THEN CAST(o_custkey AS VARCHAR) ELSE 'a: ' || o_custkey || chr(10) || 'b:' || chr(10) || '  - False' || chr(10) || '  - null' END AS typed,
    CASE o_orderkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN '1e5' ELSE 'null' END AS text FROM orders""")
def typed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of every JSON type as they read, and texts that look like values of other types."""
    k, own = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    raw = F.when(k % 6 == 0, '"true"').when(k % 6 == 1, "true").when(k % 6 == 2, '"1.50"').when(k % 6 == 3, "null").when(k % 6 == 4, own).otherwise(F.concat(F.lit('{"a": '), own, F.lit(', "b": [false, "null"]}')))
    text = F.when(k % 3 == 0, "true").when(k % 3 == 1, "1e5").otherwise("null")
    return table(spark, sf_dir, "orders").select("o_orderkey", py.render_json(raw).alias("typed"), py.render_content(text).alias("text"))


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as prepared records of one to three questions."""
    docs = splits.with_groups(table(spark, sf_dir, "documents"), "documents", "text", fx.SEED)
    one = lambda i, t: F.struct(F.lit(f"q{i}").alias("qid"), F.lit(t).alias("type"))
    asked = F.slice(F.array(one(0, "choice"), one(1, "noul"), one(2, "score")), F.lit(1), (F.col("doc_id") % 3 + 1).cast("int"))
    return docs.select("doc_id", "split", F.col("source").alias("source_family"), F.coalesce("lang", F.lit("none")).alias("schema_family"), asked.alias("questions"))


@query(
    f"""WITH {fx.GROUPS_SQL}, p AS (SELECT doc_id, split, source, coalesce(lang, 'none') AS lang, doc_id % 3 + 1 AS n FROM grouped), q AS (SELECT split, unnest(['choice', 'noul', 'score'][1:n]) AS type FROM p)
    SELECT split, 'records' AS level, '' AS name, count(*) AS n FROM p GROUP BY 1 UNION ALL SELECT split, 'questions', '', CAST(sum(n) AS BIGINT) FROM p GROUP BY 1 UNION ALL SELECT split, 'source_family', source, count(*) FROM p GROUP BY 1, 3
    UNION ALL SELECT split, 'schema_family', lang, count(*) FROM p GROUP BY 1, 3 UNION ALL SELECT split, 'questions_by_type', type, count(*) FROM q GROUP BY 1, 3 UNION ALL SELECT split, 'checked', '', count(*) FROM p GROUP BY 1"""
)
def observed_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest that the writing job has counted, and the records of splits that its digests hold for when read back."""
    records, path = _prepared(spark, sf_dir), new_path(spark)
    # Names of the levels come with a corpus' catalogue; here they are the table's own, a few dozen.
    names = records.agg(F.sort_array(F.collect_set("source_family")), F.sort_array(F.collect_set("schema_family"))).first()
    manifest = sinks.write_counted(records, path, {"split": ("train", "dev", "calibration", "test"), "source_family": names[0], "schema_family": names[1]})
    rows = []
    for split, entry in manifest["files"].items():
        part = sinks.read_counted(spark, path, split)
        rows += [(split, "records", "", entry["records"]), (split, "questions", "", entry["questions"]), (split, "checked", "", part.rows.count())]
        part.check()
        rows += [(split, level, name, n) for level, found in manifest["counts"][split].items() for name, n in found.items()]
    return spark.createDataFrame(rows, "split string, level string, name string, n long")


@query("""SELECT event_type, CAST(sum(strlen(event_id || ':' || coalesce(props, '')) + 1) AS BIGINT) AS bytes, bool_or(event_id = 17) AS changed FROM events GROUP BY 1""")
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two copies of files of events, one of which has a changed line: bytes of each folder, and where ranges differ."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.concat_ws(":", F.col("event_id").cast("string"), F.coalesce("props", F.lit(""))).alias("value"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def written(lines: Column) -> DataFrame:
        path = new_path(spark)
        # Both copies are dealt by hash in a given number of parts and sorted by all that they have: range bounds are sampled and differ from run to run.
        dealt = rows.select("event_type", "event_id", "value", lines.alias("line")).repartition(parts, "event_type", "event_id").sortWithinPartitions("event_type", "event_id", "value")
        dealt.select("event_type", F.col("line").alias("value")).write.partitionBy("event_type").text(path)
        found = digests.range_digests(spark, path, 1 << 14)
        return found.withColumn("event_type", F.regexp_extract("folder", "event_type=(.*)$", 1)).withColumn("file", F.concat_ws("/", "event_type", F.substring_index("file", "-", 2)))

    one = written(F.col("value"))
    two = written(F.when(F.col("event_id") == 17, F.reverse("value")).otherwise(F.col("value")))
    differing = digests.changed_ranges(one, two).groupBy(F.substring_index("file", "/", 1).alias("event_type")).agg(F.lit(True).alias("changed"))
    sizes = one.groupBy("event_type").agg(F.sum("bytes").cast("long").alias("bytes"))
    return sizes.join(differing, "event_type", "left").select("event_type", "bytes", F.coalesce("changed", F.lit(False)).alias("changed"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS record_id, CAST(o_orderkey % 2 AS INTEGER) AS session, length(o_orderpriority) AS prompt_tokens FROM orders")
def collected_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets collected in two sessions: the first asks for every other order, the second for all and adds what is missing."""
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("record_id"), F.lit("q").alias("qid"), F.col("o_orderpriority").alias("text"))
    path, score = new_path(spark), lambda rows: rows.withColumns({"layouts": F.lit(1), "prompt_tokens": F.length("text").cast("long")})
    batch = max(256, wanted.count() // 4)
    for rows in (wanted.where(F.col("record_id").cast("long") % 2 == 0), wanted):
        resume.collect(spark, rows, score, path, "orders", per_batch=batch)
    return resume.collected(spark, path).select("record_id", F.col("session").cast("int").alias("session"), "prompt_tokens")


RECIPE = build.Recipe(seed=fx.SEED, pool=600, train=250, test=60, showcase=20, variants=5, unseen=40, max_state=300)


def _taken_sql(name: str, groups: str, seed: int, cap: int) -> str:
    """Common table expressions: the groups (gid, n) that a walk in the seed's order takes within cap."""
    return f"""{name}_o AS (SELECT gid, n, row_number() OVER (ORDER BY sha256('{seed}:order:' || gid), gid) AS r FROM {groups} WHERE n <= {cap}),
    {name}_f AS (SELECT CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS total, CAST(NULL AS VARCHAR) AS gid, false AS taken UNION ALL
      SELECT o.r, CASE WHEN f.total + o.n <= {cap} THEN f.total + o.n ELSE f.total END, o.gid, f.total + o.n <= {cap} FROM {name}_f f JOIN {name}_o o ON o.r = f.r + 1),
    {name} AS (SELECT gid FROM {name}_f WHERE taken)"""


def _bucket_sql(gid: str) -> str:
    b = f"CAST('0x' || substr(sha256('{fx.SEED}:split:' || {gid}), 1, 16) AS UBIGINT) % 10"
    return f"CASE WHEN {b} < 7 THEN 'train' WHEN {b} = 7 THEN 'dev' WHEN {b} = 8 THEN 'calibration' ELSE 'test' END"


def _words_sql(text: str) -> str:
    return f"len(list_filter(string_split({text}, ' '), lambda w: w <> ''))"


_R = RECIPE
BUILD_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, lang, text, sha256({fx.NORM}) AS th, len(string_split({fx.NORM}, ' ')) AS words, {_words_sql("text")} + 1 <= {_R.max_state} AS fits FROM documents),
    e AS (SELECT *, 'tweet_offensive/' || substr(th, 1, 20) AS gid, row_number() OVER (ORDER BY sha256('{_R.seed}:order:tweet_offensive/evaluation/' || doc_id), doc_id::VARCHAR) AS r FROM d WHERE doc_id % 5 = 0 AND doc_id % 7 <> 0),
    ef AS (SELECT * FROM e WHERE r <= {2 * (_R.showcase + _R.test)}), eg AS (SELECT gid, count(*) AS n FROM ef WHERE fits GROUP BY 1), {_taken_sql("sh", "eg", _R.seed, _R.showcase)},
    er AS (SELECT * FROM eg WHERE gid NOT IN (SELECT gid FROM sh)), {_taken_sql("te", "er", _R.seed + 2, _R.test)},
    e2 AS (SELECT th, CASE WHEN NOT fits THEN 'context' WHEN gid IN (SELECT gid FROM sh) THEN 'showcase' WHEN gid IN (SELECT gid FROM te) THEN 'test' ELSE 'not_needed' END AS fate FROM ef),
    p AS (SELECT *, 'tweet_offensive/' || substr(th, 1, 20) AS gid, row_number() OVER (ORDER BY sha256('{_R.seed + 1}:order:tweet_offensive/train/' || doc_id), doc_id::VARCHAR) AS r FROM d WHERE doc_id % 5 <> 0),
    p1 AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN 'unlabelled' WHEN th IN (SELECT th FROM d WHERE doc_id % 5 = 0) THEN 'official_overlap' WHEN NOT fits THEN 'context' ELSE {_bucket_sql("gid")} END AS fate FROM p WHERE r <= {_R.pool}),
    pg AS (SELECT gid, count(*) AS n FROM p1 WHERE fate = 'train' GROUP BY 1), {_taken_sql("tr", "pg", _R.seed + 3, _R.train)},
    p2 AS (SELECT th, CASE WHEN fate = 'train' AND gid NOT IN (SELECT gid FROM tr) THEN 'over_cap' ELSE fate END AS fate FROM p1),
    u AS (SELECT *, row_number() OVER (ORDER BY sha256('{_R.seed}:order:emotion/evaluation/' || doc_id), doc_id::VARCHAR) AS r FROM d WHERE doc_id % 5 = 1),
    u2 AS (SELECT fits, row_number() OVER (PARTITION BY fits ORDER BY r) AS k FROM u WHERE r <= {2 * _R.unseen}),
    c AS (SELECT 'composition/{_R.seed}/' || (['atom','negation','conjunction','disjunction','exception','conditional','nested_and','nested_or'])[1 + s_suppkey % 8] || '/' || s_suppkey AS gid FROM supplier),
    c1 AS (SELECT gid, 4 AS n, {_bucket_sql("gid")} AS fate FROM c), cg AS (SELECT gid, n FROM c1 WHERE fate = 'train'), {_taken_sql("ct", "cg", _R.seed + 4, _R.train)},
    o AS (SELECT *, 'note: ' || coalesce(lang, '') || chr(10) || 'body: ' || text AS state FROM d),
    o1 AS (SELECT *, 'own/' || substr(sha256({fx.NORM.replace("text", "state")}), 1, 20) AS gid, words >= 5 AND th IN (SELECT th FROM e2 WHERE fate IN ('showcase', 'test') UNION ALL SELECT th FROM p2 WHERE fate = 'test') AS excluded FROM o),
    every AS (SELECT 'tweet_offensive' AS source_family, fate, 1 AS n FROM e2 UNION ALL SELECT 'tweet_offensive', fate, 1 FROM p2
      UNION ALL SELECT 'emotion', CASE WHEN NOT fits THEN 'context' WHEN k <= {_R.unseen} THEN 'unseen' ELSE 'not_needed' END, 1 FROM u2
      UNION ALL SELECT 'composition', CASE WHEN fate = 'train' AND gid NOT IN (SELECT gid FROM ct) THEN 'over_cap' ELSE fate END, n FROM c1 UNION ALL SELECT 'support', 'showcase', 8
      UNION ALL SELECT 'own', CASE WHEN excluded THEN 'forbidden_text' WHEN lang IS NULL THEN 'invalid_label' WHEN {_words_sql("state")} + 1 > {_R.max_state} THEN 'context' ELSE {_bucket_sql("gid")} END, 1 FROM o1)
    SELECT source_family, fate, CAST(sum(n) AS BIGINT) AS n FROM every GROUP BY 1, 2"""


def _word_lengths(text: Column) -> Column:
    """Stands for a tokenizer: a token a word."""
    return F.transform(F.filter(F.split(text, " "), lambda w: w != ""), lambda w: F.length(w) + 100)


def built(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A corpus of documents as two public sources and a custom corpus, composed rules, and the showcase; and its report."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    label = F.when(F.col("doc_id") % 7 == 0, -1).otherwise(F.col("doc_id") % 2).cast("int")
    rows = docs.select("doc_id", "text", label.alias("label"))
    posts = build.Part(catalog.SPECS["tweet_offensive"], "doc_id", "text", rows.where("doc_id % 5 = 0"), rows.where("doc_id % 5 <> 0"))
    feelings = build.Part(catalog.SPECS["emotion"], "doc_id", "text", docs.where("doc_id % 5 = 1").select("doc_id", "text", (F.col("doc_id") % 6).cast("int").alias("label")))
    ids = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    rules = build.policy_records(cases.compositions(spark, ids, fx.SEED, tuple(pl.SHAPES)[:8], apart=True), "composition")
    own = build.custom_as_records(rq.labelled_requests(spark, _custom_files(spark, sf_dir)), "own", fx.SEED, several=True)
    return build.build([posts, feelings], RECIPE, _word_lengths, {k: i for i, k in enumerate(encoding.DELIMITERS, 1)}, {"pool": rules}, build.support_records(spark), own)


@query(BUILD_SQL)
def corpus_fates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every record that the corpus looked at, by source."""
    return built(spark, sf_dir)[1]


_PER_SOURCE = 30


@query(
    f"""WITH d AS (SELECT doc_id, sha256({fx.NORM}) AS th, {_words_sql("text")} + 1 <= {_R.max_state} AS fits FROM documents),
    r AS (SELECT *, row_number() OVER (ORDER BY sha256('{_R.seed}:order:emotion/evaluation/' || doc_id), doc_id::VARCHAR) AS r FROM d WHERE doc_id % 2 = 0),
    f AS (SELECT r, CASE WHEN doc_id % 7 = 0 THEN 'unlabelled' WHEN th IN (SELECT th FROM d WHERE doc_id % 3 = 0) THEN 'text_collision' WHEN NOT fits THEN 'context' ELSE 'extended' END AS fate FROM r),
    t AS (SELECT r, row_number() OVER (ORDER BY r) AS k FROM f WHERE fate = 'extended'), l AS (SELECT max(r) AS last FROM t WHERE k = {_PER_SOURCE})
    SELECT 'emotion' AS source_family, fate, count(*) AS n FROM f, l WHERE last IS NULL OR r <= last GROUP BY 2"""
)
def extended_panel_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an extended panel of 30 records looked at, up to its last one."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    label = F.when(F.col("doc_id") % 7 == 0, -1).otherwise(F.col("doc_id") % 6).cast("int")
    part = build.Part(catalog.SPECS["emotion"], "doc_id", "text", docs.where("doc_id % 2 = 0").select("doc_id", "text", label.alias("label")))
    trained = docs.where("doc_id % 3 = 0").select(F.col("text").alias("state"), F.lit("train").alias("split"))
    return build.extended_panel([part], trained, RECIPE, _word_lengths, {k: i for i, k in enumerate(encoding.DELIMITERS, 1)}, _PER_SOURCE)[1]
