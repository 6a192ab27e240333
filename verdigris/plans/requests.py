"""Queries over requests: converters, validation, rendering, targets, parsing, stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import numeric as nm
from verdigris.functions import python_udfs as py
from verdigris.functions import questions as qs
from verdigris.functions import text as tx
from verdigris.operators import converters, evaluation, scoring, targets
from verdigris.plans import fixtures as fx
from verdigris.plans.documents import rounded
from verdigris.plans.pipeline import fingerprint
from verdigris.session import table
from verdigris.sources import catalog

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _names(*values: str) -> Column:
    return F.array(*(F.lit(v) for v in values))


_SPLIT = f"CASE WHEN CAST(('0x' || substr(sha256('{fx.SEED}:split:' || gid), 1, 16)) AS UBIGINT) % 10 < 7 THEN 'train' WHEN CAST(('0x' || substr(sha256('{fx.SEED}:split:' || gid), 1, 16)) AS UBIGINT) % 10 = 7 THEN 'dev' WHEN CAST(('0x' || substr(sha256('{fx.SEED}:split:' || gid), 1, 16)) AS UBIGINT) % 10 = 8 THEN 'calibration' ELSE 'test' END"
_TH = r"sha256(trim(regexp_replace(replace(lower(x), 'ß', 'ss'), '\s+', ' ', 'g')))"


def _prepared_sql(source: str, row_id: str, text: str, kind: str, keys: str, gold: str, task: str, origin: str) -> str:
    return f"""WITH r AS (SELECT {row_id} AS i, {text} AS x, {gold} AS gold FROM {origin}), h AS (SELECT *, {_TH} AS th, '{source}/' || substr({_TH}, 1, 20) AS gid FROM r)
    SELECT '{source}/train/' || i AS record_id, gid AS group_id, '{source}' AS source_family, {_SPLIT} AS split, '{kind}' AS type, '{keys}' AS keys, gold, '{task}' AS task, th AS text_sha256, coalesce(list_contains(string_split('{keys}', ','), gold), false) AS valid FROM h"""


def _joined_keys(df: DataFrame) -> DataFrame:
    return df.withColumn("keys", F.array_join("keys", ","))


@query(_prepared_sql("documents", "doc_id", "text", "choice", "de,en,es,fr", "lang", "lang", "documents"))
def to_prepared_choice_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _joined_keys(converters.prepared(docs, "documents", F.col("doc_id"), F.col("text"), "choice", fx.LANGS, F.col("lang"), "lang", fx.SEED))


@query(_prepared_sql("documents", "doc_id", "text", "noul", "false,true", "CASE WHEN quality = 1 THEN 'true' ELSE 'false' END", "quality", "documents JOIN labels USING (doc_id)"))
def to_prepared_noul_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    gold = F.when(F.col("quality") == 1, "true").otherwise("false")
    return _joined_keys(converters.prepared(rows, "documents", F.col("doc_id"), F.col("text"), "noul", ("false", "true"), gold, "quality", fx.SEED))


@query(_prepared_sql("orders", "o_orderkey", "'order ' || o_orderkey || ' status ' || o_orderstatus", "score", "0,1,2,3,4", "CAST(CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS VARCHAR)", "priority", "orders"))
def to_prepared_score_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" status "), F.col("o_orderstatus"))
    gold = (F.substring("o_orderpriority", 1, 1).cast("int") - 1).cast("string")
    return _joined_keys(converters.prepared(table(spark, sf_dir, "orders"), "orders", F.col("o_orderkey"), text, "score", ("0", "1", "2", "3", "4"), gold, "priority", fx.SEED))


def _u_sql(prefix: str, key: str) -> str:
    return f"(CAST(('0x' || substr(sha256('{prefix}' || {key}), 1, 13)) AS UBIGINT)::DOUBLE / 4503599627370496.0)"


@query(f"SELECT doc_id, CASE WHEN {_u_sql('wrap:', 'doc_id')} < 0.15 THEN 'document' WHEN {_u_sql('wrap:', 'doc_id')} < 0.25 THEN 'ticket' WHEN {_u_sql('wrap:', 'doc_id')} < 0.32 THEN 'chat' ELSE 'text' END AS kind, length(text) AS text_length FROM documents")
def wrap_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each state is wrapped, and that unwrapping gives the text back (its length)."""
    u, c = tx.uniform(F.concat(F.lit("wrap:"), F.col("doc_id").cast("string"))), tx.uniform(F.concat(F.lit("channel:"), F.col("doc_id").cast("string")))
    rows = table(spark, sf_dir, "documents").select("doc_id", u.alias("u"), converters.wrapped_state(F.col("text"), u, c).alias("state"))
    kind = converters.wrap_kind(F.col("u"))
    back = F.when(F.col("kind") == "document", F.get_json_object("state", "$.document")).when(F.col("kind") == "ticket", F.get_json_object("state", "$.ticket.body")).when(F.col("kind") == "chat", F.get_json_object("state", "$[0].content")).otherwise(F.col("state"))
    return rows.withColumn("kind", kind).select("doc_id", "kind", F.length(back).cast("long").alias("text_length"))


@query(r"SELECT doc_id, sha256(array_to_string((string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '))[1:220], ' ')) AS clipped_sha256 FROM documents")
def word_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(tx.word_clip(F.col("text"), 220), 256).alias("clipped_sha256"))


@query("SELECT c_custkey, array_to_string(list_reverse(['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY']), ',') AS keys, c_mktsegment AS gold, true AS described FROM customer")
def variant_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changed form of a choice: options reversed, descriptions dropped, the gold key as it was."""
    options = _names("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    undescribed = F.transform(F.reverse(options), lambda o: tx.option_text(o, F.lit(None).cast("string")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.reverse(options), ",").alias("keys"), F.col("c_mktsegment").alias("gold"), (undescribed == F.reverse(options)).alias("described"))


@query(f"SELECT doc_id, CASE WHEN {_u_sql('desc:', 'doc_id')} < 0.3 THEN NULL WHEN {_u_sql('desc:', 'doc_id')} < 0.4 THEN '{{\"what\":\"' || source || '\"}}' ELSE source END AS description FROM documents")
def option_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = tx.uniform(F.concat(F.lit("desc:"), F.col("doc_id").cast("string")))
    return table(spark, sf_dir, "documents").select("doc_id", converters.described(F.col("source"), u).alias("description"))


@query("SELECT event_id, event_type AS gold, CASE WHEN event_type IN (SELECT DISTINCT event_type FROM events WHERE event_id % 2 = 0) THEN true ELSE false END AS valid FROM events")
def supervision_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold labels held against the option keys, here the event types that even events have."""
    events = table(spark, sf_dir, "events")
    keys = events.where("event_id % 2 = 0").agg(F.array_sort(F.collect_set("event_type")))
    return events.select("event_id", F.col("event_type").alias("gold"), F.coalesce(F.array_contains(keys.scalar(), F.col("event_type")), F.lit(False)).alias("valid"))


_MCQ = "list_transform(list_sort(list_transform(['A','B','C','D'], lambda o: {'h': sha256('7:' || event_id || '|' || o), 'o': o})), lambda x: x.o)"


@query(f"SELECT event_id, array_to_string({_MCQ}, ',') AS shown, 'opt_' || list_position({_MCQ}, chr(65 + CAST(event_id % 4 AS INTEGER))) AS gold FROM events")
def mcq_option_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiple choice with options in hash order; gold names the place of the right one."""
    shown = converters.shuffled(_names("A", "B", "C", "D"), F.col("event_id").cast("string"), 7)
    rows = table(spark, sf_dir, "events").select("event_id", shown.alias("s"))
    return rows.select("event_id", F.array_join("s", ",").alias("shown"), F.concat(F.lit("opt_"), F.array_position("s", F.char(F.lit(65) + F.col("event_id") % 4)).cast("string")).alias("gold"))


@query(r"SELECT conv_id, turn, regexp_replace(trim(text), '\?+$', '') || '?' AS question FROM conversations WHERE role = 'user'")
def question_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", tx.question_mark(F.col("text")).alias("question"))


_SIZES = (2, 5, 26, 27, 255, 256, 0, 1, 3, 10, 11, 4)


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for each order, of all types and of sizes at and beyond the limits; some with an empty id or other criteria."""
    key = F.col("o_orderkey")
    third = F.expr("o_orderkey div 3")
    kind = F.get(_names("choice", "noul", "score"), (key % 3).cast("int"))
    size = F.get(F.array(*(F.lit(k) for k in _SIZES)), (third % len(_SIZES)).cast("int"))
    numbered = lambda p: F.transform(qs.indices(size), lambda i: F.concat(F.lit(p), (i + 1).cast("string")))
    choice = F.when(F.expr("(o_orderkey div 36) % 7 = 0"), F.concat(numbered("o"), F.array(F.lit("")))).otherwise(numbered("o"))
    noul = F.when(third % 4 == 1, _names("true")).when(third % 4 == 2, _names("true", "maybe")).when(third % 4 == 3, F.array().cast("array<string>"))
    return table(spark, sf_dir, "orders").select(key.alias("qid"), kind.alias("type"), F.when(kind == "choice", choice).when(kind == "noul", noul).otherwise(numbered("level ")).alias("names"))


def _questions_sql() -> str:
    size = f"([{', '.join(map(str, _SIZES))}])[1 + (o_orderkey // 3) % {len(_SIZES)}]"
    many = f"list_transform(range(1, 1 + {size}), lambda i: '{{p}}' || i)"
    return f"""qs AS (SELECT o_orderkey AS qid, (['choice', 'noul', 'score'])[1 + o_orderkey % 3] AS type, CASE o_orderkey % 3
      WHEN 0 THEN CASE WHEN (o_orderkey // 36) % 7 = 0 THEN list_append({many.format(p="o")}, '') ELSE {many.format(p="o")} END
      WHEN 1 THEN CASE (o_orderkey // 3) % 4 WHEN 1 THEN ['true'] WHEN 2 THEN ['true', 'maybe'] WHEN 3 THEN [] END ELSE {many.format(p="level ")} END AS names FROM orders)"""


@query(
    f"""WITH {_questions_sql()} SELECT qid, CASE WHEN type = 'noul' THEN CASE WHEN len(list_filter(coalesce(names, []), lambda n: n NOT IN ('true', 'false'))) > 0 THEN 'noul_keys' END
    WHEN names IS NULL OR len(names) < 1 OR len(names) > 255 THEN 'option_count' WHEN type = 'choice' AND len(list_filter(names, lambda n: n = '')) > 0 THEN 'empty_option_id' END AS problem FROM qs"""
)
def validate_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).select("qid", qs.problem(F.col("type"), F.col("names")).alias("problem"))


_KEYS = "CASE type WHEN 'choice' THEN names WHEN 'noul' THEN ['false','true'] ELSE list_transform(range(len(names)), lambda i: CAST(i AS VARCHAR)) END"


@query(f"WITH {_questions_sql()} SELECT qid, array_to_string({_KEYS}, ',') AS keys, array_to_string(CASE type WHEN 'noul' THEN ['true','false'] ELSE {_KEYS} END, ',') AS teacher_keys FROM qs")
def question_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, n = F.col("type"), F.col("names")
    return _questions(spark, sf_dir).select("qid", F.array_join(qs.question_keys(t, n), ",").alias("keys"), F.array_join(qs.teacher_keys(t, n), ",").alias("teacher_keys"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_name || ': ' || p_type END AS option_text FROM part")
def option_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    description = F.when(F.col("p_partkey") % 3 == 0, F.when(F.col("p_partkey") % 2 == 0, F.lit(""))).otherwise(F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.option_text(F.col("p_name"), description).alias("option_text"))


@query("SELECT o_orderkey, 'order: ' || o_orderkey || chr(10) || 'status: ' || o_orderstatus || chr(10) || 'note: ' || chr(10) || 'lines:' || chr(10) || '  - ' || o_orderpriority AS rendered FROM orders")
def render_flat_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state of scalars, a null and a list, rendered as labelled lines."""
    note = F.lit(None).cast("string")
    state = F.to_json(F.struct(F.col("o_orderkey").alias("order"), F.col("o_orderstatus").alias("status"), note.alias("note"), F.array("o_orderpriority").alias("lines")), {"ignoreNullFields": "false"})
    return table(spark, sf_dir, "orders").select("o_orderkey", py.render_content(state).alias("rendered"))


@query("SELECT conv_id, string_agg('- role: ' || role || chr(10) || '  content: ' || text, chr(10) ORDER BY turn) AS rendered FROM conversations GROUP BY conv_id")
def render_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    state = F.to_json(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))))
    return turns.select("conv_id", py.render_content(state).alias("rendered"))


@query(r"SELECT event_id, regexp_replace('<|' || event_type || '|> ' || props || ' <|a|b|>', '<\|([^|<>]*)\|>', '<¦\1¦>', 'g') AS escaped FROM events")
def escape_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("<|"), F.col("event_type"), F.lit("|> "), F.col("props"), F.lit(" <|a|b|>"))
    return table(spark, sf_dir, "events").select("event_id", tx.escape_control(text).alias("escaped"))


_WORDS = r"len(string_split(trim(regexp_replace({c}, '\s+', ' ', 'g')), ' '))"


@query(f"WITH w AS (SELECT doc_id, {_WORDS.format(c='text')} AS n, doc_id % 4 * 1100 AS branch FROM documents) SELECT doc_id, CASE WHEN n + 1 > 2048 THEN 'state_over_limit' WHEN n + 1 + branch > 4096 OR n + 1 + 40 > 4096 THEN 'row_over_limit' ELSE 'ok' END AS status FROM w")
def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by size, counted in words: refused over a limit, never cut."""
    rows = table(spark, sf_dir, "documents").select("doc_id", tx.word_count(F.col("text")).alias("n"))
    return rows.select("doc_id", qs.admission(F.col("n"), F.array(F.col("doc_id") % 4 * 1100, F.lit(40).cast("long"))).alias("status"))


@query(
    f"""WITH w AS (SELECT conv_id, turn, {_WORDS.format(c='text')} AS n FROM conversations),
    s AS (SELECT conv_id, max(CASE WHEN turn = 0 THEN n END) + 1 AS n_state FROM w GROUP BY 1)
    SELECT conv_id, turn, CAST(n_state AS BIGINT) AS n_state, CAST(n_state + sum(n + 3) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS decide_idx, CAST(n_state + n + 2 AS BIGINT) AS last_pos FROM w JOIN s USING (conv_id) WHERE turn > 0"""
)
def pack_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each question's branch ends in a packed request: positions restart after the state, indices go on.

    A conversation's first turn is the state, each other turn a question of its words and three delimiters.
    """
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", tx.word_count(F.col("text")).alias("n")))).alias("t"))
    n_state = F.coalesce(F.filter("t", lambda x: x["turn"] == 0)[0]["n"] + 1, F.lit(1))
    rows = turns.select("conv_id", n_state.alias("n_state"), F.filter("t", lambda x: x["turn"] > 0).alias("q"))
    ends = F.transform("q", lambda x, i: F.struct(x["turn"].alias("turn"), x["n"].alias("n"), F.aggregate(F.slice("q", F.lit(1), i + 1), F.lit(0), lambda a, y: a + y["n"] + 3).alias("run")))
    out = rows.select("conv_id", "n_state", F.inline(ends))
    return out.select("conv_id", "turn", F.col("n_state").cast("long"), (F.col("n_state") + F.col("run") - 1).cast("long").alias("decide_idx"), (F.col("n_state") + F.col("n") + 2).cast("long").alias("last_pos"))


@query(f"""WITH v AS (SELECT vec_id, {fx.softmax_sql('embedding[1:3]::DOUBLE[]')} AS p FROM embeddings)
SELECT vec_id, p[1] / (p[1] + p[2]) <= 0.5 AS decision, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS level, round(list_max(p), 6) AS top_probability, round(p[2] + 2 * p[3], 6) AS expected_level FROM v""")
def to_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a noul (first two entries) and a score (three) from probabilities."""
    p = table(spark, sf_dir, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 3).alias("z")).select("vec_id", nm.softmax(F.col("z")).alias("p"))
    p_true = F.col("p")[1] / (F.col("p")[0] + F.col("p")[1])
    return p.select("vec_id", (p_true >= 0.5).alias("decision"), nm.argmax(F.col("p")).alias("level"), F.round(F.array_max("p"), 6).alias("top_probability"), F.round(nm.expected_level(F.col("p")), 6).alias("expected_level"))


@query(
    """WITH t AS (SELECT o_orderkey, o_orderkey % 3 AS s, ['AUTO','BUILD','FURN'] AS o FROM orders)
    SELECT o_orderkey, 'State:' || chr(10) || 'order ' || o_orderkey || chr(10) || chr(10) || 'Question: Which segment?' || chr(10) || 'Options:' || chr(10) ||
     'A. ' || o[1 + CAST(s AS INTEGER)] || chr(10) || 'B. ' || o[1 + CAST((s + 1) % 3 AS INTEGER)] || chr(10) || 'C. ' || o[1 + CAST((s + 2) % 3 AS INTEGER)] || chr(10) || 'Answer with the letter only.' AS prompt FROM t"""
)
def teacher_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The teacher's prompt for one rotation of a choice question."""
    options, labels = _names("AUTO", "BUILD", "FURN"), qs.answer_labels(F.lit("choice"), F.lit(3))
    perm = F.get(qs.layouts(F.lit("choice"), F.lit(3)), (F.col("o_orderkey") % 3).cast("int"))
    lines = F.transform(perm, lambda i, j: F.concat(F.get(labels, j), F.lit(". "), F.get(options, i)))
    head = F.array(F.lit("State:"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), F.lit(""), F.lit("Question: Which segment?"), F.lit("Options:"))
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.escape_control(F.array_join(F.concat(head, lines, F.array(F.lit("Answer with the letter only."))), "\n")).alias("prompt"))


_K = "CASE type WHEN 'noul' THEN 2 ELSE len(names) END"


@query(
    f"""WITH {_questions_sql()}, k AS (SELECT qid, type, {_K} AS k FROM qs), e AS (SELECT * FROM k WHERE NOT (type = 'choice' AND k > 26) AND NOT (type = 'score' AND k > 10) AND k > 0),
    l AS (SELECT qid, type, k, unnest(range(CASE type WHEN 'choice' THEN k WHEN 'noul' THEN 2 ELSE 1 END)) AS s FROM e)
    SELECT qid, CAST(s AS INTEGER) AS layout, array_to_string(list_transform(range(k), lambda j: (j + s) % k), ',') AS perm FROM l"""
)
def layouts_cyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _questions(spark, sf_dir).where((F.col("type") == "noul") | (F.size("names") > 0)).withColumn("record_id", F.lit("orders/0"))
    return targets.exploded_layouts(rows).select("qid", "layout", F.array_join(F.transform("perm", lambda i: i.cast("string")), ",").alias("perm"))


@query(
    f"""WITH {_questions_sql()}, k AS (SELECT qid, type, {_K} AS k FROM qs)
    SELECT qid, CASE WHEN type = 'choice' AND k > 26 THEN 'choice has ' || k || ' options; the letter-label teacher supports at most 26' WHEN type = 'score' AND k > 10 THEN 'score has ' || k || ' levels; the digit-label teacher supports at most 10' END AS reason FROM k"""
)
def eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.when(F.col("type") == "noul", 2).otherwise(F.size("names"))
    return _questions(spark, sf_dir).select("qid", qs.ineligible_reason(F.col("type"), k).alias("reason"))


_LP = "list_transform(embedding[1:4]::DOUBLE[], lambda v: v * 3 - 2)"


def _logprobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four numbers a vector that stand for log-probabilities."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform(F.slice(F.col("embedding").cast("array<double>"), 1, 4), lambda v: v * 3 - 2).alias("lp"))


@query(f"WITH v AS (SELECT vec_id, {_LP} AS lp FROM embeddings), p AS (SELECT vec_id, lp, {fx.softmax_sql('lp')} AS p FROM v) SELECT vec_id, round(p[1], 6) AS p_first, round(list_max(p), 6) AS p_max, round(list_sum(list_transform(lp, lambda x: exp(x))), 6) AS mass FROM p")
def restricted_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _logprobs(spark, sf_dir).select("vec_id", nm.restricted(F.col("lp")).alias("r"))
    return rows.select("vec_id", F.round(F.col("r.probs")[0], 6).alias("p_first"), F.round(F.array_max("r.probs"), 6).alias("p_max"), F.round("r.mass", 6).alias("mass"))


_CYC = f"""v AS (SELECT vec_id, label, {_LP} AS lp FROM embeddings),
sh AS (SELECT vec_id, label, s, list_transform(range(4), lambda j: lp[1 + CAST((j + s) % 4 AS INTEGER)] + j * 0.5) AS shown FROM v, range(4) r(s)),
sp AS (SELECT vec_id, label, s, {fx.softmax_sql('shown')} AS pos FROM sh),
bk AS (SELECT vec_id, label, s, list_transform(range(4), lambda k: pos[1 + CAST((k - s + 4) % 4 AS INTEGER)]) AS p FROM sp),
mn AS (SELECT vec_id, label, [avg(ln(greatest(p[1], 1e-9))), avg(ln(greatest(p[2], 1e-9))), avg(ln(greatest(p[3], 1e-9))), avg(ln(greatest(p[4], 1e-9)))] AS m FROM bk GROUP BY vec_id, label),
cyc AS (SELECT vec_id, label, {fx.softmax_sql('m')} AS c FROM mn)"""


def _combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of the four rotations scored with a bias by place, mapped back to keys and combined: the bias goes."""
    rows = _logprobs(spark, sf_dir).withColumn("perms", qs.layouts(F.lit("choice"), F.lit(4)))
    shown = F.transform("perms", lambda perm: F.transform(perm, lambda i, j: F.get(F.col("lp"), i) + j * 0.5))
    probs = rows.select("vec_id", "label", "perms", shown.alias("z")).select("vec_id", "label", "perms", F.transform("z", lambda z: nm.softmax(z)).alias("at"))
    keyed = F.transform("at", lambda p, s: F.transform(qs.indices(F.lit(4)), lambda k: F.get(p, F.pmod(k - s, F.lit(4)))))
    return probs.select("vec_id", "label", keyed.alias("p")).select("vec_id", "label", nm.cyclic_combine(F.col("p")).alias("c"))


@query(f"WITH {_CYC}, r AS (SELECT vec_id, {fx.softmax_sql('lp')} AS p FROM v) SELECT vec_id, round(c[1], 6) AS p_first, round(list_max(c), 6) AS p_max, list_max(list_transform(c, lambda x, i: abs(x - p[i]))) < 1e-9 AS unbiased FROM cyc JOIN r USING (vec_id)")
def cyclic_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = _logprobs(spark, sf_dir).select("vec_id", nm.softmax(F.col("lp")).alias("p"))
    rows = _combined(spark, sf_dir).join(plain, "vec_id")
    return rows.select("vec_id", F.round(F.col("c")[0], 6).alias("p_first"), F.round(F.array_max("c"), 6).alias("p_max"), (F.array_max(F.zip_with("c", "p", lambda x, y: F.abs(x - y))) < 1e-9).alias("unbiased"))


@query(f"WITH {_CYC}, b AS (SELECT vec_id, c, list_transform(c, lambda x, i: 0.5 * CASE WHEN i = label % 4 + 1 THEN 1.0 ELSE 0.0 END + 0.5 * x) AS t FROM cyc) SELECT vec_id, round(t[1], 6) AS t_first, round(list_max(t), 6) AS t_max, round(-list_sum(list_transform(t, lambda x, i: x * (ln(c[i])))), 6) AS loss FROM b")
def target_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half gold, half teacher, and the soft cross-entropy of the teacher's own logits against it."""
    keys = _names("k0", "k1", "k2", "k3")
    rows = _combined(spark, sf_dir).withColumn("keys", keys).withColumn("t", nm.blend(F.col("keys"), F.get(keys, (F.col("label") % 4).cast("int")), F.map_from_arrays("keys", "c")))
    loss = nm.soft_ce(F.transform("c", lambda x: F.log(x)), F.col("t"))
    return rows.select("vec_id", F.round(F.col("t")[0], 6).alias("t_first"), F.round(F.array_max("t"), 6).alias("t_max"), F.round(loss, 6).alias("loss"))


_PERM = "list_transform(list_sort(list_transform(['de','en','es','fr'], lambda o: {'h': sha256('42:' || doc_id || '|v1|' || o), 'o': o})), lambda x: x.o)"


@query(f"SELECT doc_id, array_to_string({_PERM.replace('|v1|', '/v1|')}, ',') AS shown FROM documents")
def option_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.col("doc_id").cast("string"), F.lit("/v1"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(converters.shuffled(_names(*fx.LANGS), key, fx.SEED), ",").alias("shown"))


_TARGETS = "tg AS (SELECT event_type || '/' || user_id AS record_id, 'q' || event_id % 3 AS qid, event_id AS ord, value, event_id % 5 <> 0 AS eligible, CASE WHEN event_id % 5 <> 0 THEN 1 + event_id % 4 END AS layouts, CASE WHEN event_id % 5 <> 0 THEN 10 + event_id % 90 END AS prompt_tokens FROM events)"


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as collected targets, with repeated keys."""
    eligible = F.col("event_id") % 5 != 0
    return table(spark, sf_dir, "events").select(
        F.concat("event_type", F.lit("/"), F.col("user_id").cast("string")).alias("record_id"),
        F.concat(F.lit("q"), (F.col("event_id") % 3).cast("string")).alias("qid"),
        F.col("event_id").alias("ord"),
        "value",
        eligible.alias("eligible"),
        F.when(eligible, 1 + F.col("event_id") % 4).alias("layouts"),
        F.when(eligible, 10 + F.col("event_id") % 90).alias("prompt_tokens"),
    )


@query(f"WITH {_TARGETS}, done AS (SELECT DISTINCT record_id, qid FROM tg WHERE ord % 4 = 0) SELECT DISTINCT t.record_id, t.qid FROM tg t LEFT JOIN done d USING (record_id, qid) WHERE d.qid IS NULL")
def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _targets(spark, sf_dir)
    return targets.remaining(rows.select("record_id", "qid").distinct(), rows.where("ord % 4 = 0"))


@query(f"WITH {_TARGETS} SELECT record_id, qid, max(ord) AS ord, round(arg_max(value, ord), 6) AS value FROM tg GROUP BY 1, 2")
def last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(targets.latest(_targets(spark, sf_dir), "ord").select("record_id", "qid", "ord", "value"), "value")


@query(f"WITH {_TARGETS} SELECT split_part(record_id, '/', 1) AS source, count(*) FILTER (WHERE eligible) AS eligible, count(*) FILTER (WHERE NOT eligible) AS ineligible, CAST(sum(coalesce(layouts, 0)) AS BIGINT) AS layouts, CAST(sum(coalesce(prompt_tokens, 0)) AS BIGINT) AS prompt_tokens FROM tg GROUP BY 1")
def target_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.summary(_targets(spark, sf_dir))


@query(
    """WITH g AS (SELECT event_type AS system, user_id, event_id, CAST(value AS BIGINT) AS tokens, event_id % 9 = 0 AS truncated, event_id % 8 <> 0 AS parse_ok, CASE WHEN event_id % 6 <> 0 THEN 'x' END AS pred FROM events),
    f AS (SELECT *, row_number() OVER (PARTITION BY system, user_id ORDER BY event_id) AS r FROM g)
    SELECT system, count(*) AS requests, round(avg(tokens), 6) AS tokens_mean, round(median(tokens), 6) AS tokens_median, max(tokens) AS tokens_max, count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE NOT parse_ok) AS no_json,
      (SELECT count(*) FROM g x WHERE x.system = f.system AND pred IS NULL) AS questions_unanswered FROM f WHERE r = 1 GROUP BY system"""
)
def generation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    tokens = F.bround("value", 0).cast("long")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("system"), F.lit("p").alias("panel"), F.col("user_id").alias("record_id"), "event_id", tokens.alias("generated_tokens"), (e % 9 == 0).alias("truncated"), (e % 8 != 0).alias("parse_ok"), F.when(e % 6 != 0, "x").alias("pred"))
    return rounded(evaluation.generation_stats(rows, "event_id"), "tokens_mean", "tokens_median")


@query("SELECT event_type, round(quantile_disc(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean, count(value) AS n FROM events GROUP BY 1")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.percentiles(table(spark, sf_dir, "events"), "value", "event_type"), "p50", "p95", "mean")


@query(
    """WITH s AS (SELECT o_orderstatus AS system, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS gold, CAST(o_orderkey % 5 AS INTEGER) AS pred, (o_orderkey % 9) / 2.0 AS e FROM orders)
    SELECT system, count(*) AS score_n, round(avg(abs(e - gold)), 6) AS score_mae_expected, round(avg(abs(pred - gold)::DOUBLE), 6) AS score_mae_modal FROM s GROUP BY 1"""
)
def score_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = F.expr("try_cast(substr(o_orderpriority, 1, 1) as int)") - 1
    none = F.lit(None).cast("array<double>")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("system"), F.lit("score").alias("type"), _names("0", "1", "2", "3", "4").alias("keys"), none.alias("probs"), (F.col("o_orderkey") % 5).cast("string").alias("pred"), gold.cast("string").alias("gold"), F.lit(True).alias("eligible"), ((F.col("o_orderkey") % 9) / F.lit(2.0)).alias("expected_level"))
    return rounded(evaluation.metrics(rows, "system").select("system", "score_n", "score_mae_expected", "score_mae_modal"), "score_mae_expected", "score_mae_modal")


@query("SELECT event_id, CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) BETWEEN 0 AND 9 THEN json_extract_string(props, '$.k') END AS answer FROM events")
def parse_answers_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level answers out of JSON: a number that is one of the ten levels, else null."""
    found = F.get_json_object(py.first_json_object(F.concat(F.lit("Answer: "), F.col("props"), F.lit(" done"))), "$.k")
    level = F.when(F.trim(found).rlike(r"^\d+$"), F.trim(found))
    keys = F.transform(qs.indices(F.lit(10)), lambda i: i.cast("string"))
    return table(spark, sf_dir, "events").select("event_id", F.when(F.array_contains(keys, level), level).alias("answer"))


@query("""SELECT event_id, '{"k": ' || json_extract_string(props, '$.k') || '}' AS object FROM events""")
def first_json_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first object in a text with a broken one before it and another behind it, as it is found."""
    text = F.concat(F.lit("x {not json} "), F.col("props"), F.lit(' then {"k": -1}'))
    return table(spark, sf_dir, "events").select("event_id", py.first_json_object(text).alias("object"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE ' ' || event_type END AS answer, CASE WHEN event_id % 3 = 0 THEN 'a ' || event_type ELSE ' ' || event_type END AS last FROM events")
def think_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("a "), F.when(F.col("event_id") % 3 != 0, F.lit("</think> ")).otherwise(""), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", tx.after_thinking(text, True).alias("answer"), tx.after_thinking(text, False).alias("last"))


@query("SELECT 'documents' AS stage, sha256('{\"input\": \"documents\", \"seed\": 42}') AS fingerprint, count(*) AS records FROM documents")
def stage_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage's row in the stage table: what it was asked for and what it has."""
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("records")).select(F.lit("documents").alias("stage"), F.lit(fingerprint({"seed": 42, "input": "documents"})).alias("fingerprint"), "records")


@query(
    """WITH c AS (SELECT o_orderkey, ([1, 32, 33])[1 + o_orderkey % 3] AS questions, ([2, 255, 256])[1 + (o_orderkey // 3) % 3] AS options, ([100, 2047, 2048])[1 + (o_orderkey // 9) % 3] AS state, (o_orderkey // 27) % 3 - 1 AS over FROM orders)
    SELECT o_orderkey, CASE WHEN questions > 32 THEN 'question_count' WHEN options > 255 THEN 'option_count' WHEN state + 1 > 2048 THEN 'state_over_limit' WHEN over > 0 THEN 'row_over_limit' ELSE 'ok' END AS outcome FROM c"""
)
def acceptance_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each order, at the limits or one over any of them: answered, or refused for the first that it passes."""
    own = lambda values, by: F.get(F.array(*(F.lit(v) for v in values)), F.expr(f"(o_orderkey div {by}) % 3").cast("int"))
    cases = table(spark, sf_dir, "orders").select("o_orderkey", own((1, 32, 33), 1).alias("questions"), own((2, 255, 256), 3).alias("options"), own((100, 2047, 2048), 9).alias("state"), own((-1, 0, 1), 27).alias("over"))
    names = F.transform(F.sequence(F.lit(1), F.col("options")), lambda i: i.cast("string"))
    refused = F.when(F.col("questions") > qs.MAX_QUESTIONS, "question_count")
    row = F.lit(qs.MAX_ROW) - F.col("state") - 1 + F.col("over")
    return cases.select("o_orderkey", F.coalesce(refused, qs.problem(F.lit("choice"), names), qs.admission(F.col("state"), F.array(row))).alias("outcome"))


@query(f"WITH {fx.SCORED_SQL} SELECT doc_id, (['de','en','es','fr'])[list_position(logits, list_max(logits))] AS choice, round(list_max(logits), 6) AS logit FROM scored")
def scorer_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The marker scorer behind the scorer interface, in Arrow batches: the same as its column form."""
    records = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("state"), _names(*fx.LANGS).alias("keys"))
    out = scoring.score(records, scoring.MarkerScorer(fx.MARKERS, fx.SCALE, fx.ENGLISH))
    return out.select("doc_id", F.get("keys", nm.argmax(F.col("logits"))).alias("choice"), F.round(F.array_max("logits"), 6).alias("logit"))


@query(
    """SELECT event_id, (['abbreviation','entity','description','human','location','number'])[1 + event_id % 6] AS gold, 'choice' AS type, 'abbreviation|entity|description|human|location|number' AS keys,
    'Asks what an abbreviation stands for|Asks about a thing, object, animal, product, or creative work|Asks for a definition, description, reason, or manner|Asks about a person, group, or organisation|Asks about a place|Asks for a number, date, count, or other numeric value' AS descriptions,
    'number|location|human|entity|description|abbreviation' AS variant_keys, 'A quantity, date or measurement|A place|A person or organisation|A thing, product, animal or work|An explanation or definition|The expansion of an abbreviation' AS variant_descriptions, true AS valid, true AS variant_valid FROM events"""
)
def source_converter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogued converter over event rows, in its normal and its changed schema: keys, descriptions and gold."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("props").alias("text"), (F.col("event_id") % 6).alias("coarse_label"))
    spec = catalog.SPECS["trec"]
    one, other = (catalog.convert(rows, spec, F.col("event_id"), variant=v) for v in (False, True))
    joined = lambda c: F.array_join(c, "|")
    other = other.select("row_key", F.col("valid").alias("variant_valid"), F.col("gold").alias("other"), joined("keys").alias("variant_keys"), joined("descriptions").alias("variant_descriptions"))
    both = one.join(other, "row_key").where(F.col("gold") == F.col("other"))
    return both.select(F.col("row_key").cast("long").alias("event_id"), "gold", "type", joined("keys").alias("keys"), joined("descriptions").alias("descriptions"), "variant_keys", "variant_descriptions", "valid", "variant_valid")


@query(
    """SELECT event_id, state, CASE WHEN label = 0 THEN 'sadness' WHEN label = 1 THEN 'joy' WHEN label = 2 THEN 'love' WHEN label = 3 THEN 'anger' WHEN label = 4 THEN 'fear' ELSE 'surprise' END AS emotion, CASE WHEN label = 1 THEN 'true' ELSE 'false' END AS offensive, 'Contains insults, threats, profanity directed at someone, or hateful content' AS meant
    FROM (SELECT event_id, event_type AS state, event_id % 6 AS label FROM events)"""
)
def bare_converters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two converters without draws over event rows: an emotion and an offence question."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("text"), (F.col("event_id") % 6).cast("int").alias("label"))
    one, two = (catalog.convert(rows, catalog.SPECS[n], F.col("event_id")) for n in ("emotion", "tweet_offensive"))
    two = two.select("row_key", F.col("gold").alias("offensive"), F.get("descriptions", F.lit(1)).alias("meant"))
    return one.join(two, "row_key").select(F.col("row_key").cast("long").alias("event_id"), "state", F.col("gold").alias("emotion"), "offensive", "meant")
