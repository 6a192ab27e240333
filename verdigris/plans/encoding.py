"""Queries over packed layouts, answers of all types, the teacher's side and panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import numeric as nm
from verdigris.functions import python_udfs as py
from verdigris.functions import questions as qs
from verdigris.operators import encoding, serving, teacher
from verdigris.plans import fixtures as fx
from verdigris.session import table
from verdigris.sources import requests as rq

Q, SQL = {}, {}
IDS = {"state": 1, "question": 2, "option": 3, "end_option": 4, "decide": 5}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _word_lengths(text: Column) -> Column:
    """Stands for a tokenizer: a token a word, its id 100 and the word's length."""
    return F.transform(F.filter(F.split(text, " "), lambda w: w != ""), lambda w: F.length(w) + 100)


def _strings(*values: str | None) -> Column:
    return F.array(*(F.lit(v).cast("string") for v in values))


def order_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's priority as the state of two questions, packed."""
    one = F.struct(F.lit("Who is it").alias("instructions"), _strings("ops", "dev team").alias("options"))
    two = F.struct(F.lit("Fine").alias("instructions"), _strings("no", "yes").alias("options"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_orderpriority").alias("state"), F.array(one, two).alias("questions"))
    return encoding.encoded(rows, _word_lengths, IDS)


_S = "list_transform(list_filter(string_split(o_orderpriority, ' '), lambda w: w <> ''), lambda w: length(w) + 100)"
_BRANCHES = "[2,103,102,102,3,103,4,3,103,104,4,5], [2,104,3,102,4,3,103,4,5]"
LAYOUT_SQL = f"s AS (SELECT o_orderkey, [1] || {_S} AS s, {_BRANCHES.replace('], [', '] AS b1, [')} AS b2 FROM orders)"


@query(
    f"""WITH {LAYOUT_SQL} SELECT o_orderkey AS record_id, array_to_string(s || b1 || b2, ',') AS ids, array_to_string(list_transform(s, lambda x: 0) || list_transform(b1, lambda x: 1) || list_transform(b2, lambda x: 2), ',') AS seg,
    array_to_string(range(len(s)) || range(len(s), len(s) + 12) || range(len(s), len(s) + 9), ',') AS pos, array_to_string(list_transform(s, lambda x: -1) || [-1,-1,-1,-1,0,0,0,1,1,1,1,-2,-1,-1,0,0,0,1,1,1,-2], ',') AS opt,
    array_to_string([len(s) + 11, len(s) + 20], ',') AS decide_idx, array_to_string([len(s) + 6, len(s) + 10, len(s) + 16, len(s) + 19], ',') AS opt_idx FROM s"""
)
def packed_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, segments, positions, option marks and readouts of packed requests."""
    rows = order_layouts(spark, sf_dir)
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return rows.select("record_id", *(joined(F.col(c)).alias(c) for c in ("ids", "seg", "pos", "opt", "decide_idx")), joined(F.flatten("opt_idx")).alias("opt_idx"))


@query(
    f"""WITH {LAYOUT_SQL}, q AS (SELECT o_orderkey, s, 1 AS question, b1 AS b, [6, 10] AS o FROM s UNION ALL SELECT o_orderkey, s, 2, b2, [4, 7] FROM s)
    SELECT o_orderkey AS record_id, CAST(question AS INTEGER) AS question, array_to_string(s, ',') AS state_ids, array_to_string(b, ',') AS ids, CAST(len(s) AS INTEGER) AS first_pos, CAST(len(b) - 1 AS INTEGER) AS decide, array_to_string(o, ',') AS opts FROM q"""
)
def question_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed requests taken apart into a row for each question."""
    rows = encoding.rows_of(order_layouts(spark, sf_dir))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return rows.select("record_id", "question", joined("state_ids").alias("state_ids"), joined("ids").alias("ids"), F.get("pos", F.lit(0)).alias("first_pos"), "decide", joined("opts").alias("opts"))


@query(
    f"""WITH v AS (SELECT vec_id, vec_id % 3 AS t, {fx.softmax_sql("embedding[1:CASE vec_id % 3 WHEN 0 THEN 2 ELSE 3 END]::DOUBLE[]")} AS p FROM embeddings)
    SELECT vec_id, ['noul','choice','score'][1 + t] AS type, CASE WHEN t = 0 THEN p[2] >= 0.5 END AS decision, round(CASE WHEN t = 0 THEN p[2] END, 6) AS p_true, CASE WHEN t = 1 THEN ['a','b','c'][list_position(p, list_max(p))] END AS choice,
      CAST(CASE WHEN t = 2 THEN list_position(p, list_max(p)) - 1 END AS INTEGER) AS level, round(CASE WHEN t = 2 THEN p[2] + 2 * p[3] END, 6) AS expected_level, round(CASE WHEN t <> 0 THEN list_max(p) END, 6) AS top_probability, round(p[1], 6) AS first FROM v"""
)
def answers_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of all types, with their distribution."""
    t = F.col("vec_id") % 3
    kind = F.get(_strings("noul", "choice", "score"), t.cast("int"))
    keys = F.when(t == 0, _strings("false", "true")).when(t == 1, _strings("a", "b", "c")).otherwise(_strings("0", "1", "2"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", kind.alias("type"), keys.alias("keys"), F.slice(F.col("embedding").cast("array<double>"), F.lit(1), F.size(keys)).alias("z"))
    rows = rows.select("vec_id", "type", "keys", nm.softmax(F.col("z")).alias("p")).select("vec_id", "keys", encoding.answers(F.col("type"), F.col("keys"), F.col("p")).alias("a"))
    number = lambda c: F.round(F.col(f"a.{c}"), 6).alias(c)
    return rows.select("vec_id", "a.type", "a.decision", number("p_true"), "a.choice", "a.level", number("expected_level"), number("top_probability"), F.round(F.element_at("a.probabilities", F.get("keys", F.lit(0))), 6).alias("first"))


@query(
    """WITH o AS (SELECT o_orderkey, o_orderkey % 3 AS t, 'State:' || chr(10) || o_orderstatus || chr(10) || chr(10) || 'Question: Which?' || chr(10) AS head FROM orders)
    SELECT o_orderkey, head || CASE t WHEN 0 THEN 'Options:' || chr(10) || 'A. b' || chr(10) || 'B. a: first' || chr(10) || 'Answer with the letter only.'
      WHEN 1 THEN 'Yes means: so' || chr(10) || 'Answer No or Yes.' ELSE 'Pick the level that applies (the levels are ordered):' || chr(10) || '0. high' || chr(10) || '1. low' || chr(10) || 'Answer with the number only.' END AS prompt FROM o"""
)
def teacher_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The teacher's prompts of all types, options in reverse."""
    t = F.col("o_orderkey") % 3
    kind = F.get(_strings("choice", "noul", "score"), t.cast("int"))
    keys = F.when(t == 0, _strings("a", "b")).when(t == 1, _strings("false", "true")).otherwise(_strings("0", "1"))
    said = F.when(t == 0, _strings("first", None)).when(t == 1, _strings(None, "so")).otherwise(_strings("low", "high"))
    options = encoding.option_texts(kind, keys, said)
    turned = F.reverse(qs.indices(F.size(options)))
    return table(spark, sf_dir, "orders").select("o_orderkey", teacher.user_text(F.col("o_orderstatus"), kind, F.lit("Which?"), options, said, turned).alias("prompt"))


@query(
    """WITH e AS (SELECT event_id, event_id % 4 AS t, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
    SELECT event_id, t <> 3 AS parse_ok, CASE t WHEN 0 THEN CASE WHEN k BETWEEN 0 AND 4 THEN 'o' || k END END AS choice, CASE WHEN t IN (0, 1) THEN CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END END AS noul, CASE WHEN t IN (0, 2) AND k BETWEEN 0 AND 9 THEN CAST(k AS VARCHAR) END AS score FROM e"""
)
def parsed_answers_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of all types out of free text: whole, in part, and none."""
    k, t = F.get_json_object("props", "$.k"), F.col("event_id") % 4
    even = F.when(k.cast("long") % 2 == 0, "true").otherwise("false")
    a, b, c = F.concat(F.lit('"c": "o'), k, F.lit('"')), F.concat(F.lit('"n": '), even), F.concat(F.lit('"s": '), k)
    text = F.concat(F.lit("so {"), F.when(t == 0, F.concat_ws(", ", a, b, c)).when(t == 1, b).when(t == 2, c).otherwise("broken"), F.lit("} end {"))
    keys = F.array(F.array(*(F.lit(f"o{i}") for i in range(5))), F.concat(_strings("false", "true"), F.array().cast("array<string>")), F.array(*(F.lit(str(i)) for i in range(10))))
    rows = table(spark, sf_dir, "events").select("event_id", py.parsed_answers(text, _strings("c", "n", "s"), _strings("choice", "noul", "score"), keys).alias("p"))
    return rows.select("event_id", "p.parse_ok", *(F.get("p.answers", F.lit(i)).alias(n) for i, n in enumerate(("choice", "noul", "score"))))


_TARGETS = "t AS (SELECT o_custkey AS rid, o_orderkey AS ord, (o_orderkey % 10) / 10.0 AS p, o_orderkey % 5 <> 0 AS eligible FROM orders WHERE o_orderkey % 7 <> 0), u AS (SELECT rid, arg_max(p, ord) AS p FROM t WHERE eligible GROUP BY 1)"


def _targets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as questions; their orders as targets, of which some are not eligible or have no distribution."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record_id"), F.lit("q").alias("qid"), _strings("a", "b").alias("keys"), F.when(F.col("c_custkey") % 2 == 0, "a").otherwise("b").alias("gold"))
    p = (F.col("o_orderkey") % 10) / 10.0
    cyclic = F.when(F.col("o_orderkey") % 7 != 0, F.create_map(F.lit("b"), p, F.lit("a"), 1 - p))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("record_id"), F.lit("q").alias("qid"), F.col("o_orderkey").alias("at"), (F.col("o_orderkey") % 5 != 0).alias("eligible"), cyclic.alias("cyclic"))
    return customers, teacher.usable(orders, "at")


@query(f"WITH {_TARGETS} SELECT c_custkey AS record_id, u.p IS NOT NULL AS taught, round(CASE WHEN u.p IS NULL THEN (c_custkey % 2 = 0)::INT::DOUBLE ELSE 0.5 * (c_custkey % 2 = 0)::INT + 0.5 * (1 - u.p) END, 6) AS target_a, round(CASE WHEN u.p IS NULL THEN (c_custkey % 2)::DOUBLE ELSE 0.5 * (c_custkey % 2) + 0.5 * u.p END, 6) AS target_b FROM customer LEFT JOIN u ON rid = c_custkey")
def training_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable targets joined to questions by key and blended with gold."""
    rows = teacher.with_teacher(*_targets(spark, sf_dir))
    return rows.select("record_id", "taught", *(F.round(F.get("target", F.lit(i)), 6).alias(f"target_{n}") for i, n in enumerate("ab")))


@query(f"WITH {_TARGETS} SELECT count(u.rid) AS taught, count(*) AS questions FROM customer LEFT JOIN u ON rid = c_custkey")
def teacher_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return teacher.coverage(*_targets(spark, sf_dir))


@query(
    """WITH r AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY sha256('42:order:' || doc_id), CAST(doc_id AS VARCHAR)) AS rank FROM documents),
    k AS (SELECT source, doc_id, rank, row_number() OVER (PARTITION BY source ORDER BY rank) AS taken FROM r WHERE rank <= 20 AND n_chars <= 2000) SELECT source AS source_family, CAST(doc_id AS VARCHAR) AS record_id, CAST(rank AS INTEGER) AS rank, CAST(taken AS INTEGER) AS taken FROM k WHERE taken <= 10"""
)
def admitted_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten admitted documents of each source's first twenty in the evaluation's order: a panel's own size."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("source_family"), F.col("doc_id").cast("string").alias("record_id"), "n_chars", F.lit(0).alias("label"))
    return rq.admitted(rq.evaluation_order(docs, 42), F.col("n_chars") <= 2000, 10).select("source_family", "record_id", "rank", "taken")


@query("SELECT source AS split, count(*) FILTER (WHERE n_chars <= 2000) AS kept, count(*) FILTER (WHERE n_chars > 2000) AS dropped, max(n_chars) FILTER (WHERE n_chars <= 2000) AS longest FROM documents GROUP BY 1")
def admission_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("split"), F.when(F.col("n_chars") <= 2000, "ok").otherwise("row_over_limit").alias("status"), F.col("n_chars").alias("packed_tokens"))
    return rq.admission_report(docs)


@query("""SELECT event_id, sha256('{"event_id": ' || event_id || ', "event_type": "' || event_type || '"}') AS row_sha256 FROM events""")
def row_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row's hash over its JSON with sorted keys, whatever the order of its columns."""
    return table(spark, sf_dir, "events").select("event_id", py.row_hash(F.to_json(F.struct("event_type", "event_id"))).alias("row_sha256"))


@query(
    """WITH o AS (SELECT o_orderkey, o_orderpriority AS state, o_custkey FROM orders)
    SELECT o_orderkey, 'Read the state and answer every question.' || chr(10) || chr(10) || 'State:' || chr(10) || state || chr(10) || chr(10) || 'Questions:' || chr(10)
      || 'Question "team" (choice)' || chr(10) || '  instructions: Who takes it?' || chr(10) || '  answer: exactly one option id from this list, as a JSON string' || chr(10) || '    "ops"' || chr(10) || '    "dev": Number ' || o_custkey || chr(10)
      || 'Question "ok" (noul)' || chr(10) || '  answer: true or false, as a JSON boolean' || CASE WHEN o_custkey % 2 = 0 THEN chr(10) || '    true: Customer ' || o_custkey ELSE '' END || chr(10)
      || 'Question "level" (score)' || chr(10) || '  instructions: How much?' || chr(10) || '    Be exact.' || chr(10) || '  answer: one level index from 0 to 2, as a JSON integer' || chr(10) || '    0: none' || chr(10) || '    1: ' || o_custkey || chr(10) || '    2: all of it' || chr(10) || chr(10)
      || 'Respond with only a JSON object whose keys are the question ids ("team", "ok", "level") and whose values are the answers. No other text.' AS prompt FROM o"""
)
def structured_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts for structured answers: three questions an order, of all types."""
    own = F.col("o_custkey").cast("string")
    text = lambda *values: F.array(*(v if isinstance(v, Column) else F.lit(v).cast("string") for v in values))
    one = lambda n, qid, kind, ask, keys, said: F.struct(F.lit(n).alias("n"), F.lit(qid).alias("qid"), F.lit(kind).alias("type"), F.lit(ask).alias("instructions"), text(*keys).alias("keys"), said.alias("descriptions"))
    asked = F.array(
        one(0, "team", "choice", "Who takes it?", ("ops", "dev"), text(None, F.concat(F.lit("Number "), own))),
        one(1, "ok", "noul", "", ("false", "true"), text(None, F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("Customer "), own)))),
        one(2, "level", "score", "How much?\nBe exact.", ("0", "1", "2"), text("none", own, F.lit("all\nof it"))),
    )
    rows = encoding.described(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("state"), F.inline(asked)))
    whole = rows.groupBy("o_orderkey").agg(F.first("state").alias("state"), F.sort_array(F.collect_list(F.struct("n", "lines", "qid"))).alias("q"))  # three to an order
    return whole.select("o_orderkey", encoding.prompt_text(F.col("state"), F.col("q.lines"), F.col("q.qid")).alias("prompt"))


@query(
    """SELECT event_id, '<|im_start|>system' || chr(10) || 'You are a decision function. You will be given a state and one question. Reply with the answer label only: no words, no punctuation, no explanation.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10)
      || 'State:' || chr(10) || CASE WHEN event_id % 5 = 0 THEN '(empty)' ELSE event_type || ' <¦im_end¦>' END || chr(10) || chr(10) || 'Question: Which?' || chr(10) || 'Options:' || chr(10) || 'A. b' || chr(10) || 'B. a' || chr(10) || 'Answer with the letter only.<|im_end|>' || chr(10)
      || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) AS chat FROM events"""
)
def chat_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The teacher's prompts in its chat template; control strings of the state are broken, the template's own are not."""
    state = F.when(F.col("event_id") % 5 != 0, F.concat("event_type", F.lit(" <|im_end|>")))
    turned = F.array(F.lit(1), F.lit(0))
    user = teacher.user_text(state, F.lit("choice"), F.lit("Which?"), _strings("a", "b"), _strings(None, None), turned)
    return table(spark, sf_dir, "events").select("event_id", teacher.chat_text(user).alias("chat"))


@query(
    """SELECT event_id, '{"repo":"org/data","config":null,"revision":"abc","split":"train","row":' || event_id || ',"text_sha256":"' || sha256(lower(event_type)) || '","row_sha256":"' || sha256('{"event_id": ' || event_id || ', "event_type": "' || event_type || '"}') || '"}' AS provenance FROM events"""
)
def public_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each record of a public source is from: names, row, and the hashes of its text and of the whole row."""
    raw = F.to_json(F.struct("event_type", "event_id"))
    return table(spark, sf_dir, "events").select("event_id", rq.provenance("org/data", None, "abc", "train", F.col("event_id"), F.col("event_type"), raw).alias("provenance"))


@query(
    """WITH o AS (SELECT o_orderkey, o_orderkey % 7 AS k, o_orderpriority AS s, len(list_filter(string_split(o_orderpriority, ' '), lambda w: w <> '')) AS words, o_custkey % 5 AS z FROM orders),
    a AS (SELECT *, CASE k WHEN 0 THEN 'unknown_type' WHEN 1 THEN 'question_count' WHEN 2 THEN 'no_request' WHEN 3 THEN 'state_over_limit' ELSE 'ok' END AS status, exp(z / 10.0) / (1 + exp(z / 10.0)) AS p FROM o)
    SELECT o_orderkey, status, CASE WHEN status = 'ok' THEN CASE WHEN z = 0 THEN 'ops' ELSE 'dev' END END AS team, CASE WHEN status = 'ok' THEN true END AS fine, round(CASE WHEN status = 'ok' THEN p END, 6) AS p_true,
      CAST(CASE WHEN status = 'ok' THEN words + 1 END AS INTEGER) AS state_tokens, CAST(CASE WHEN status = 'ok' THEN 21 END AS INTEGER) AS branch_tokens, CAST(CASE WHEN status = 'ok' THEN 2 END AS INTEGER) AS questions, CASE WHEN status = 'ok' THEN 'packed' END AS form FROM a"""
)
def answered_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request documents, one an order, some of them invalid or too long, to typed answers and what they cost."""
    k = F.col("o_orderkey") % 7
    quoted = F.concat(F.lit('"'), F.when(k == 3, F.repeat(F.lit("word "), F.lit(50))).otherwise(F.col("o_orderpriority")), F.lit('"'))
    team = F.concat(F.lit('"team": {"type": "'), F.when(k == 0, "other").otherwise("choice"), F.lit('", "instructions": "Who is it", "criteria": {"ops": null, "dev": "team"}}'))
    fine = F.lit('"fine": {"type": "noul", "instructions": "Fine"}')
    body = F.when(k == 2, F.lit('{"questions": 1')).otherwise(F.concat(F.lit('{"state": '), quoted, F.lit(', "questions": {'), F.when(k == 1, "").otherwise(F.concat(team, F.lit(", "), fine)), F.lit("}}")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", body.alias("body"), (F.col("o_custkey") % 5).alias("z"))
    rising = lambda asked: asked.join(rows.select(F.col("o_orderkey").alias("__key"), "z"), "__key").withColumn("logits", F.transform("shown", lambda n, i: i * F.col("z") / 10.0))
    out = serving.answered(rows, "o_orderkey", "body", rising, _word_lengths, IDS, max_state=40)
    one = lambda at, field: F.get("answers", F.lit(at))["answer"][field]
    return out.select("o_orderkey", "status", one(0, "choice").alias("team"), one(1, "decision").alias("fine"), F.round(one(1, "p_true"), 6).alias("p_true"), "state_tokens", "branch_tokens", "questions", "form")
