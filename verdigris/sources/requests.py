"""Requests and recipes from files, and what is made of small fixed sets: showcase, workload, sizes."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.functions import python_udfs as py
from verdigris.functions import questions as qs
from verdigris.functions import text as tx
from verdigris.operators import leakage
from verdigris.sources.readers import folder_digest, text_lines

#: Shares of splits by group, the only rule there is.
SPLIT_SPEC = {"train": 70, "dev": 10, "calibration": 10, "test": 10}
#: The showcase of support messages, its questions and gold answers.
SUPPORT_QUESTIONS = {
    "intent": ("choice", "Select the customer's main request.", {"refund": "Return money for a charge or purchase", "cancel": "End a subscription or service", "technical_issue": "Something in the product is broken or not working", "account_access": "Cannot log in or get into the account", "shipping": "Where an order is or when it will arrive", "billing_question": "Explain or change a bill, plan or payment method"}),
    "mentions_charge": ("noul", "Does the message say the customer was charged money?", {"false": None, "true": None}),
    "urgency": ("score", "Rate the urgency expressed in the message.", {"0": "routine", "1": "urgent", "2": "immediate"}),
}
SUPPORT = (
    ("I was charged twice for my March invoice and need the duplicate refunded.", "refund", "true", "1"),
    ("Please cancel my subscription at the end of this billing cycle. No rush, just don't renew it.", "cancel", "false", "0"),
    ("The app crashes every time I open the reports tab. It started after yesterday's update.", "technical_issue", "false", "1"),
    ("I'm locked out of my account and our payroll run is due in an hour. I need access right now!", "account_access", "false", "2"),
    ("My order was supposed to arrive last Tuesday and the tracking page hasn't updated in a week. Where is it?", "shipping", "false", "1"),
    ("Could you explain the line called 'platform fee' on my latest bill? I don't remember agreeing to it.", "billing_question", "true", "0"),
    ("Someone just charged $2,400 to my card through your store and it wasn't me. Refund it immediately and stop any further charges.", "refund", "true", "2"),
    ("Whenever you get a chance, I'd like to switch my plan from monthly to annual billing.", "billing_question", "false", "0"),
)


def source_seed(seed: int, source: str) -> int:
    """A source's own seed: 64 bits of the hash of both."""
    return int(hashlib.sha256(f"{seed}:{source}".encode()).hexdigest()[:16], 16)


def row_text(rows: DataFrame, field: str) -> Column:
    """What identifies a row: its text field, or all of it as JSON with sorted keys where that is null."""
    whole = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    if field not in rows.columns or dict(rows.dtypes)[field] != "string":
        return py.sorted_json(whole)
    text = F.col(f"`{field}`")
    return F.coalesce(text, py.sorted_json(F.when(text.isNull(), whole)))  # the other rows' JSON doesn't go to Python


def provenance(repo: str, config: str | None, revision: str | None, split: str, row: Column, text: Column, raw: Column) -> Column:
    """Where a public record is from, as JSON: names, row number, text and row hashes."""
    fixed = {"repo": repo, "config": config, "revision": revision, "split": split}
    return F.to_json(F.struct(*(F.lit(v).cast("string").alias(k) for k, v in fixed.items()), row.alias("row"), tx.text_hash(text).alias("text_sha256"), py.row_hash(raw).alias("row_sha256")), {"ignoreNullFields": "false"})


def labelled_requests(spark: SparkSession, path: str) -> DataFrame:
    """A custom corpus as labelled_lines reads it, a row for each line: with text_sha256 and the array of its questions (empty: no request)."""
    lines = text_lines(spark, path).where(F.trim("value") != "").withColumn("r", py.labelled_request("value"))
    return lines.select("file", "line", "r.*")


def labelled_lines(spark: SparkSession, path: str) -> DataFrame:
    """A custom corpus, one labelled request a line: a row for each question, with the file and the line's number in it (from 0).

    state is JSON, of any type; text is how it reads; instructions and descriptions are texts already. hashes are of the
    state's text and of each of its strings of five words or more. gold is the key that the label names; valid tells
    whether there is one. Blank lines are skipped; a line that is no request is one row without a question.
    """
    lines = labelled_requests(spark, path)
    rows = lines.select("file", "line", "state", "text", "hashes", "schema_family", "notes", F.explode_outer("questions").alias("q"))
    fields = ("qid", "type", "instructions", "keys", "descriptions", "gold")
    return rows.select("file", "line", "state", "text", "hashes", "schema_family", "notes", *(F.col(f"q.{c}").alias(c) for c in fields), F.col("q.gold").isNotNull().alias("valid"))


def named_lines(lines: DataFrame, name: str, several: bool = False) -> DataFrame:
    """Lines of a custom corpus (file, line, text_sha256) with their record and group ids."""
    file = F.regexp_extract("file", r"([^/]*)$", 1)
    record = F.concat_ws("/", F.lit(name), file, F.col("line").cast("string")) if several else F.concat_ws("/", F.lit(name), F.col("line").cast("string"))
    return lines.withColumns({"record_id": record, "group_id": F.concat(F.lit(f"{name}/"), F.substring("text_sha256", 1, 20))})


def custom_records(lines: DataFrame, name: str, seed: int, forbidden: DataFrame, spec: Mapping[str, int] = SPLIT_SPEC, several: bool = False) -> DataFrame:
    """Questions of a custom corpus with record and group ids and splits, and `excluded`: whether any of the state's hashes is among forbidden (hash).

    A forbidden text in one field of a state excludes it as the whole text does. Record ids are the corpus' name and the line; with
    several files also the file's name.
    """
    if dict(spec) != SPLIT_SPEC:
        raise ValueError(f"splits are {SPLIT_SPEC}")
    rows = named_lines(lines.withColumn("text_sha256", py.casefold_hash("text")), name, several)
    hit = leakage.colliding(rows.select("record_id", "hashes").distinct(), "record_id", "hashes", forbidden).withColumn("excluded", F.lit(True))
    rows = rows.join(hit, "record_id", "left").withColumn("excluded", F.coalesce("excluded", F.lit(False)))
    return rows.select("record_id", "group_id", F.lit(name).alias("source_family"), tx.split_of(F.col("group_id"), seed).alias("split"), *lines.columns, "text_sha256", "excluded")


def custom_report(records: DataFrame) -> DataFrame:
    """By corpus: lines read, those that are excluded for a forbidden text, and by reason those without a valid label or question."""
    line = records.groupBy("source_family", "record_id").agg(F.first("excluded").alias("excluded"), F.count("qid").alias("questions"), F.count_if(~F.col("valid")).alias("invalid"))
    return line.groupBy("source_family").agg(F.count("*").alias("read"), F.count_if("excluded").alias("excluded_text_collision"), F.count_if((F.col("questions") == 0) & ~F.col("excluded")).alias("no_question"), F.sum(F.when(~F.col("excluded") & (F.col("questions") > 0), F.col("invalid")).otherwise(0)).cast("long").alias("invalid_labels"))


def panel_files(spark: SparkSession, files: Mapping[str, str]) -> DataFrame:
    """Ad-hoc panels by name: their valid questions, with the panel and the digest of its files."""
    out = None
    for name, path in files.items():
        rows = labelled_lines(spark, path).where("valid").withColumn("panel", F.lit(name))
        rows = rows.withColumn("digest", F.lit(folder_digest(spark, path)))
        out = rows if out is None else out.unionByName(rows)
    return out


def whole_requests(spark: SparkSession, path: str) -> DataFrame:
    """Request documents, one JSON file each: file and request (its text)."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("value").alias("request"))


def first_requests(lines: DataFrame, ordinal: str, n: int) -> DataFrame:
    """The first n requests in their order: what a check reads."""
    return lines.orderBy(ordinal).limit(n)


def recipe(text: str) -> dict:
    """A recipe document: JSON, or YAML where the reader is installed."""
    try:
        return json.loads(text)
    except ValueError:
        import yaml

        return yaml.safe_load(text)


def support_showcase(spark: SparkSession) -> DataFrame:
    """The showcase's questions: eight messages, three questions each."""
    rows = [(f"support/{i}", message, qid, kind, ask, list(options), list(options.values()), gold) for i, (message, *golds) in enumerate(SUPPORT) for (qid, (kind, ask, options)), gold in zip(SUPPORT_QUESTIONS.items(), golds, strict=True)]
    return spark.createDataFrame(rows, "record_id string, state string, qid string, type string, instructions string, keys array<string>, descriptions array<string>, gold string")


def evaluation_order(rows: DataFrame, seed: int, label: str = "label") -> DataFrame:
    """Labelled rows (not -1) with their rank in a permutation by the seed, for every source at once."""
    labelled = rows.where(F.coalesce(F.col(label).try_cast("int"), F.lit(0)) != -1)
    return labelled.withColumn("rank", F.row_number().over(Window.partitionBy("source_family").orderBy(tx.order_hash(F.col("record_id"), seed), "record_id")))


def admitted(ranked: DataFrame, admits: Column, n: int, over: int = 2) -> DataFrame:
    """Of each source's first over * n candidates by rank those that are admitted, n at most: the panel's own limit."""
    near = ranked.where((F.col("rank") <= over * n) & admits)
    return near.withColumn("taken", F.row_number().over(Window.partitionBy("source_family").orderBy("rank"))).where(F.col("taken") <= n)


def admission_report(records: DataFrame, status: str = "status", tokens: str = "packed_tokens") -> DataFrame:
    """By split: how many were kept and dropped, and the longest kept one."""
    ok = F.col(status) == "ok"
    return records.groupBy("split").agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped"), F.max(F.when(ok, F.col(tokens))).alias("longest"))


def panel_manifest(candidates: DataFrame, kept: DataFrame) -> DataFrame:
    """By source: candidates, excluded for a text of the corpus, kept records and questions. candidates: source_family, record_id, excluded."""
    seen = candidates.groupBy("source_family").agg(F.count_distinct("record_id").alias("candidates"), F.count_distinct(F.when(F.col("excluded"), F.col("record_id"))).alias("excluded"))
    left = kept.groupBy("source_family").agg(F.count_distinct("record_id").alias("records"), F.count("*").alias("questions"))
    return seen.join(left, "source_family", "left").fillna(0)


def request_of(questions: DataFrame) -> DataFrame:
    """Question rows back to one request a record: state and questions (qid, type, instructions, keys, descriptions) in order; no labels."""
    one = F.struct("ordinal", "qid", "type", "instructions", "keys", "descriptions")
    rows = questions.groupBy("record_id").agg(F.first("state").alias("state"), F.array_sort(F.collect_list(one)).alias("questions"))
    return rows.withColumn("questions", F.transform("questions", lambda q: q.dropFields("ordinal")))


def has_choice(questions: Column) -> Column:
    """Whether a request asks a choice between options."""
    return F.exists(questions, lambda q: (q["type"] == "choice") & (F.size(q["keys"]) > 1))


def workload(spark: SparkSession, sentences: Sequence[str], words: int, count: int) -> DataFrame:
    """count distinct states of a given number of words: a ticket number, then the sentences in turn from the ticket's own on."""
    told = F.array(*(F.lit(s) for s in sentences))
    need = words // min(len(s.split()) for s in sentences) + 1
    body = F.transform(F.sequence(F.lit(0), F.lit(need)), lambda j: F.get(told, ((F.col("id") + j) % len(sentences)).cast("int")))
    text = F.concat(F.lit("Ticket "), (F.col("id") + 1000).cast("string"), F.lit(". "), F.array_join(body, " "))
    return spark.range(count).select(F.col("id").alias("request"), tx.word_clip(text, words).alias("state"))


def folder_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Bytes and files by ending under a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.groupBy(F.regexp_extract("path", r"\.([^./]+)$", 1).alias("ending")).agg(F.sum("length").alias("bytes"), F.count("*").alias("files"))


def yes_no(value: Column) -> Column:
    """A fact as text: yes and no for true and false."""
    return F.when(value, "yes").when(~value, "no")


def size_text(value: Column) -> Column:
    """Bytes in GB or MB, two places; null: not measured."""
    return F.when(value.isNull(), "not measured").when(value >= 1e9, F.format_string("%.2f GB", value / 1e9)).otherwise(F.format_string("%.2f MB", value / 1e6))


def percent_text(value: Column) -> Column:
    """A share as per cent with one place; null: not measured."""
    return F.when(value.isNull(), "not measured").otherwise(F.format_string("%.1f%%", value * 100))
