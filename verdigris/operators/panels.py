"""A panel of records through systems that answer: order variants, raw and calibrated answers, the label teacher by layouts, generated texts.

records: record_id, source_family, schema_family, state, questions (structs of qid, type, keys, gold, task) and `context`, ok or why
the record is refused. A system is a function that adds `logits` to rows, one for each key in `shown`, in the order in which
the options are shown.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions import numeric as nm
from verdigris.functions import python_udfs as py
from verdigris.functions import questions as qs
from verdigris.operators import reports
from verdigris.operators.converters import shuffled

Answers = Callable[[DataFrame], DataFrame]


def asked(records: DataFrame, order_variants: int = 0, seed: int = 42) -> DataFrame:
    """A row for each question of each variant of each record: variant, question, type, names, gold, task and `shown`, the keys in the order asked.

    `canonical` is the record as it is; a record that asks a choice of two options or more also comes as order0, order1, ...,
    with the options of its choices in an order that the seed, the record and the variant draw.
    """
    several = F.exists("questions", lambda q: (q["type"] == "choice") & (F.size(q["keys"]) > 1))
    numbers = F.when(several, F.sequence(F.lit(-1), F.lit(order_variants - 1))).otherwise(F.array(F.lit(-1)))
    rows = records.withColumn("__v", F.explode(numbers)).withColumn("__q", F.explode("questions"))
    drawn = shuffled(F.col("__q.keys"), F.concat_ws("/", F.col("record_id").cast("string"), F.col("__v").cast("string")), seed)
    shown = F.when((F.col("__v") >= 0) & (F.col("__q.type") == "choice"), drawn).otherwise(F.col("__q.keys"))
    variant = F.when(F.col("__v") < 0, "canonical").otherwise(F.concat(F.lit("order"), F.col("__v").cast("string")))
    own = ("record_id", "source_family", "schema_family", "state", "context")
    return rows.select(*own, variant.alias("variant"), F.col("__q.qid").alias("question"), F.col("__q.type").alias("type"), F.col("__q.keys").alias("names"), F.col("__q.gold").alias("gold"), F.col("__q.task").alias("task"), shown.alias("shown"))


def _answered(rows: DataFrame, panel: str, system: Column, by_key: Column, eligible: Column, reason: Column, *keep: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return reports.evaluation_rows(rows.withColumns({"by_key": by_key, "said": none, "eligible": eligible, "reason": reason, "__system": system}), panel, F.col("__system"), F.col("variant"), *keep)


def converted_rows(records: DataFrame, answers: Answers, panel: str, temperature: float, order_variants: int = 0, seed: int = 42) -> DataFrame:
    """Evaluation rows of a model: converted_raw for every variant, converted_cal (logits over the temperature) for the canonical one.

    Each question is answered once, whatever systems read the logits. A record that is refused gives rows that aren't eligible,
    with the limit that it passes, for the same variants and systems.
    """
    rows = asked(records, order_variants, seed)
    fine = F.coalesce(F.col("context") == "ok", F.lit(False))
    scored = answers(rows.where(fine)).unionByName(rows.where(~fine), allowMissingColumns=True)
    one = lambda name, t: F.struct(F.lit(name).alias("name"), F.lit(float(t)).alias("t"))
    both = F.array(one("converted_raw", 1), one("converted_cal", temperature))
    rows = scored.withColumn("__s", F.explode(F.when(F.col("variant") == "canonical", both).otherwise(F.slice(both, 1, 1))))
    by_key = F.when(F.col("logits").isNotNull(), F.map_from_arrays("shown", nm.softmax(F.col("logits"), F.col("__s.t"))))
    return _answered(rows, panel, F.col("__s.name"), by_key, fine, F.when(~fine, F.concat(F.lit("admission: "), F.coalesce("context", F.lit("unknown")))))


def scorer_rows(records: DataFrame, answers: Answers, panel: str, modes: Sequence[str] = ("raw", "cyclic"), order_variants: int = 0, seed: int = 42) -> DataFrame:
    """Evaluation rows of the label teacher, parent_raw and parent_cyclic, with the number of layouts.

    raw reads the first layout, cyclic combines all rotations of a choice and both orders of a noul by the mean of log
    probabilities. Each layout is scored once for both modes. Questions that the labels don't reach aren't eligible, and say why.
    """
    if not modes or set(modes) - {"raw", "cyclic"}:
        raise ValueError(f"modes are raw and cyclic, not {modes}")
    rows = asked(records, order_variants, seed)
    k = F.size("shown")
    rows = rows.withColumn("reason", qs.ineligible_reason(F.col("type"), k))
    every = rows.where(F.col("reason").isNull()).withColumn("__t", qs.teacher_keys(F.col("type"), F.col("shown")))
    every = every.select("*", F.posexplode(qs.layouts(F.col("type"), k, "cyclic" in modes)).alias("__at", "__perm"))
    every = every.withColumn("shown", F.transform("__perm", lambda i: F.get("__t", i)))
    scored = answers(every.drop("__t", "__perm"))
    in_key_order = F.transform("names", lambda n: F.element_at(F.map_from_arrays("shown", nm.softmax(F.col("logits"))), n))
    own = [c for c in rows.columns if c not in ("shown", "reason")]
    found = scored.withColumn("p", in_key_order).groupBy("record_id", "variant", "question").agg(*(F.first(c).alias(c) for c in own if c not in ("record_id", "variant", "question")), F.sort_array(F.collect_list(F.struct("__at", "p"))).alias("by"))  # 26 layouts at most
    by = F.col("by.p")
    mode = lambda name, p, n: F.struct(F.lit(f"parent_{name}").alias("name"), F.map_from_arrays("names", p).alias("by_key"), n.alias("layouts"))
    known = {"raw": mode("raw", by[0], F.lit(1)), "cyclic": mode("cyclic", nm.cyclic_combine(by), F.size("by"))}
    told = found.withColumn("__s", F.explode(F.array(*(known[m] for m in modes)))).withColumn("reason", F.lit(None).cast("string"))
    empty = F.lit(None).cast(told.schema["__s"].dataType["by_key"].dataType)
    refused = rows.where(F.col("reason").isNotNull()).drop("shown").withColumn("__s", F.explode(F.array(*(F.struct(F.lit(f"parent_{m}").alias("name"), empty.alias("by_key"), F.lit(0).alias("layouts")) for m in modes))))
    both = told.drop("by").unionByName(refused).withColumn("layouts", F.col("__s.layouts"))
    return _answered(both, panel, F.col("__s.name"), F.col("__s.by_key"), F.col("reason").isNull(), F.col("reason"), "layouts")


def json_rows(records: DataFrame, generate: Callable[[DataFrame], DataFrame], panel: str, system: str = "parent_json") -> DataFrame:
    """Evaluation rows of a system that writes its answers as JSON: the key that each question's answer names, parse_ok, answered, and the text where there is none.

    generate adds `text` to the records. An object anywhere in the text counts; a question that it doesn't answer has no prediction.
    """
    each = lambda field: F.transform("questions", lambda q: q[field])
    told = generate(records).withColumn("__a", py.parsed_answers("text", each("qid"), each("type"), each("keys")))
    rows = told.select("record_id", "source_family", "schema_family", "text", "__a", F.posexplode("questions").alias("__k", "__q"))
    said = F.get("__a.answers", F.col("__k"))
    rows = rows.select("record_id", "source_family", "schema_family", F.col("__q.qid").alias("question"), F.col("__q.type").alias("type"), F.col("__q.keys").alias("names"), F.col("__q.gold").alias("gold"), F.col("__q.task").alias("task"), F.lit(None).cast("map<string,double>").alias("by_key"), said.alias("said"), F.lit(True).alias("eligible"), F.lit(None).cast("string").alias("reason"), F.col("__a.parse_ok").alias("parse_ok"), said.isNotNull().alias("answered"), F.when(said.isNull(), F.col("text")).alias("text"))
    return reports.evaluation_rows(rows, panel, system, "canonical", "parse_ok", "answered", "text")
