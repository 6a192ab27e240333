"""Requests in, answers out: validation, packing, admission, a scorer, and typed answers with what they cost."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions import numeric as nm
from verdigris.functions import python_udfs as py
from verdigris.functions import questions as qs
from verdigris.operators import attention, encoding


def encoded_requests(requests: DataFrame, raw: str, tokens: Callable[[Column], Column], ids: Mapping[str, int], max_state: int = qs.MAX_STATE, max_row: int = qs.MAX_ROW) -> DataFrame:
    """requests (raw: a column of request documents as JSON) with status, state, questions and the packed layout (layout.ids, seg, pos, opt, decide_idx, opt_idx, n_state).

    status is ok, the first problem of the document, or the limit that its tokens pass; otherwise than ok the layout is null.
    """
    own = F.struct(*(F.col(f"`{c}`") for c in requests.columns))
    rows = requests.select(own.alias("__own"), py.request(F.col(f"`{raw}`")).alias("__r"))
    rows = rows.select("__own", F.col("__r.problem").alias("problem"), F.col("__r.text").alias("state"), F.col("__r.questions").alias("questions"))
    asked = F.transform("questions", lambda q: F.struct(q["instructions"].alias("instructions"), encoding.option_texts(q["type"], q["keys"], q["descriptions"]).alias("options")))
    whole = F.struct("__own", "problem", "state", "questions")
    none = F.array().cast("array<struct<instructions:string,options:array<string>>>")
    packed = encoding.encoded(rows.select(whole.alias("record_id"), "state", F.coalesce(asked, none).alias("questions")), tokens, ids, max_state, max_row)
    status = F.coalesce("record_id.problem", "status")
    layout = F.struct("n_state", "ids", "seg", "pos", "opt", "decide_idx", "opt_idx")
    return packed.select("record_id.__own.*", status.alias("status"), F.col("record_id.state").alias("state"), F.col("record_id.questions").alias("questions"), F.when(status == "ok", layout).alias("layout"))


def answered(requests: DataFrame, key: str, raw: str, answers: Callable[[DataFrame], DataFrame], tokens: Callable[[Column], Column], ids: Mapping[str, int], temperature: float = 1.0, form: str = "packed", max_state: int = qs.MAX_STATE, max_row: int = qs.MAX_ROW) -> DataFrame:
    """A row for each request: key, status, answers (qid and typed answer, in the request's order), state_tokens, branch_tokens, questions, form.

    answers adds `logits` to rows of state and shown (a question's keys), as a scorer does. A refused request has its status and no
    answers. form is what the request runs in: packed layouts over the limit run cached. Keys name requests: they are distinct.
    """
    rows = encoded_requests(requests.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{raw}`").alias("__raw")), "__raw", tokens, ids, max_state, max_row)
    size = F.size("layout.ids")
    runs = F.when(F.lit(form == "packed") & (size > attention.PACKED_TOKENS), "cached").otherwise(F.lit(form))
    told = rows.select("__key", "status", F.col("layout.n_state").alias("state_tokens"), (size - F.col("layout.n_state")).alias("branch_tokens"), F.when(F.col("status") == "ok", F.size("questions")).alias("questions"), F.when(F.col("status") == "ok", runs).alias("form"))
    # Spark underrates the size of exploded questions and would broadcast those of all requests: they ask for merge joins.
    asked = rows.where(F.col("status") == "ok").select("__key", "state", F.posexplode("questions").alias("at", "q")).hint("merge")
    scored = answers(asked.select("__key", "state", "at", F.col("q.qid").alias("qid"), F.col("q.type").alias("type"), F.col("q.keys").alias("shown")))
    one = encoding.answers(F.col("type"), F.col("shown"), nm.softmax(F.col("logits"), F.lit(float(temperature))))
    found = scored.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("at", "qid", one.alias("answer"))), lambda a, b: a["at"] - b["at"]).alias("found"))  # 32 questions at most
    found = found.select("__key", F.transform("found", lambda x: x.dropFields("at")).alias("answers"))
    return told.join(found.hint("merge"), "__key", "left").select(F.col("__key").alias(key), "status", "answers", "state_tokens", "branch_tokens", "questions", "form")
