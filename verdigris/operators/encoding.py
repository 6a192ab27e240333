"""Requests to texts, packed token layouts and answers, all as columns over arrays.

A question row has record_id, qid, type, instructions, keys and descriptions (one a key; a noul's are of false and
true). Token ids come from the caller's tokenizer as a column builder, so that packing itself never leaves the JVM.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions import numeric as nm
from verdigris.functions import python_udfs as py
from verdigris.functions import questions as qs
from verdigris.functions import text as tx

#: The delimiter tokens of a layout, and what a token is in `opt` if it is no option's.
DELIMITERS = {"state": "<|fim_prefix|>", "question": "<|fim_middle|>", "option": "<|box_start|>", "end_option": "<|box_end|>", "decide": "<|fim_suffix|>"}
NO_OPTION, DECIDE = -1, -2
MAX_PACKED = 8192


def delimiter_ids(vocabulary: Mapping[str, int]) -> dict[str, int]:
    """The delimiters' ids; a vocabulary that lacks one is refused."""
    missing = [t for t in DELIMITERS.values() if t not in vocabulary]
    if missing:
        raise ValueError(f"the tokenizer lacks {missing}")
    return {name: vocabulary[t] for name, t in DELIMITERS.items()}


def option_texts(kind: Column, keys: Column, descriptions: Column) -> Column:
    """What options read like: `id: description`, a score's level texts, no and yes for a noul. Descriptions are rendered."""
    named = F.when(kind == "noul", F.array(F.lit("no"), F.lit("yes"))).otherwise(keys)
    return F.when(kind == "score", F.transform(descriptions, lambda d: F.coalesce(d, F.lit("")))).otherwise(F.zip_with(named, descriptions, tx.option_text))


def rendered(questions: DataFrame) -> DataFrame:
    """Question rows with instructions and descriptions rendered as text, `options`, and a score's `legend` (level to text)."""
    out = questions.withColumns({"instructions": F.coalesce(py.render_content("instructions"), F.lit("")), "descriptions": py.render_all("descriptions")})
    out = out.withColumn("options", option_texts(F.col("type"), F.col("keys"), F.col("descriptions")))
    return out.withColumn("legend", F.when(F.col("type") == "score", F.map_from_arrays("keys", "options")))


def encoded(records: DataFrame, tokens: Callable[[Column], Column], ids: Mapping[str, int], max_state: int = qs.MAX_STATE, max_row: int = qs.MAX_ROW, max_packed: int | None = None) -> DataFrame:
    """records (record_id, state, questions: array of struct with instructions and options) as packed layouts.

    ids, seg (0: state, k: question k), pos (each question's go on from the state's), opt (option number, -1, or -2 for
    the decision), n_state, decide_idx, opt_idx (each option's last token). status is `ok` or the limit that is passed;
    then the layout is null: nothing is cut. Control strings in texts are escaped before they become tokens.
    """
    own = lambda text: tokens(tx.escape_control(text))
    lit = lambda name: F.array(F.lit(ids[name]))
    state = F.concat(lit("state"), own(F.coalesce("state", F.lit(""))))
    parts = F.transform("questions", lambda q: F.struct(F.concat(lit("question"), own(q["instructions"])).alias("head"), F.transform(q["options"], lambda o: F.concat(lit("option"), own(o), lit("end_option"))).alias("spans")))
    rows = records.select("record_id", state.alias("s"), parts.alias("parts"))
    branch = F.transform("parts", lambda p: F.concat(p["head"], F.flatten(p["spans"]), lit("decide")))
    rows = rows.withColumns({"n_state": F.size("s"), "branches": branch})
    n = F.col("n_state")
    starts = F.transform("branches", lambda b, k: n + F.aggregate(F.slice("branches", F.lit(1), k), F.lit(0), lambda a, x: a + F.size(x)))
    rows = rows.withColumn("starts", starts)
    marks = F.transform("parts", lambda p: F.concat(F.array_repeat(F.lit(NO_OPTION), F.size(p["head"])), F.flatten(F.transform(p["spans"], lambda s, j: F.array_repeat(j, F.size(s)))), F.array(F.lit(DECIDE))))
    ends = F.zip_with("parts", "starts", lambda p, at: F.transform(p["spans"], lambda s, j: at + F.size(p["head"]) + F.aggregate(F.slice(p["spans"], F.lit(1), j + 1), F.lit(0), lambda a, x: a + F.size(x)) - 1))
    flat = lambda head, tail: F.concat(head, F.flatten(tail))
    row_over = F.exists("branches", lambda b: n + F.size(b) > max_row)
    packed_over = F.lit(False) if max_packed is None else n + F.aggregate("branches", F.lit(0), lambda a, b: a + F.size(b)) > max_packed
    status = F.when(n > max_state, "state_over_limit").when(row_over, "row_over_limit").when(packed_over, "packed_over_limit").otherwise("ok")
    layout = {
        "ids": flat(F.col("s"), F.col("branches")),
        "seg": flat(F.array_repeat(F.lit(0), n), F.transform("branches", lambda b, k: F.array_repeat(k + 1, F.size(b)))),
        "pos": flat(qs.indices(n), F.transform("branches", lambda b: F.transform(qs.indices(F.size(b)), lambda i: i + n))),
        "opt": flat(F.array_repeat(F.lit(NO_OPTION), n), marks),
        "decide_idx": F.zip_with("branches", "starts", lambda b, at: at + F.size(b) - 1),
        "opt_idx": ends,
    }
    return rows.withColumn("status", status).select("record_id", "status", "n_state", *(F.when(F.col("status") == "ok", c).alias(name) for name, c in layout.items()))


def rows_of(layouts: DataFrame) -> DataFrame:
    """Each question's own row: state_ids, state_pos, and ids, pos, decide and opts counted from the branch's first token."""
    ok = layouts.where(F.col("status") == "ok")
    start = F.when(F.col("k") == 0, F.col("n_state")).otherwise(F.get("decide_idx", F.col("k") - 1) + 1)
    rows = ok.select("record_id", "n_state", "ids", "pos", "decide_idx", "opt_idx", F.posexplode("decide_idx").alias("k", "decide")).withColumn("start", start)
    cut = lambda name: F.slice(name, F.col("start") + 1, F.col("decide") - F.col("start") + 1)
    head = lambda name: F.slice(name, F.lit(1), F.col("n_state"))
    return rows.select("record_id", (F.col("k") + 1).alias("question"), head("ids").alias("state_ids"), head("pos").alias("state_pos"), cut("ids").alias("ids"), cut("pos").alias("pos"), (F.col("decide") - F.col("start")).alias("decide"), F.transform(F.get("opt_idx", "k"), lambda o: o - F.col("start")).alias("opts"))


def answers(kind: Column, keys: Column, probs: Column) -> Column:
    """An answer as a struct: type, decision and p_true (noul), choice, level and expected_level (score), top_probability, probabilities.

    Ties go to the first key; a noul of one half is true. A number of probabilities that isn't the keys' raises an error.
    """
    top = nm.argmax(probs)
    wrong = F.raise_error(F.lit("probabilities and keys differ in number"))
    return F.when(F.size(keys) != F.size(probs), wrong.cast("void").cast(_ANSWER)).otherwise(
        F.struct(
            kind.alias("type"),
            F.when(kind == "noul", F.get(probs, F.lit(1)) >= 0.5).alias("decision"),
            F.when(kind == "noul", F.get(probs, F.lit(1))).alias("p_true"),
            F.when(kind == "choice", F.get(keys, top)).alias("choice"),
            F.when(kind == "score", top).alias("level"),
            F.when(kind == "score", nm.expected_level(probs)).alias("expected_level"),
            F.when(kind != "noul", F.array_max(probs)).alias("top_probability"),
            F.map_from_arrays(keys, probs).alias("probabilities"),
        )
    )


_ANSWER = "struct<type:string,decision:boolean,p_true:double,choice:string,level:int,expected_level:double,top_probability:double,probabilities:map<string,double>>"


#: The wording of a prompt for structured answers. {..} stands for what a request gives.
ANSWERS = {
    "choice": "  answer: exactly one option id from this list, as a JSON string",
    "noul": "  answer: true or false, as a JSON boolean",
    "score": "  answer: one level index from 0 to {last}, as a JSON integer",
}
QUESTION, INSTRUCTIONS = "Question {qid} ({type})", "\n  instructions: {text}"
PROMPT = "Read the state and answer every question.\n\nState:\n{state}\n\nQuestions:\n{questions}\n\nRespond with only a JSON object whose keys are the question ids ({qids}) and whose values are the answers. No other text."


def worded(template: str, **parts: Column) -> Column:
    """A template's text with columns put in for its {names}."""
    pieces = [(F.lit(words) if words else None, parts[name] if name else None) for words, name, _, _ in string.Formatter().parse(template)]
    return F.concat(*(x for pair in pieces for x in pair if x is not None))


def _quoted(text: Column) -> Column:
    """A text as a JSON string."""
    whole = F.to_json(F.array(text))
    return whole.substr(F.lit(2), F.length(whole) - 2)


def described(questions: DataFrame) -> DataFrame:
    """Rendered question rows with `lines`, how a prompt for structured answers puts them.

    Under the question stand its options (id and description), a noul's two meanings where they are given, or a score's levels.
    """
    flat = lambda d: F.replace(F.coalesce(d, F.lit("")), F.lit("\n"), F.lit(" "))
    noul = F.filter(F.array(*(F.struct(F.lit(k).alias("name"), flat(F.get("descriptions", F.lit(at))).alias("said")) for k, at in (("true", 1), ("false", 0)))), lambda x: x["said"] != "")
    named = F.zip_with("keys", "descriptions", lambda k, d: F.struct(_quoted(k).alias("name"), flat(d).alias("said")))
    levels = F.transform("descriptions", lambda d, i: F.struct(i.cast("string").alias("name"), flat(d).alias("said")))
    items = F.when(F.col("type") == "choice", named).when(F.col("type") == "noul", noul).otherwise(levels)
    bare = F.col("type") == "choice"
    told = F.transform(items, lambda x: F.concat(F.lit("    "), x["name"], F.when(bare & (x["said"] == ""), "").otherwise(F.concat(F.lit(": "), x["said"]))))
    rule = F.coalesce(*(F.when(F.col("type") == kind, worded(words, last=(F.size("keys") - 1).cast("string"))) for kind, words in ANSWERS.items()))
    asked = F.when(F.col("instructions") != "", worded(INSTRUCTIONS, text=F.replace("instructions", F.lit("\n"), F.lit("\n    ")))).otherwise("")
    return questions.withColumn("lines", F.array_join(F.concat(F.array(F.concat(worded(QUESTION, qid=_quoted(F.col("qid")), type=F.col("type")), asked), rule), told), "\n"))


def prompt_text(state: Column, lines: Column, qids: Column) -> Column:
    """The whole prompt for structured answers: rendered state, described questions in order, and the ids to answer."""
    return worded(PROMPT, state=state, questions=F.array_join(lines, "\n"), qids=F.array_join(F.transform(qids, _quoted), ", "))
