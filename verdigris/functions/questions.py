"""Column expressions over typed questions: keys, labels, layouts, checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Most questions and options of a request, most choices and levels that the label scheme reaches.
MAX_QUESTIONS, MAX_OPTIONS, MAX_CHOICE, MAX_SCORE = 32, 255, 26, 10
#: Token limits of a request's state and of a row (state and one question).
MAX_STATE, MAX_ROW = 2048, 4096


def indices(n: Column) -> Column:
    """0 .. n - 1; empty for 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def question_keys(kind: Column, names: Column) -> Column:
    """Stable keys: a choice's option ids, false and true, or a score's level numbers. names: option ids or level texts."""
    return F.when(kind == "choice", names).when(kind == "noul", F.array(F.lit("false"), F.lit("true"))).otherwise(F.transform(indices(F.size(names)), lambda i: i.cast("string")))


def teacher_keys(kind: Column, names: Column) -> Column:
    """Keys in the teacher's order: true before false, else as question_keys."""
    return F.when(kind == "noul", F.array(F.lit("true"), F.lit("false"))).otherwise(question_keys(kind, names))


def answer_labels(kind: Column, k: Column) -> Column:
    """What the teacher answers with: letters, digits, or Yes and No."""
    return F.when(kind == "noul", F.array(F.lit("Yes"), F.lit("No"))).when(kind == "choice", F.transform(indices(F.least(k, F.lit(MAX_CHOICE))), lambda i: F.char(i + 65))).otherwise(F.transform(indices(k), lambda i: i.cast("string")))


def ineligible_reason(kind: Column, k: Column) -> Column:
    """Why the label teacher can't score a question; null if it can."""
    return (
        F.when((kind == "choice") & (k > MAX_CHOICE), F.concat(F.lit("choice has "), k.cast("string"), F.lit(f" options; the letter-label teacher supports at most {MAX_CHOICE}")))
        .when((kind == "score") & (k > MAX_SCORE), F.concat(F.lit("score has "), k.cast("string"), F.lit(f" levels; the digit-label teacher supports at most {MAX_SCORE}")))
    )


def layouts(kind: Column, k: Column, cyclic: bool = True) -> Column:
    """Orders in which options are shown: all rotations of a choice, both orders of a noul, one of a score. First: canonical."""
    rotations = F.transform(indices(k), lambda s: F.transform(indices(k), lambda j: (j + s) % k.cast("int")))
    canonical = F.array(indices(k))
    both = F.array(F.array(F.lit(0), F.lit(1)), F.array(F.lit(1), F.lit(0)))
    if not cyclic:
        return F.when(kind == "noul", F.slice(both, 1, 1)).otherwise(canonical)
    return F.when(kind == "noul", both).when(kind == "score", canonical).otherwise(rotations)


def problem(kind: Column, names: Column) -> Column:
    """Why a question is invalid; null if it is valid. names: option ids, level texts, or a noul's criteria keys (nullable)."""
    bad_names = F.exists(names, lambda n: n.isNull() | (n == ""))
    return (
        F.when(kind == "noul", F.when(F.size(F.array_except(F.coalesce(names, F.array().cast("array<string>")), F.array(F.lit("true"), F.lit("false")))) > 0, "noul_keys"))
        .when(~kind.isin("choice", "score") | kind.isNull(), "unknown_type")
        .when(names.isNull() | (F.size(names) < 1) | (F.size(names) > MAX_OPTIONS), "option_count")
        .when((kind == "choice") & bad_names, "empty_option_id")
    )


def admission(state_tokens: Column, branch_tokens: Column, max_state: int = MAX_STATE, max_row: int = MAX_ROW) -> Column:
    """ok, or which limit is passed: a request is refused, never cut. state_tokens is without its delimiter."""
    return F.when(state_tokens + 1 > max_state, "state_over_limit").when(F.exists(branch_tokens, lambda b: state_tokens + 1 + b > max_row), "row_over_limit").otherwise("ok")
