"""The label teacher: prompts for every type and layout, label tokens, targets as vectors for training."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions import questions as qs
from verdigris.functions import text as tx
from verdigris.operators import encoding
from verdigris.operators.targets import KEY, latest

#: What the teacher is told, and how a chat puts a system and a user text before an answer without thinking.
SYSTEM = "You are a decision function. You will be given a state and one question. Reply with the answer label only: no words, no punctuation, no explanation."
CHAT = "<|im_start|>system\n{system}<|im_end|>\n<|im_start|>user\n{user}<|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\n"

#: The teacher's prompt: its head, what stands for an empty state, and around the options of each type.
HEAD, EMPTY, MEANS = "State:\n{state}\n\nQuestion: {instructions}", "(empty)", "{name} means: {meaning}"
OPENING = {"choice": "Options:", "score": "Pick the level that applies (the levels are ordered):"}
CLOSING = {"choice": "Answer with the letter only.", "score": "Answer with the number only.", "noul": "Answer {first} or {second}."}


class LabelTokenError(ValueError):
    """A label is no single token, or two labels are the same one."""


def map_label_tokens(labels: Sequence[str], tokenise: Callable[[str], Sequence[int]]) -> tuple[list[int], list[str]]:
    """One token id a label, of the label itself or with a space in front, and the spelling used. A few dozen labels, at the driver."""
    chosen = [next(((ids[0], said) for said in (label, f" {label}") if len(ids := tokenise(said)) == 1), None) for label in labels]
    if None in chosen:
        raise LabelTokenError(f"no single token for {labels[chosen.index(None)]!r}")
    ids, spelled = [c[0] for c in chosen], [c[1] for c in chosen]
    if len(set(ids)) < len(ids):
        raise LabelTokenError(f"labels share a token: {dict(zip(labels, ids, strict=True))}")
    return ids, spelled


def user_text(state: Column, kind: Column, instructions: Column, options: Column, descriptions: Column, perm: Column) -> Column:
    """The teacher's prompt for one layout of a rendered question; control strings in it are escaped.

    perm: which option stands at each place. A noul names its two answers in the layout's order and says what they
    mean where that is given (descriptions: of false, of true).
    """
    labels = qs.answer_labels(kind, F.size(options))
    shown = F.transform(perm, lambda i, j: F.concat(F.get(labels, j), F.lit(". "), F.get(options, i)))
    given = lambda name, at: F.when(F.coalesce(F.get(descriptions, F.lit(at)), F.lit("")) != "", encoding.worded(MEANS, name=F.lit(name), meaning=F.get(descriptions, F.lit(at))))
    meanings = F.filter(F.array(given("Yes", 1), given("No", 0)), lambda x: x.isNotNull())
    either = encoding.worded(CLOSING["noul"], first=F.get(labels, F.get(perm, F.lit(0))), second=F.get(labels, F.get(perm, F.lit(1))))
    listed = lambda k: F.concat(F.array(F.lit(OPENING[k])), shown, F.array(F.lit(CLOSING[k])))
    body = F.when(kind == "noul", F.concat(meanings, F.array(either))).when(kind == "score", listed("score")).otherwise(listed("choice"))
    head = encoding.worded(HEAD, state=F.when(F.coalesce(state, F.lit("")) == "", EMPTY).otherwise(state), instructions=instructions)
    return tx.escape_control(F.concat_ws("\n", head, F.array_join(body, "\n")))


def chat_text(user: Column, template: str = CHAT, system: str = SYSTEM) -> Column:
    """System and user text in a chat template, up to where the answer begins."""
    before, after = template.replace("{system}", system).split("{user}")
    return F.concat(F.lit(before), user, F.lit(after))


def usable(targets: DataFrame, ordinal: str) -> DataFrame:
    """Targets that train: eligible, with a cyclic distribution; the last of each (record_id, qid)."""
    return latest(targets.where(F.col("eligible") & F.col("cyclic").isNotNull()), ordinal)


def with_teacher(questions: DataFrame, targets: DataFrame, gold_weight: float = 0.5) -> DataFrame:
    """Questions (record_id, qid, keys, gold) with `target`: gold and teacher blended, or gold alone where there is no target.

    targets: usable ones with cyclic (map of key to probability). Keys are matched by name, so their order doesn't
    count; a target whose keys aren't the question's is an error.
    """
    both = questions.join(targets.select(*KEY, "cyclic"), KEY, "left")
    gold = F.transform("keys", lambda k: (k == F.col("gold")).cast("double"))
    blended = F.transform("keys", lambda k: gold_weight * (k == F.col("gold")).cast("double") + (1 - gold_weight) * F.element_at("cyclic", k))
    same = F.array_sort(F.map_keys("cyclic")) == F.array_sort("keys")
    wrong = F.raise_error(F.concat(F.lit("teacher keys differ: "), F.concat_ws("/", *KEY)))
    return both.withColumn("target", F.when(F.col("cyclic").isNull(), gold).when(same, blended).otherwise(wrong.cast("array<double>"))).withColumn("taught", F.col("cyclic").isNotNull())


def coverage(questions: DataFrame, targets: DataFrame) -> DataFrame:
    """How many questions have a target, of how many."""
    found = questions.select(*KEY).join(targets.select(*KEY).distinct().withColumn("hit", F.lit(1)), KEY, "left")
    return found.agg(F.count("hit").alias("taught"), F.count("*").alias("questions"))


def mean_mass(masses: Column) -> Column:
    """Mean over the layouts of the probability on the labels."""
    return F.aggregate(masses, F.lit(0.0), lambda a, v: a + v) / F.size(masses)


def reasons(targets: DataFrame) -> DataFrame:
    """Why questions had no target, counted."""
    return targets.where(~F.col("eligible")).groupBy("reason").agg(F.count("*").alias("questions"))
