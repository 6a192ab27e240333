"""Executable policies: rule trees compiled to three-valued Boolean columns, their texts, and the policy families.

Unknown is null: SQL's three-valued logic is the one that rules need.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rule trees over atom numbers, by name; the first eight train, three develop, three test.
SHAPES: dict[str, object] = {
    "atom": 0,
    "negation": ("not", 0),
    "conjunction": ("and", 0, 1),
    "disjunction": ("or", 0, 1),
    "exception": ("unless", 0, 1),
    "conditional": ("if", 0, 1, 2),
    "nested_and": ("and", ("and", 0, 1), 2),
    "nested_or": ("or", 0, ("or", 1, 2)),
    "held_and_or": ("and", ("or", 0, 1), 2),
    "held_or_not": ("or", ("and", 0, 1), ("not", 2)),
    "held_conditional": ("if", 0, ("not", 1), 2),
    "final_combination": ("and", ("if", 0, 1, 2), 3),
    "final_negation": ("not", ("or", ("and", 0, 1), 2)),
    "final_exception": ("or", ("unless", 0, 1), 2),
}
#: An atom in words, by kind: its fields by number, its threshold t, and t + 10 as u.
ATOM_WORDS = {
    "lt": "{0} is less than {t}",
    "le": "{0} is at most {t}",
    "gt": "{0} is greater than {t}",
    "ge": "{0} is at least {t}",
    "eq": "{0} is equal to {t}",
    "range": "{0} is between {t} and {u}, including both endpoints",
    "match": "{0} is the same person as {1}",
    "elapsed": "the elapsed days from {0} to {1} are at most {t}",
    "flag": "{0} is yes",
}


def atom(kind: str, x: Column, threshold: Column | None = None, other: Column | None = None) -> Column:
    """A fact's test; null facts give null."""
    tests = {
        "lt": lambda: x < threshold,
        "le": lambda: x <= threshold,
        "gt": lambda: x > threshold,
        "ge": lambda: x >= threshold,
        "eq": lambda: x == threshold,
        "range": lambda: x.between(threshold, threshold + 10),
        "match": lambda: x == other,
        "elapsed": lambda: F.datediff(other, x) <= threshold,
        "flag": lambda: x,
    }
    return tests[kind]()


def compiled(tree: object, atoms: Sequence[Column]) -> Column:
    """The tree as a Boolean column. `if` with an unknown condition is known where both branches agree."""
    if isinstance(tree, int):
        return atoms[tree]
    kind, *below = tree
    v = [compiled(t, atoms) for t in below]
    if kind == "if":
        return F.when(v[0], v[1]).when(~v[0], v[2]).when(v[1].eqNullSafe(v[2]), v[1])
    return {"not": lambda: ~v[0], "and": lambda: v[0] & v[1], "or": lambda: v[0] | v[1], "unless": lambda: v[0] & ~v[1]}[kind]()


def evaluated(tree: object, truths: Sequence[bool | None]) -> bool | None:
    """The tree's value for atoms that are true, false or unknown (None)."""
    if isinstance(tree, int):
        return truths[tree]
    kind, *below = tree
    v = [evaluated(t, truths) for t in below]
    if kind == "if":
        return v[1] if v[0] or (v[0] is None and v[1] is v[2]) else None if v[0] is None else v[2]
    if kind == "not":
        return None if v[0] is None else not v[0]
    if kind == "unless":
        kind, v = "and", [v[0], None if v[1] is None else not v[1]]
    wins = kind == "or"
    return wins if wins in v else None if None in v else not wins


def deciding_vectors(tree: object) -> list[tuple[tuple[bool, ...], tuple[int, ...]]]:
    """Every way for the tree's atoms to be true or false in which an atom decides, with the atoms that do: its opposite changes the value, and without it the value is unknown."""
    used = used_atoms(tree)
    out = []
    for truths in itertools.product((True, False), repeat=max(used) + 1):
        value = evaluated(tree, truths)
        with_one = lambda i, t, truths=truths: evaluated(tree, [*truths[:i], t, *truths[i + 1 :]])
        deciding = tuple(i for i in used if with_one(i, not truths[i]) != value and with_one(i, None) is None)
        if deciding:
            out.append((truths, deciding))
    return out


def used_atoms(tree: object) -> list[int]:
    """Atom numbers in order of first use."""
    if isinstance(tree, int):
        return [tree]
    return list(dict.fromkeys(a for t in tree[1:] for a in used_atoms(t)))


def atom_text(kind: str, fields: Sequence[str], threshold: int | None = None) -> str:
    return ATOM_WORDS[kind].format(*fields, t=threshold, u=None if threshold is None else threshold + 10)


#: Surface forms of each operation by style; styles 1 and 2 read the same.
SURFACE = {
    0: {"not": "NOT ({0})", "and": "({0}) AND ({1})", "or": "({0}) OR ({1})", "unless": "({0}) holds and the exception ({1}) does not hold", "if": "if ({0}), use ({1}); otherwise use ({2})"},
    1: {"not": "it is not the case that ({0})", "and": "both these conditions hold: [({0}); ({1})]", "or": "at least one of these conditions hold: [({0}); ({1})]", "unless": "({0}) holds and the exception ({1}) does not hold", "if": "if ({0}), use ({1}); otherwise use ({2})"},
    3: {"not": 'the condition "{0}" fails', "and": "{0}, and also {1}", "or": "either {0}, or else {1}", "unless": "{0}, except when {1}", "if": "when {0} the requirement is that {1}, and when it is not the requirement is that {2}"},
    4: {"not": "[NOT: {0}]", "and": "[ALL of: {0} | {1}]", "or": "[ANY of: {0} | {1}]", "unless": "[{0} UNLESS {1}]", "if": "[IF {0} THEN {1} ELSE {2}]"},
}


def rule_text(tree: object, atoms: Sequence[str], style: int) -> str:
    """The rule in words, in one of the styles 0 to 4."""
    if isinstance(tree, int):
        return atoms[tree]
    return SURFACE[1 if style == 2 else style][tree[0]].format(*(rule_text(t, atoms, style) for t in tree[1:]))


def day_text(day: Column) -> Column:
    return F.date_format(day, "MMMM d, yyyy")


def dollars(amount: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(amount, 0))


def tier(x: Column, first: Column | int, second: Column | int, strict: bool = False) -> Column:
    """Level 0, 1 or 2 by two bounds; null stays undetermined."""
    below = (lambda a, b: a < b) if strict else (lambda a, b: a <= b)
    return F.when(below(x, first), 0).when(below(x, second), 1).when(x.isNotNull(), 2)


#: Families by name: the label from facts and parameters; a missing fact gives null (undetermined).
FAMILIES = {
    "return_window": lambda f: F.datediff(f["request"], f["purchase"]) <= f["window"],
    "spend_threshold": lambda f: F.when(f["amount"] <= f["limit"], "auto_approved").when(f["amount"].isNotNull(), "director_signoff"),
    "authorization": lambda f: f["signer"] == f["approver"],
    "age_eligibility": lambda f: f["age"] >= f["minimum"],
    "quantity_limit": lambda f: F.when(f["qty"] <= f["limit"], "within_limit").when(f["qty"] <= 2 * f["limit"], "slightly_over").when(f["qty"].isNotNull(), "far_over"),
    "deadline": lambda f: tier(F.datediff(f["received"], f["due"]), 0, f["grace"]),
    "warranty_claim": lambda f: tier(F.datediff(f["claim"], f["purchase"]), f["standard"], f["extended"]),
    "sla_response": lambda f: tier(f["hours"], f["target"], f["breach"]),
    "late_fee": lambda f: tier(f["days_late"], f["grace"], f["cap"]),
    "volume_discount": lambda f: tier(f["units"], f["t1"], f["t2"], strict=True),
    "shipping_delay": lambda f: tier(F.datediff(f["delivered"], f["promised"]), f["minor"], f["major"]),
}


def pair_problem(a_label: Column, b_label: Column, differing: Column, same_length: Column, ablated_known: Column, filler_changed: Column, evidence: Column) -> Column:
    """Why a contrastive pair is rejected, the first of six reasons; null: accepted."""
    return (
        F.when(a_label.isNull() | b_label.isNull(), "label_undetermined")
        .when(a_label == b_label, "labels_equal")
        .when((differing != 1) | ~same_length, "not_exactly_one_sentence_differs")
        .when(ablated_known, "ablation_failed")
        .when(filler_changed, "invariance_failed")
        .when(evidence < 1, "no_evidence_sentence")
    )
