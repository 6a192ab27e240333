"""Seeded policy cases as DataFrames: families of contrastive pairs and compositions of rule trees, with texts and checked labels.

Rows are numbered and every draw is a hash of the seed, the draw's name and the row. What a family says and draws is a
table; one set of columns applies any row of it.
"""

from __future__ import annotations

import string
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import mul, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import policy as pl
from verdigris.functions import text as tx
from verdigris.store import numbered

#: Groups of composed cases that a task makes.
PER_TASK = 4096
#: What names, roles, things and programmes are drawn from.
NAMES = ("Mira", "Noah", "Priya", "Tomas", "Aiko", "Lena", "Omar", "Sana", "Jonas", "Ravi", "Elin", "Kofi")
ROLES = ("account owner", "billing manager", "support agent", "warehouse lead")
ITEMS = ("a pair of running shoes", "a desk lamp", "a wireless keyboard", "a rain jacket", "a coffee grinder", "a backpack")
PROGRAMS = ("the volunteer driver program", "the apprenticeship", "the rental agreement", "the night-shift roster")
#: A family's texts, parameters and bounds. {x} is an SQL expression over the drawn columns, with `,` in
#: thousands, with `day` as a date; a sentence comes with the facts that it states. levels: the ranges of the value
#: that the two cases differ in; first: one case is of the first level. day: the fact that a date is drawn for, its
#: last month, and the fact that is so many days later as the value says.
FAMILIES = {
    "return_window": {
        "policy": "Returns are accepted only if the return request is submitted within {window} days of the purchase date.",
        "sentences": (("{name} bought {item} on {purchase:day}.", "purchase"), ("The return request was submitted on {request:day}.", "request"), ("The order was paid by card and shipped to {name}'s home address.", "")),
        "ask": ("noul", "Is this return request within the policy window?", ()),
        "choose": {"window": (14, 30, 45, 60), "item": ITEMS, "name": NAMES}, "day": ("purchase", 1, 9, "request"), "first": True,
        "levels": (("1", "window - 1"), ("window + 1", "window + 30")),
    },
    "spend_threshold": {
        "policy": "Expense claims of ${limit:,} or less are approved automatically. Claims above ${limit:,} require director sign-off.",
        "sentences": (("{name}, the {role}, submitted an expense claim.", ""), ("The claim total is ${amount:,}.", "amount"), ("Receipts were attached for every line item.", "")),
        "ask": ("choice", "How is this claim handled under the policy?", (("auto_approved", "Approved without further review"), ("director_signoff", "Requires director sign-off"), ("rejected", "Rejected outright"))),
        "choose": {"limit": (250, 500, 1000, 2500), "name": NAMES, "role": ROLES}, "value": "amount", "first": True,
        "levels": (("limit - limit div 2", "limit - 1"), ("limit + 1", "2 * limit")),
    },
    "authorization": {
        "policy": "A refund is authorized only when its sole authorization was signed by someone who may authorize refunds for that account.",
        "sentences": (("Only {approver} may authorize refunds for account {account}.", "approver"), ("The sole authorization for this refund on account {account} was signed by {signer}.", "signer"), ("The refund amount is ${amount}.", "")),
        "ask": ("noul", "Is the refund authorized?", ()),
        "choose": {"approver": NAMES, "amount": (40, 120, 350, 900), "account": tuple(range(10, 100))}, "value": "signer", "first": True, "levels": (("0", "0"), ("1", "11")),
    },
    "age_eligibility": {
        "policy": "Applicants must be at least {minimum} years old to be eligible for {program}.",
        "sentences": (("{name} applied to join {program}.", ""), ("{name} is {age} years old.", "age"), ("The application form was complete and signed.", "")),
        "ask": ("noul", "Is the applicant eligible?", ()),
        "choose": {"minimum": (16, 18, 21, 25), "name": NAMES, "program": PROGRAMS}, "value": "age", "first": True,
        "levels": (("minimum", "minimum + 20"), ("minimum - 5", "minimum - 1")),
    },
    "quantity_limit": {
        "policy": "Customers may order at most {limit} units of any single item per order. Orders up to double the limit are held for review; larger orders are cancelled.",
        "sentences": (("{name} placed an order for {item}.", ""), ("The order quantity is {qty}.", "qty"), ("Delivery was requested to a residential address.", "")),
        "ask": ("choice", "What happens to this order?", (("within_limit", "Processed normally"), ("slightly_over", "Held for review"), ("far_over", "Cancelled"))),
        "choose": {"limit": (2, 3, 5, 10), "item": ITEMS, "name": NAMES}, "value": "qty", "first": True,
        "levels": (("1", "limit"), ("limit + 1", "2 * limit"), ("2 * limit + 1", "4 * limit")),
    },
    "deadline": {
        "policy": "Reports received by the deadline are on time. Reports received within {grace} days after the deadline are late but accepted. Later reports are refused.",
        "sentences": (("The filing deadline for {name}'s report was {due:day}.", "due"), ("The report was received on {received:day}.", "received"), ("The report was submitted through the online portal.", "")),
        "ask": ("score", "How late is this report?", ("On time", "Late but accepted", "Refused")),
        "choose": {"grace": (3, 7, 14), "name": NAMES}, "day": ("due", 2, 11, "received"), "first": True,
        "levels": (("-10", "0"), ("1", "grace"), ("grace + 1", "grace + 20")),
    },
    "warranty_claim": {
        "policy": "Warranty claims made within {standard} days of purchase are covered in full. Claims made after that but within {extended} days are covered at half cost. Later claims are not covered.",
        "sentences": (("{name} purchased {item} on {purchase:day}.", "purchase"), ("A warranty claim for it was filed on {claim:day}.", "claim"), ("The claim describes a defect in the {part}.", "")),
        "ask": ("score", "How is this claim covered?", ("Covered in full", "Covered at half cost", "Not covered")),
        "choose": {"standard,extended": ((90, 365), (180, 730), (365, 1095)), "item": ITEMS, "name": NAMES, "part": ("stitching", "battery", "housing", "zipper", "switch")}, "day": ("purchase", 1, 6, "claim"),
        "levels": (("1", "standard"), ("standard + 1", "extended"), ("extended + 1", "extended + 200")),
    },
    "sla_response": {
        "policy": "Support responses within {target} hours meet the service level. Responses after {target} but within {breach} hours are a minor breach. Anything slower is a major breach.",
        "sentences": (("{name} opened a priority ticket about {topic}.", ""), ("The first response arrived {hours} hours after the ticket was opened.", "hours"), ("The ticket was routed through the {queue} queue.", "")),
        "ask": ("score", "How does this response time rate against the service level?", ("Met", "Minor breach", "Major breach")),
        "choose": {"target,breach": ((4, 24), (8, 48), (24, 72), (1, 8)), "name": NAMES, "topic": ("a login failure", "a duplicate charge", "a missing invoice", "an export error"), "queue": ("email", "chat", "phone")}, "value": "hours",
        "levels": (("1", "target"), ("target + 1", "breach"), ("breach + 1", "breach + 100")),
    },
    "late_fee": {
        "policy": "Invoices paid within {grace} days after the due date incur no fee. Payments between {grace + 1} and {cap} days late incur a 2% fee. Payments later than {cap} days incur a 10% fee and a hold on the account.",
        "sentences": (("{name}'s invoice for ${amount:,} fell due last quarter.", ""), ("Payment was received {days_late} days after the due date.", "days_late"), ("The payment was made by {method}.", "")),
        "ask": ("score", "Which fee tier applies?", ("No fee", "2% fee", "10% fee and account hold")),
        "choose": {"grace,cap": ((5, 30), (10, 60), (15, 45)), "name": NAMES, "amount": (120, 450, 980, 2300), "method": ("bank transfer", "card", "cheque")}, "value": "days_late",
        "levels": (("0", "grace"), ("grace + 1", "cap"), ("cap + 1", "cap + 60")),
    },
    "volume_discount": {
        "policy": "Orders of fewer than {t1} units are charged the list price. Orders of {t1} to {t2 - 1} units receive the volume discount. Orders of {t2} units or more receive the wholesale rate.",
        "sentences": (("{name} placed a business order for {item}.", ""), ("The order is for {units} units.", "units"), ("Delivery is to a {dest}.", "")),
        "ask": ("score", "Which pricing tier applies?", ("List price", "Volume discount", "Wholesale rate")),
        "choose": {"t1,t2": ((10, 50), (25, 100), (5, 20), (100, 500)), "name": NAMES, "item": ITEMS, "dest": ("warehouse", "storefront", "branch office")}, "value": "units",
        "levels": (("1", "t1 - 1"), ("t1", "t2 - 1"), ("t2", "2 * t2")),
    },
    "shipping_delay": {
        "policy": "Deliveries up to {minor} day{if(minor > 1, 's', '')} after the promised date count as on time. Deliveries {minor + 1} to {major} days after it are a minor delay and earn a shipping refund. Later deliveries are a major delay and earn a full refund.",
        "sentences": (("{name} ordered {item} with delivery promised for {promised:day}.", "promised"), ("The parcel was delivered on {delivered:day}.", "delivered"), ("It was shipped by {carrier}.", "")),
        "ask": ("score", "How is this delivery classified?", ("On time", "Minor delay: shipping refund", "Major delay: full refund")),
        "choose": {"minor,major": ((1, 4), (2, 7), (3, 10)), "name": NAMES, "item": ITEMS, "carrier": ("the courier", "the postal service", "a freight partner")}, "day": ("promised", 1, 11, "delivered"),
        "levels": (("-3", "minor"), ("minor + 1", "major"), ("major + 1", "major + 30")),
    },
}
#: Nouns, people and kinds of atoms of composed rules; how a rule becomes a policy, by style.
NOUNS = ("request", "account", "package", "review", "member", "shipment", "entry", "case")
PEOPLE = ("Mira", "Noah", "Aiko", "Ravi", "Sana", "Elin", "Tomas", "Kofi")
KINDS = ("lt", "le", "gt", "ge", "eq", "range", "match", "elapsed", "flag")
WRAPPERS = {
    0: "Approve exactly when {rule}. Otherwise deny. The routing reference does not affect eligibility.",
    1: "Approve exactly when {rule}. Otherwise deny. The routing reference does not affect eligibility.",
    2: "Approval requires the following rule to be true: {rule}. A false rule means denial. Routing references are irrelevant.",
    3: "A case is approved when {rule}; any other case is denied. Routing references play no part in the decision.",
    4: "DECISION RULE {rule} -> approve; otherwise reject. Ignore the routing reference.",
}
CRITERIA = {"accept": "The policy permits this case", "reject": "The policy does not permit this case"}


def uniform(seed: int, name: str, *row: Column) -> Column:
    return tx.uniform(F.concat_ws(":", F.lit(str(seed)), F.lit(name), *(r.cast("string") for r in row)))


def whole(u: Column, low: Column, high: Column) -> Column:
    """A whole number from low to high by a uniform number."""
    return (low + F.floor(u * (high - low + 1))).cast("int")


def pick(values: Sequence, u: Column) -> Column:
    return F.get(F.array(*(F.lit(v) for v in values)), F.floor(u * len(values)).cast("int"))


def filled(template: str, columns: Mapping[str, Column] | None = None) -> Column:
    """The template's text with each {expression} put in: a given column, else SQL over the row."""
    parts = []
    for words, name, form, _ in string.Formatter().parse(template):
        if words:
            parts.append(F.lit(words))
        if name is not None:
            value = (columns or {}).get(name)
            value = F.expr(name) if value is None else value
            parts.append(pl.day_text(value) if form == "day" else F.format_number(value, 0) if form == "," else value.cast("string"))
    return F.concat(*parts)


def _without(facts: dict[str, Column], gone: str) -> dict[str, Column]:
    """The facts, that one unknown."""
    return {k: F.when(F.lit(False), v) if k == gone else v for k, v in facts.items()}


def _side(family: str, side: str) -> tuple[Column, Column, Column, Column]:
    """Of one case of a family: the sentences, the label, whether a label is known without its evidence, whether filler changes it."""
    own = FAMILIES[family]
    value, parameters = F.col(f"value_{side}"), {n: F.col(n) for names in own["choose"] for n in names.split(",")}
    if "day" in own:
        start, _, _, later = own["day"]
        facts = {start: F.col(start), later: F.date_add(F.col(start), value)}
    elif family == "authorization":
        other = F.get(F.array(*(F.lit(n) for n in NAMES)), ((F.array_position(F.array(*(F.lit(n) for n in NAMES)), F.col("approver")).cast("int") - 1 + value) % len(NAMES)))
        facts = {"signer": other, "approver": F.col("approver")}
    else:
        facts = {own["value"]: value}

    def label(f: dict[str, Column]) -> Column:
        return pl.FAMILIES[family](parameters | f).cast("string")

    told = [k for _, k in own["sentences"] if k]
    known = reduce(or_, [label(_without(facts, k)).isNotNull() for k in told])
    sentences = F.array(*(filled(t, facts) for t, _ in own["sentences"]))
    # A filler sentence states no fact: without it the label is computed from the same facts.
    return sentences, label(facts), known, ~label(facts).eqNullSafe(label(dict(facts)))


def candidates(ids: DataFrame, family: str, seed: int) -> DataFrame:
    """A drawn pair of a family for each id: id, policy, sentences, labels, and why the pair is rejected (null: it isn't)."""
    own = FAMILIES[family]
    u = lambda name: uniform(seed, f"{family}:{name}", F.col("id"))
    rows = ids.select("id")
    for names, values in own["choose"].items():
        chosen = F.floor(u(names) * len(values)).cast("int")
        several = names.split(",")
        rows = rows.withColumns({c: F.get(F.array(*(F.lit(v[k] if len(several) > 1 else v) for v in values)), chosen) for k, c in enumerate(several)})
    if "day" in own:
        start, first, last, _ = own["day"]
        rows = rows.withColumn(start, F.make_date(F.lit(2026), whole(u("month"), F.lit(first), F.lit(last)), whole(u("day"), F.lit(1), F.lit(28))))
    count = len(own["levels"])
    one = F.lit(0) if own.get("first") else F.floor(u("level") * count).cast("int")
    two = (one + 1 + F.floor(u("other") * (count - 1)).cast("int")) % count
    bounds = F.array(*(F.struct(F.expr(a).cast("int").alias("low"), F.expr(b).cast("int").alias("high")) for a, b in own["levels"]))
    for side, level in (("a", one), ("b", two)):
        rows = rows.withColumn(f"value_{side}", whole(u(f"value_{side}"), F.get(bounds, level)["low"], F.get(bounds, level)["high"]))
    (sa, la, ka, fa), (sb, lb, kb, fb) = _side(family, "a"), _side(family, "b")
    rows = rows.select("id", filled(own["policy"]).alias("policy"), sa.alias("sentences_a"), sb.alias("sentences_b"), la.alias("label_a"), lb.alias("label_b"), (ka | kb).alias("known"), (fa | fb).alias("changed"))
    differing = F.aggregate(F.zip_with("sentences_a", "sentences_b", lambda x, y: (x != y).cast("int")), F.lit(0), lambda a, x: a + x)
    evidence = F.lit(sum(bool(k) for _, k in own["sentences"]))
    why = pl.pair_problem(F.col("label_a"), F.col("label_b"), differing, F.size("sentences_a") == F.size("sentences_b"), F.col("known"), F.col("changed"), evidence)
    return rows.select("*", why.alias("why"))


def contrastive(spark: SparkSession, pairs: int | DataFrame, seed: int, families: Sequence[str] = tuple(FAMILIES), tries: int = 2) -> tuple[DataFrame, DataFrame]:
    """Two cases a pair and a report (family, why, n) of the pairs drawn; both cases tell their sentences in one drawn order.

    pairs: how many checked pairs of each family; the first valid ones of `tries` times as many candidates are taken, and if a
    family has too few a ValueError is raised. Or a table of ids: each gives a pair of one family, dealt by the id, whose name has
    the id; pairs that the checks reject are only in the report.
    """
    cases, reports = [], []
    drawn, table = {}, not isinstance(pairs, int)
    for k, family in enumerate(families):
        ids = pairs.where(F.pmod("id", F.lit(len(families))) == k) if table else spark.range(pairs * tries)
        drawn[family] = candidates(ids, family, seed)
        reports.append(drawn[family].groupBy(F.lit(family).alias("family"), "why").agg(F.count("*").alias("n")))
    report = reduce(DataFrame.unionByName, reports)
    if not table:
        reasons = {(r["family"], r["why"]): r["n"] for r in report.collect()}  # a row for each family and reason
        short = [f for f in families if reasons.get((f, None), 0) < pairs]
        if short:
            raise ValueError(f"too few valid pairs: {short}")
    for family in families:
        kind, ask, options = FAMILIES[family]["ask"]
        kept = drawn[family].where(F.col("why").isNull())
        if table:
            kept = kept.withColumn("rank", F.col("id"))
        elif all(why is None for f, why in reasons if f == family):
            kept = kept.withColumn("rank", F.col("id")).where(F.col("rank") < pairs)
        else:
            kept = numbered(kept, "id", name="rank").where(F.col("rank") < pairs)
        order = F.array_sort(F.array(*(F.struct(uniform(seed, f"{family}:order{i}", F.col("id")).alias("u"), F.lit(i).alias("i")) for i in range(3))))
        name = F.concat(F.lit(f"contrastive/{family}/{seed}-{family}-"), F.format_string("%04d", F.col("rank").cast("long")))
        sides = F.array(*(F.struct(F.lit(s).alias("sibling"), F.col(f"sentences_{s}").alias("sentences"), F.col(f"label_{s}").alias("gold")) for s in "ab"))
        told = kept.withColumn("order", order).select(name.alias("group_id"), "policy", "order", F.inline(sides))
        case = F.array_join(F.transform("order", lambda x: F.get("sentences", x["i"])), " ")
        keys = ["false", "true"] if kind == "noul" else [k for k, _ in options] if kind == "choice" else [str(i) for i in range(len(options))]
        said = [None, None] if kind == "noul" else [d for _, d in options] if kind == "choice" else options
        cases.append(told.select(F.concat("group_id", F.lit("/"), "sibling").alias("record_id"), "group_id", F.lit(family).alias("family"), "sibling", F.to_json(F.struct("policy", case.alias("case"))).alias("state"), F.lit(kind).alias("type"), F.lit(ask).alias("instructions"), F.array(*(F.lit(k) for k in keys)).alias("keys"), F.array(*(F.lit(d).cast("string") for d in said)).alias("descriptions"), "gold", F.lit(f"contrastive_{family}").alias("task")))
    return reduce(DataFrame.unionByName, cases), report


def _shuffled(u) -> dict[str, Column]:
    """Columns of the nouns and the people in a drawn order: computed once, as many atoms take from them."""
    drawn = lambda what, names: F.array_sort(F.array(*(F.struct(u(f"{what}{n}").alias("u"), F.lit(n).alias("n")) for n in names)))
    return {"nouns": drawn("noun", NOUNS), "people": drawn("person", PEOPLE)}


def _atoms(count: int, u) -> dict[str, Column]:
    """Columns of the drawn atoms, over those of _shuffled: kind, field names, threshold, candidate values and drawn values, as text."""
    out = {}
    for i in range(count):
        out[f"noun{i}"] = F.get("nouns", F.lit(i))["n"]
        out[f"kind{i}"] = pick(KINDS, u(f"kind{i}"))
        out[f"t{i}"] = whole(u(f"t{i}"), F.lit(5), F.lit(60))
        out[f"start{i}"] = F.make_date(F.lit(2027), whole(u(f"month{i}"), F.lit(1), F.lit(8)), whole(u(f"day{i}"), F.lit(1), F.lit(28)))
        out[f"people{i}"] = F.transform(F.slice("people", (i * 2) + 1 if i < 3 else 2, 3), lambda x: x["n"])
    return out


def _fields(i: int) -> Column:
    """Names and possible values of an atom's facts: array of (field, values)."""
    noun, kind, t = F.col(f"noun{i}"), F.col(f"kind{i}"), F.col(f"t{i}")
    field = lambda name, values: F.struct(F.concat(noun, F.lit(f" {name}")).alias("field"), values.alias("values"))
    near = F.array(*((t + k).cast("string") for k in (-1, 0, 1, 10, 11)))
    days = F.array(*(F.date_add(F.col(f"start{i}"), k).cast("string") for k in (F.greatest(F.lit(0), t - 1), t, t + 1, t + 10)))
    return (
        F.when(kind == "match", F.array(field("signer", F.col(f"people{i}")), field("designated approver", F.col(f"people{i}"))))
        .when(kind == "elapsed", F.array(field("start date", F.array(F.col(f"start{i}").cast("string"))), field("end date", days)))
        .when(kind == "flag", F.array(field("verified", F.array(F.lit("no"), F.lit("yes")))))
        .otherwise(F.array(field("value", near)))
    )


def _holds(i: int, first: Column, second: Column) -> Column:
    """Whether the atom holds for its facts' values, given as text."""
    kind, t = F.col(f"kind{i}"), F.col(f"t{i}")
    x = first.try_cast("int")
    tests = {k: pl.atom(k, x, t) for k in ("lt", "le", "gt", "ge", "eq", "range")}
    tests |= {"match": first == second, "elapsed": F.datediff(second.try_cast("date"), first.try_cast("date")) <= t, "flag": first == "yes"}
    return F.coalesce(*(F.when(kind == k, test) for k, test in tests.items()))


def _flipping(i: int, k: int):
    """Whether a value of the atom's fact k changes what holds of the drawn values."""

    def flips(x: Column) -> Column:
        both = (x, F.col(f"v{i}1")) if k == 0 else (F.col(f"v{i}0"), x)
        return _holds(i, *both) != F.col(f"a{i}")

    return flips


def _atom_words(i: int) -> Column:
    """The atom in words."""
    kind = F.col(f"kind{i}")
    fields = {"match": ("signer", "designated approver"), "elapsed": ("start date", "end date"), "flag": ("verified",)}
    numbers = {"t": F.col(f"t{i}"), "u": F.col(f"t{i}") + 10}
    named = lambda k: {str(n): F.concat(F.col(f"noun{i}"), F.lit(f" {field}")) for n, field in enumerate(fields.get(k, ("value",)))}
    return F.coalesce(*(F.when(kind == k, filled(words, numbers | named(k))) for k, words in pl.ATOM_WORDS.items()))


def _assignments(i: int) -> Column:
    """All values that an atom's facts can take together, as text, with whether the atom holds."""
    first, second = F.get(f"f{i}", F.lit(0))["values"], F.coalesce(F.get(f"f{i}", F.lit(1))["values"], F.array(F.lit(None).cast("string")))
    both = lambda x: F.transform(second, lambda y: F.struct(x.alias("first"), y.alias("second"), F.coalesce(_holds(i, x, y), F.lit(False)).alias("holds")))
    return F.flatten(F.transform(first, both))


def _nested(values: Sequence) -> Column:
    """Nested sequences of plain values as an array of arrays."""
    return F.array(*(F.lit(v) if isinstance(v, str | bool | int) else _nested(v) for v in values))


def _deciding_draw(rows: DataFrame, shapes: Sequence[str], width: int, u) -> DataFrame:
    """rows (number: of the shape) with drawn facts (v{i}0, v{i}1), what holds of each atom (a{i}), the label, and which atoms decide.

    Uniform among all assignments in which some atom decides: the shape's tree tells which combinations of true and false
    atoms have a deciding one; each is as likely as it has assignments, the product over the atoms of those that make it
    so. One is picked by that weight, then each atom's facts among its own: exact, without a rejected try.
    """
    trees = [pl.SHAPES[n] for n in shapes]
    known = [pl.deciding_vectors(t) for t in trees]
    of = lambda values: F.get(_nested(values), F.col("number"))
    rows = rows.withColumns({f"c{i}": _assignments(i) for i in range(width)})
    rows = rows.withColumns({f"yes{i}": F.filter(f"c{i}", lambda c: c["holds"]) for i in range(width)} | {f"no{i}": F.filter(f"c{i}", lambda c: ~c["holds"]) for i in range(width)})
    sizes = F.array(*(F.struct(F.size(f"yes{i}").cast("long").alias("yes"), F.size(f"no{i}").cast("long").alias("no")) for i in range(width)))
    rows = rows.withColumns({"sizes": sizes, "vectors": of([[list(truths) for truths, _ in v] for v in known])})
    chosen = lambda v: F.zip_with(v, F.slice("sizes", F.lit(1), F.size(v)), lambda t, n: F.when(t, n["yes"]).otherwise(n["no"]))
    rows = rows.withColumn("ways", F.transform("vectors", lambda v: F.aggregate(chosen(v), F.lit(1).cast("long"), lambda a, n: a * n)))
    rows = rows.withColumn("upto", F.transform(F.sequence(F.lit(1), F.size("ways")), lambda k: F.aggregate(F.slice("ways", F.lit(1), k), F.lit(0).cast("long"), lambda a, w: a + w)))
    rows = rows.withColumn("at", F.floor(u("facts") * F.element_at("upto", -1)))
    rows = rows.withColumn("vector", F.size(F.filter("upto", lambda c: c <= F.col("at"))))
    labels = [[pl.evaluated(t, truths) for truths, _ in v] for t, v in zip(trees, known, strict=True)]
    which = [[[i in d for i in range(width)] for _, d in v] for v in known]
    rows = rows.withColumns({"label": F.get(of(labels), F.col("vector")), "deciding": F.get(of(which), F.col("vector")), "truths": F.get("vectors", F.col("vector"))})
    rows = rows.withColumns({f"a{i}": F.get("truths", F.lit(i)) for i in range(width)})
    own = lambda i: F.when(F.col(f"a{i}"), F.col(f"yes{i}")).otherwise(F.col(f"no{i}"))
    rows = rows.withColumns({f"v{i}": F.get(own(i), F.floor(u(f"facts{i}") * F.size(own(i))).cast("int")) for i in range(width)})
    return rows.withColumns({f"v{i}{k}": F.col(f"v{i}")[name] for i in range(width) for k, name in enumerate(("first", "second"))})


def compositions(spark: SparkSession, groups: int | DataFrame, seed: int, shapes: Sequence[str] = tuple(pl.SHAPES), styles: Sequence[int] = (0, 1), apart: bool = False) -> DataFrame:
    """Four cases a group: a pair that differs in one deciding fact, and one that differs in the routing reference.

    groups: how many of each shape, or a table of ids, each of which gives a group of one shape, dealt by the id. A group's
    facts are drawn among all those that have a deciding fact: another of its possible values changes the label, and
    without it the label is unknown. Which one is changed is drawn too. certificate (JSON) has what the label follows from:
    the shape, its atoms, the facts in the order told and the fact that decides. All draws are columns of one projection, whatever the
    shapes, so a group is a row, and every group has its cases. apart: routing references begin with the group's own number, so
    that no two groups share a text; of the drawn ones alone there are 900, and among many groups of short rules some tell the same case.
    """
    counts = [max(pl.used_atoms(pl.SHAPES[n])) + 1 for n in shapes]
    width = max(counts)
    if isinstance(groups, int):
        rows = spark.range(groups).withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(len(shapes) - 1))))
    else:
        # A row is much work, of however few bytes: by a given number of parts, which adaptive execution doesn't merge.
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-groups.count() // PER_TASK))
        rows = groups.select("id").repartition(parts, "id").select("id", F.pmod("id", F.lit(len(shapes))).cast("int").alias("number"))
    rows = rows.withColumns({"family": F.get(_nested(list(shapes)), F.col("number")), "count": F.get(_nested(counts), F.col("number"))})
    u = lambda name: tx.uniform(F.concat_ws(":", F.lit(str(seed)), "family", F.lit(name), F.col("id").cast("string")))
    rows = rows.withColumns(_shuffled(u)).select("id", "number", "family", "count", *(c.alias(n) for n, c in _atoms(width, u).items()))
    rows = _deciding_draw(rows.withColumns({f"f{i}": _fields(i) for i in range(width)}), shapes, width, u)
    flips = lambda i, k: F.filter(F.coalesce(F.get(f"f{i}", F.lit(k))["values"], F.array().cast("array<string>")), _flipping(i, k))
    rows = rows.withColumns({f"flips{i}{k}": F.when(F.get("deciding", F.lit(i)), flips(i, k)) for i in range(width) for k in (0, 1)})
    edits, facts = [], []
    for i in range(width):
        for k in (0, 1):
            field = F.get(f"f{i}", F.lit(k))
            own = F.struct(u(f"edit{i}.{k}").alias("u"), field["field"].alias("field"), F.get(f"flips{i}{k}", F.lit(0)).alias("value"))
            edits.append(F.when(F.size(f"flips{i}{k}") > 0, own))
            facts.append(F.when((F.lit(i) < F.col("count")) & field.isNotNull(), F.struct(field["field"].alias("field"), F.col(f"v{i}{k}").alias("value"))))
    low, high = whole(u("routing low"), F.lit(100), F.lit(500)), whole(u("routing high"), F.lit(501), F.lit(999))
    other = u("routing") < 0.5
    number = F.col("id") if isinstance(groups, DataFrame) else F.col("id") * len(shapes) + F.col("number")
    reference = lambda drawn: F.concat_ws("-", number.cast("string"), drawn.cast("string")) if apart else drawn.cast("string")
    routing = F.struct(F.lit("routing reference").alias("field"), reference(F.when(other, low).otherwise(high)).alias("value"))
    drawn = {"facts": F.filter(F.array(*facts, routing), lambda x: x.isNotNull()), "moved": reference(F.when(other, high).otherwise(low)), "edit": F.get(F.array_sort(F.filter(F.array(*edits), lambda e: e.isNotNull())), F.lit(0))}
    said = [[WRAPPERS[s].replace("{rule}", pl.rule_text(pl.SHAPES[n], [f"{{{i}}}" for i in range(4)], s)) for s in styles] for n in shapes]
    policy = F.get(F.get(_nested(said), F.col("number")), F.floor(u("style") * len(styles)).cast("int"))
    for i in range(width):
        policy = F.replace(policy, F.lit(f"{{{i}}}"), F.coalesce(_atom_words(i), F.lit("")))
    atoms = F.array(*(F.when(F.lit(i) < F.col("count"), F.struct(F.col(f"kind{i}").alias("kind"), F.transform(f"f{i}", lambda x: x["field"]).alias("fields"), F.col(f"t{i}").alias("threshold"))) for i in range(width)))
    style = F.get(F.array(*(F.lit(s) for s in styles)), F.floor(u("style") * len(styles)).cast("int"))
    every = rows.withColumns(drawn).select("family", "id", policy.alias("policy"), "facts", "edit", "label", "moved", (u("keys") < 0.5).alias("turned"), F.filter(atoms, lambda a: a.isNotNull()).alias("atoms"), style.alias("render_style"))
    ordered = F.transform(F.array_sort(F.transform("facts", lambda x: F.struct(F.sha2(F.concat_ws(":", F.lit(str(seed)), "family", F.col("id").cast("string"), x["field"]), 256).alias("h"), x.alias("x")))), lambda x: x["x"])
    edited = lambda field, value: F.transform("facts", lambda x: F.struct(x["field"].alias("field"), F.when(x["field"] == field, value).otherwise(x["value"]).alias("value")))
    every = every.withColumn("facts", ordered)
    kinds = (("relevant", "a", F.col("facts"), F.col("label")), ("relevant", "b", edited(F.col("edit.field"), F.col("edit.value")), ~F.col("label")), ("irrelevant", "a", F.col("facts"), F.col("label")), ("irrelevant", "b", edited(F.lit("routing reference"), F.col("moved")), F.col("label")))
    cases = every.select("family", "policy", "turned", "atoms", "render_style", F.col("edit.field").alias("deciding_field"), F.concat(F.lit(f"composition/{seed}/"), "family", F.lit("/"), F.col("id").cast("string")).alias("group_id"), F.inline(F.array(*(F.struct(F.lit(k).alias("pair_kind"), F.lit(s).alias("sibling"), f.alias("facts"), y.alias("holds")) for k, s, f, y in kinds))))
    certificate = F.to_json(F.struct(F.col("family").alias("shape"), "atoms", "facts", "deciding_field", F.col("holds").alias("label")))
    case = F.array_join(F.transform("facts", lambda x: F.concat(F.lit("The "), x["field"], F.lit(" is "), x["value"], F.lit("."))), " ")
    keys = F.when(F.col("turned"), F.array(F.lit("reject"), F.lit("accept"))).otherwise(F.array(F.lit("accept"), F.lit("reject")))
    said = F.when(F.col("turned"), F.array(F.lit(CRITERIA["reject"]), F.lit(CRITERIA["accept"]))).otherwise(F.array(F.lit(CRITERIA["accept"]), F.lit(CRITERIA["reject"])))
    return cases.select(F.concat_ws("/", "group_id", "pair_kind", "sibling").alias("record_id"), "group_id", "family", "pair_kind", "sibling", "deciding_field", F.to_json(F.struct("policy", case.alias("case"))).alias("state"), F.lit("choice").alias("type"), F.lit("Apply the policy to this case.").alias("instructions"), keys.alias("keys"), said.alias("descriptions"), F.when(F.col("holds"), "accept").otherwise("reject").alias("gold"), F.concat(F.lit("composition_"), "family").alias("task"), "render_style", certificate.alias("certificate"))
