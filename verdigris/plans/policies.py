"""Queries over policies: families on the order tables, rule trees, texts and contrastive pairs."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import policy as pl
from verdigris.operators import cases
from verdigris.session import table

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _family(name: str, rows: DataFrame, key: str, **facts: Column) -> DataFrame:
    return rows.select(key, pl.FAMILIES[name](facts).alias("label"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice <= 100000 THEN 'auto_approved' WHEN o_totalprice IS NOT NULL THEN 'director_signoff' END AS label FROM orders")
def policy_spend_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _family("spend_threshold", table(spark, sf_dir, "orders"), "o_orderkey", amount=F.col("o_totalprice"), limit=F.lit(100000))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey % 7 = o_orderkey % 7 END AS label FROM orders")
def policy_authorization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signer is unknown for every third order, which leaves the label undetermined."""
    signer = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey") % 7)
    return _family("authorization", table(spark, sf_dir, "orders"), "o_orderkey", signer=signer, approver=F.col("o_orderkey") % 7)


@query("SELECT c_custkey, c_custkey % 60 >= 18 AS label FROM customer")
def policy_age_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _family("age_eligibility", table(spark, sf_dir, "customer"), "c_custkey", age=F.col("c_custkey") % 60, minimum=F.lit(18))


def _lines() -> str:
    return "l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CAST(l_shipdate AS DATE) AS ship, CAST(o_orderdate AS DATE) AS ordered FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with the dates of shipping and ordering; narrow columns on both sides of the join."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.to_date("l_shipdate").alias("ship"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("ordered"))
    return lines.join(orders, "l_orderkey")


def _counted(rows: DataFrame, name: str, **facts: Column) -> DataFrame:
    """Labels of lines, counted by line number: lines have no key of their own."""
    labelled = rows.select("l_linenumber", pl.FAMILIES[name](facts).cast("string").alias("label"))
    return labelled.groupBy("l_linenumber", "label").agg(F.count("*").alias("lines"))


def _counted_sql(label: str) -> str:
    return f"WITH {_lines()} SELECT l_linenumber, CAST({label} AS VARCHAR) AS label, count(*) AS lines FROM l GROUP BY 1, 2"


def _tier_sql(x: str, first: str, second: str, op: str = "<=") -> str:
    return f"CASE WHEN {x} {op} {first} THEN 0 WHEN {x} {op} {second} THEN 1 WHEN {x} IS NOT NULL THEN 2 END"


_DAYS = "date_diff('day', ordered, ship)"


@query(_counted_sql(_tier_sql("l_quantity", "10", "40", "<")))
def policy_volume_discount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(_dated(spark, sf_dir), "volume_discount", units=F.col("l_quantity"), t1=10, t2=40)


@query(_counted_sql("CASE WHEN l_quantity <= 10 THEN 'within_limit' WHEN l_quantity <= 20 THEN 'slightly_over' WHEN l_quantity IS NOT NULL THEN 'far_over' END"))
def policy_quantity_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(_dated(spark, sf_dir), "quantity_limit", qty=F.col("l_quantity"), limit=F.lit(10))


@query(_counted_sql(_tier_sql(_DAYS, "30", "90")))
def policy_shipping_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(_dated(spark, sf_dir), "shipping_delay", delivered=F.col("ship"), promised=F.col("ordered"), minor=30, major=90)


@query(_counted_sql(f"{_DAYS} <= 60"))
def policy_return_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(_dated(spark, sf_dir), "return_window", request=F.col("ship"), purchase=F.col("ordered"), window=F.lit(60))


@query(_counted_sql(_tier_sql(_DAYS, "0", "45")))
def policy_deadline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(_dated(spark, sf_dir), "deadline", received=F.col("ship"), due=F.col("ordered"), grace=45)


@query(_counted_sql(_tier_sql(_DAYS, "90", "365")))
def policy_warranty_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(_dated(spark, sf_dir), "warranty_claim", claim=F.col("ship"), purchase=F.col("ordered"), standard=90, extended=365)


@query(_counted_sql(_tier_sql("l_partkey % 60", "4", "24")))
def policy_sla_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(_dated(spark, sf_dir), "sla_response", hours=F.col("l_partkey") % 60, target=4, breach=24)


@query(_counted_sql(_tier_sql("l_partkey % 90", "10", "60")))
def policy_late_fee(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(_dated(spark, sf_dir), "late_fee", days_late=F.col("l_partkey") % 90, grace=10, cap=60)


def _truth_sql(i: int) -> str:
    return f"CASE (o_orderkey // {3**i}) % 3 WHEN 0 THEN true WHEN 1 THEN false END"


def _rule_sql(tree: object) -> str:
    """The tree in SQL's own words, beside the compiler that the query uses."""
    if isinstance(tree, int):
        return f"a{tree}"
    v = [_rule_sql(t) for t in tree[1:]]
    if tree[0] == "if":
        return f"(CASE WHEN {v[0]} THEN {v[1]} WHEN NOT {v[0]} THEN {v[2]} WHEN {v[1]} IS NOT DISTINCT FROM {v[2]} THEN {v[1]} END)"
    return {"not": "(NOT {0})", "and": "({0} AND {1})", "or": "({0} OR {1})", "unless": "({0} AND NOT {1})"}[tree[0]].format(*v)


@query(
    f"WITH t AS (SELECT o_orderkey, {', '.join(f'{_truth_sql(i)} AS a{i}' for i in range(4))} FROM orders) "
    + " UNION ALL ".join(f"SELECT '{n}' AS shape, CAST({_rule_sql(t)} AS VARCHAR) AS value, count(*) AS rows FROM t GROUP BY 2" for n, t in pl.SHAPES.items())
)
def policy_kleene_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All shapes over true, false and unknown atoms: counts of what they come to. One scan."""
    def truth(i: int) -> Column:
        digit = F.expr(f"(o_orderkey div {3**i}) % 3")
        return F.when(digit == 0, True).when(digit == 1, False)

    rows = table(spark, sf_dir, "orders").select(*(truth(i).alias(f"a{i}") for i in range(4)))
    atoms = [F.col(f"a{i}") for i in range(4)]
    shapes = F.array(*(F.struct(F.lit(n).alias("shape"), pl.compiled(t, atoms).cast("string").alias("value")) for n, t in pl.SHAPES.items()))
    return rows.select(F.inline(shapes)).groupBy("shape", "value").agg(F.count("*").alias("rows"))


#: The surface forms once more, written in SQL: operand numbers stand for the operands' texts.
_SQL_FORMS = {
    0: {"not": "'NOT (' || 0 || ')'", "and": "'(' || 0 || ') AND (' || 1 || ')'", "or": "'(' || 0 || ') OR (' || 1 || ')'", "unless": "'(' || 0 || ') holds and the exception (' || 1 || ') does not hold'", "if": "'if (' || 0 || '), use (' || 1 || '); otherwise use (' || 2 || ')'"},
    1: {"not": "'it is not the case that (' || 0 || ')'", "and": "'both these conditions hold: [(' || 0 || '); (' || 1 || ')]'", "or": "'at least one of these conditions hold: [(' || 0 || '); (' || 1 || ')]'", "unless": "'(' || 0 || ') holds and the exception (' || 1 || ') does not hold'", "if": "'if (' || 0 || '), use (' || 1 || '); otherwise use (' || 2 || ')'"},
    3: {"not": "'the condition \"' || 0 || '\" fails'", "and": "0 || ', and also ' || 1", "or": "'either ' || 0 || ', or else ' || 1", "unless": "0 || ', except when ' || 1", "if": "'when ' || 0 || ' the requirement is that ' || 1 || ', and when it is not the requirement is that ' || 2"},
    4: {"not": "'[NOT: ' || 0 || ']'", "and": "'[ALL of: ' || 0 || ' | ' || 1 || ']'", "or": "'[ANY of: ' || 0 || ' | ' || 1 || ']'", "unless": "'[' || 0 || ' UNLESS ' || 1 || ']'", "if": "'[IF ' || 0 || ' THEN ' || 1 || ' ELSE ' || 2 || ']'"},
}


def _words_sql(tree: object, style: int) -> str:
    if isinstance(tree, int):
        return f"w{tree}"
    form = _SQL_FORMS[{2: 1}.get(style, style)][tree[0]]
    for n, operand in enumerate(tree[1:]):
        form = re.sub(rf"(^|\|\| ){n}( \|\||$)", lambda m, x=operand: f"{m[1]}({_words_sql(x, style)}){m[2]}", form)
    return form


@query(
    """WITH w AS (SELECT o_orderkey, o_orderkey % 14 AS shape, (o_orderkey // 14) % 5 AS style, 'amount is at most ' || (o_custkey % 50) AS w0, 'age is between ' || (o_custkey % 40) || ' and ' || (o_custkey % 40 + 10) || ', including both endpoints' AS w1, 'signer is the same person as owner' AS w2, 'vip is yes' AS w3 FROM orders)
    SELECT o_orderkey, CASE """
    + " ".join(f"WHEN shape = {k} AND style = {s} THEN {_words_sql(t, s)}" for k, t in enumerate(pl.SHAPES.values()) for s in range(5))
    + " END AS rule FROM w"
)
def policy_rule_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for each order, over atoms with its numbers, in one of all shapes and styles."""
    amount, age = F.col("o_custkey") % 50, F.col("o_custkey") % 40
    atoms = [("le", "amount", "{amount}", None), ("range", "age", "{low}", "{high}"), ("match", "signer", None, None), ("flag", "vip", None, None)]
    words = [pl.ATOM_WORDS[kind].format(field, "owner", t=t, u=u) for kind, field, t, u in atoms]
    columns = {"amount": amount, "low": age, "high": age + 10}
    shape, style = F.col("o_orderkey") % len(pl.SHAPES), F.expr(f"o_orderkey div {len(pl.SHAPES)}") % 5
    texts = {(k, s): cases.filled(pl.rule_text(t, words, s), columns) for k, t in enumerate(pl.SHAPES.values()) for s in range(5)}
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(*(F.when((shape == k) & (style == s), x) for (k, s), x in texts.items())).alias("rule"))


@query(
    """WITH p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice <= 150000 END AS la, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice <= 250000 AND o_orderkey % 2 = 0 END AS lb, 1 + (o_orderkey % 5 = 0)::INT AS d, o_orderkey % 17 <> 0 AS same, o_orderkey % 19 = 0 AS abl, o_orderkey % 23 = 0 AS inv, o_orderkey % 29 AS ev FROM orders)
    SELECT CASE WHEN la IS NULL OR lb IS NULL THEN 'label_undetermined' WHEN la = lb THEN 'labels_equal' WHEN d <> 1 OR NOT same THEN 'not_exactly_one_sentence_differs' WHEN abl THEN 'ablation_failed' WHEN inv THEN 'invariance_failed' WHEN ev < 1 THEN 'no_evidence_sentence' ELSE 'accepted' END AS reason, count(*) AS pairs FROM p GROUP BY 1"""
)
def policy_pair_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    la = F.when(k % 11 != 0, F.col("o_totalprice") <= 150000)
    lb = F.when(k % 13 != 0, (F.col("o_totalprice") <= 250000) & (k % 2 == 0))
    reason = pl.pair_problem(la, lb, F.lit(1) + (k % 5 == 0).cast("int"), k % 17 != 0, k % 19 == 0, k % 23 == 0, k % 29)
    return table(spark, sf_dir, "orders").select(F.coalesce(reason, F.lit("accepted")).alias("reason")).groupBy("reason").agg(F.count("*").alias("pairs"))


def _order_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))


def _drawn(name: str) -> str:
    """A uniform number of a group by the name of the draw, in SQL."""
    return f"(CAST('0x' || substr(sha256('42:' || family || ':{name}:' || id), 1, 13) AS BIGINT) / {float(1 << 52)})"


def _by_draw(prefix: str, names: str) -> str:
    parts = ", ".join(f"{{'u': {_drawn(prefix + n)}, 'n': '{n}'}}" for n in names.split())
    return f"list_transform(list_sort([{parts}]), lambda x: x.n)"


def _holds_sql(x: str, y: str) -> str:
    """Whether an atom (kind, t) holds of two values given as text."""
    n = f"TRY_CAST({x} AS INTEGER)"
    return f"""(CASE kind WHEN 'lt' THEN {n} < t WHEN 'le' THEN {n} <= t WHEN 'gt' THEN {n} > t WHEN 'ge' THEN {n} >= t WHEN 'eq' THEN {n} = t WHEN 'range' THEN {n} BETWEEN t AND t + 10
      WHEN 'match' THEN {x} = {y} WHEN 'elapsed' THEN date_diff('day', TRY_CAST({x} AS DATE), TRY_CAST({y} AS DATE)) <= t ELSE {x} = 'yes' END)"""


def _vectors_sql(number: int, tree: object) -> str:
    """The truth vectors of a shape with what SQL says of them: the label, and for each atom whether it decides."""
    n = max(pl.used_atoms(tree)) + 1
    rule = f"CAST({_rule_sql(tree)} AS BOOLEAN)"
    decides = lambda i: f"({rule} <> {re.sub(rf'a{i}(?![0-9])', f'(NOT a{i})', rule)}) AND ({re.sub(rf'a{i}(?![0-9])', 'CAST(NULL AS BOOLEAN)', rule)}) IS NULL"
    which = ", ".join(decides(i) if i < n else "false" for i in range(4))
    fixed = " AND ".join(["true", *(f"a{i}" for i in range(n, 4))])
    return f"SELECT {number} AS number, {n} AS atoms, a0, a1, a2, a3, {rule} AS label, [{which}] AS deciding FROM bits WHERE {fixed}"


_SAID = """CASE kind WHEN 'lt' THEN noun || ' value is less than ' || t WHEN 'le' THEN noun || ' value is at most ' || t WHEN 'gt' THEN noun || ' value is greater than ' || t WHEN 'ge' THEN noun || ' value is at least ' || t WHEN 'eq' THEN noun || ' value is equal to ' || t
      WHEN 'range' THEN noun || ' value is between ' || t || ' and ' || (t + 10) || ', including both endpoints' WHEN 'match' THEN noun || ' signer is the same person as ' || noun || ' designated approver'
      WHEN 'elapsed' THEN 'the elapsed days from ' || noun || ' start date to ' || noun || ' end date are at most ' || t ELSE noun || ' verified is yes' END"""
_WRAPPED = """CASE style WHEN 2 THEN 'Approval requires the following rule to be true: ' || rule || '. A false rule means denial. Routing references are irrelevant.'
      WHEN 3 THEN 'A case is approved when ' || rule || '; any other case is denied. Routing references play no part in the decision.' WHEN 4 THEN 'DECISION RULE ' || rule || ' -> approve; otherwise reject. Ignore the routing reference.'
      ELSE 'Approve exactly when ' || rule || '. Otherwise deny. The routing reference does not affect eligibility.' END"""
_KINDS = "lt le gt ge eq range match elapsed flag".split()
_COMPOSED = f"""WITH bits AS (SELECT k // 8 % 2 = 0 AS a0, k // 4 % 2 = 0 AS a1, k // 2 % 2 = 0 AS a2, k % 2 = 0 AS a3 FROM range(16) AS r(k)),
    vec0 AS ({" UNION ALL ".join(_vectors_sql(k, t) for k, t in enumerate(pl.SHAPES.values()))}),
    vec AS (SELECT *, row_number() OVER (PARTITION BY number ORDER BY a0 DESC, a1 DESC, a2 DESC, a3 DESC) AS k FROM vec0 WHERE list_contains(deciding, true)),
    g AS (SELECT o_orderkey AS id, o_orderkey % 14 AS number, ({list(pl.SHAPES)})[1 + o_orderkey % 14] AS family FROM orders),
    h AS (SELECT *, {_by_draw("noun", "request account package review member shipment entry case")} AS nouns, {_by_draw("person", "Mira Noah Aiko Ravi Sana Elin Tomas Kofi")} AS people FROM g),
    a0 AS ({" UNION ALL ".join(f"SELECT id, family, number, {i} AS i, nouns[{i + 1}] AS noun, people[{2 * i + 1 if i < 3 else 2}:{2 * i + 3 if i < 3 else 4}] AS people, ({_KINDS})[1 + CAST(floor({_drawn(f'kind{i}')} * 9) AS INTEGER)] AS kind, 5 + CAST(floor({_drawn(f't{i}')} * 56) AS INTEGER) AS t, make_date(2027, 1 + CAST(floor({_drawn(f'month{i}')} * 8) AS BIGINT), 1 + CAST(floor({_drawn(f'day{i}')} * 28) AS BIGINT)) AS start, {_drawn(f'facts{i}')} AS uf, {_drawn(f'edit{i}.0')} AS ue0, {_drawn(f'edit{i}.1')} AS ue1 FROM h" for i in range(4))}),
    a1 AS (SELECT *, CASE kind WHEN 'match' THEN people WHEN 'elapsed' THEN [CAST(start AS VARCHAR)] WHEN 'flag' THEN ['no', 'yes'] ELSE list_transform([t - 1, t, t + 1, t + 10, t + 11], lambda x: CAST(x AS VARCHAR)) END AS v0,
      CASE kind WHEN 'match' THEN people WHEN 'elapsed' THEN list_transform([greatest(0, t - 1), t, t + 1, t + 10], lambda x: CAST(CAST(start + to_days(CAST(x AS INTEGER)) AS DATE) AS VARCHAR)) ELSE [CAST(NULL AS VARCHAR)] END AS v1,
      noun || CASE kind WHEN 'match' THEN ' signer' WHEN 'elapsed' THEN ' start date' WHEN 'flag' THEN ' verified' ELSE ' value' END AS n0, CASE kind WHEN 'match' THEN noun || ' designated approver' WHEN 'elapsed' THEN noun || ' end date' END AS n1, {_SAID} AS said FROM a0),
    a2 AS (SELECT *, flatten(list_transform(v0, lambda x: list_transform(v1, lambda y: {{'x': x, 'y': y}}))) AS every FROM a1),
    a3 AS (SELECT *, list_filter(every, lambda z: coalesce({_holds_sql("z.x", "z.y")}, false)) AS yes, list_filter(every, lambda z: NOT coalesce({_holds_sql("z.x", "z.y")}, false)) AS no FROM a2),
    w AS (SELECT id, list(len(yes) ORDER BY i) AS ny, list(len(no) ORDER BY i) AS nn, list(said ORDER BY i) AS said FROM a3 GROUP BY id),
    c0 AS (SELECT g.id, g.family, g.number, v.*, w.said, list_product([CASE WHEN j < v.atoms THEN CASE WHEN [v.a0, v.a1, v.a2, v.a3][j + 1] THEN ny[j + 1] ELSE nn[j + 1] END ELSE 1 END FOR j IN [0, 1, 2, 3]]) AS ways FROM g JOIN vec v USING (number) JOIN w USING (id)),
    c1 AS (SELECT *, sum(ways) OVER (PARTITION BY id ORDER BY k) AS upto, sum(ways) OVER (PARTITION BY id) AS total FROM c0),
    c AS (SELECT * FROM c1 WHERE upto > floor({_drawn("facts")} * total) AND upto - ways <= floor({_drawn("facts")} * total)),
    f0 AS (SELECT a.*, c.atoms, c.deciding[a.i + 1] AS decides, [c.a0, c.a1, c.a2, c.a3][a.i + 1] AS truth, CASE WHEN [c.a0, c.a1, c.a2, c.a3][a.i + 1] THEN yes ELSE no END AS own FROM a3 a JOIN c USING (id) WHERE a.i < c.atoms),
    f1 AS (SELECT *, own[1 + CAST(floor(uf * len(own)) AS INTEGER)] AS v FROM f0),
    f2 AS (SELECT *, list_filter(v0, lambda x: {_holds_sql("x", "v.y")} <> truth) AS e0, CASE WHEN n1 IS NULL THEN [] ELSE list_filter(v1, lambda y: {_holds_sql("v.x", "y")} <> truth) END AS e1 FROM f1),
    e AS (SELECT id, min({{'u': u, 'field': field, 'value': value}}) AS edit FROM (SELECT id, ue0 AS u, n0 AS field, e0[1] AS value FROM f2 WHERE decides AND len(e0) > 0 UNION ALL SELECT id, ue1, n1, e1[1] FROM f2 WHERE decides AND len(e1) > 0) GROUP BY id),
    q AS (SELECT *, {_drawn("routing")} < 0.5 AS other, CAST(100 + CAST(floor({_drawn("routing low")} * 401) AS INTEGER) AS VARCHAR) AS low, CAST(501 + CAST(floor({_drawn("routing high")} * 499) AS INTEGER) AS VARCHAR) AS high, CAST(floor({_drawn("style")} * 5) AS INTEGER) AS style, {_drawn("keys")} < 0.5 AS turned,
      said[1] AS w0, said[2] AS w1, said[3] AS w2, said[4] AS w3 FROM c),
    facts AS (SELECT id, n0 AS field, v.x AS value FROM f2 UNION ALL SELECT id, n1, v.y FROM f2 WHERE n1 IS NOT NULL UNION ALL SELECT id, 'routing reference', CASE WHEN other THEN low ELSE high END FROM q),
    p AS (SELECT *, CASE {" ".join(f"WHEN number = {k} AND style = {s} THEN {_words_sql(t, s)}" for k, t in enumerate(pl.SHAPES.values()) for s in range(5))} END AS rule FROM q),
    s AS (SELECT * FROM (VALUES ('relevant', 'a'), ('relevant', 'b'), ('irrelevant', 'a'), ('irrelevant', 'b')) AS x(pair_kind, sibling)),
    t AS (SELECT p.id, s.pair_kind, s.sibling, string_agg('The ' || facts.field || ' is ' || CASE WHEN s.pair_kind = 'relevant' AND s.sibling = 'b' AND facts.field = e.edit.field THEN e.edit.value WHEN s.pair_kind = 'irrelevant' AND s.sibling = 'b' AND facts.field = 'routing reference' THEN CASE WHEN other THEN high ELSE low END ELSE facts.value END || '.', ' ' ORDER BY sha256('42:' || p.family || ':' || p.id || ':' || facts.field)) AS case_text
      FROM p JOIN facts USING (id) JOIN e USING (id) CROSS JOIN s GROUP BY ALL)
    SELECT 'composition/42/' || p.family || '/' || p.id || '/' || t.pair_kind || '/' || t.sibling AS record_id, e.edit.field AS deciding_field, CASE WHEN label = (t.pair_kind = 'irrelevant' OR t.sibling = 'a') THEN 'accept' ELSE 'reject' END AS gold,
      CASE WHEN turned THEN 'reject,accept' ELSE 'accept,reject' END AS keys, {_WRAPPED} AS policy, t.case_text FROM t JOIN p USING (id) JOIN e USING (id)"""


@query(_COMPOSED)
def policy_composition_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composed cases, four an order, of all shapes in all styles: pairs that differ in a deciding fact, and in none that counts."""
    rows = cases.compositions(spark, _order_ids(spark, sf_dir), 42, styles=(0, 1, 2, 3, 4))
    state = F.from_json("state", "policy string, case string")
    return rows.select("record_id", "deciding_field", "gold", F.array_join("keys", ",").alias("keys"), state["policy"].alias("policy"), state["case"].alias("case_text"))


#: The labels of the families once more, in SQL over the value v that the two cases differ in.
_PAIR_LABELS = {
    "return_window": "v <= \"window\"", "spend_threshold": "CASE WHEN v <= \"limit\" THEN 'auto_approved' ELSE 'director_signoff' END", "authorization": "signer = approver", "age_eligibility": "v >= minimum",
    "quantity_limit": "CASE WHEN v <= \"limit\" THEN 'within_limit' WHEN v <= 2 * \"limit\" THEN 'slightly_over' ELSE 'far_over' END", "deadline": _tier_sql("v", "0", "grace"), "warranty_claim": _tier_sql("v", "standard", "extended"),
    "sla_response": _tier_sql("v", "target", "breach"), "late_fee": _tier_sql("v", "grace", "cap"), "volume_discount": _tier_sql("v", "t1", "t2", "<"), "shipping_delay": _tier_sql("v", "minor", "major"),
}


def _pair_sql(number: int, family: str) -> str:
    """Both cases of the pairs of one family, from its fixed values: draws, texts and labels in SQL."""
    own, count = cases.FAMILIES[family], len(cases.FAMILIES[family]["levels"])
    u = lambda name: f"(CAST('0x' || substr(sha256('42:{family}:{name}:' || id), 1, 13) AS BIGINT) / {float(1 << 52)})"
    literal = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    quoted = lambda x: re.sub(r"\b(limit|window)\b", r'"\1"', x.replace(" div ", " // "))

    def text(template: str) -> str:
        parts = []
        for words, name, form, _ in string.Formatter().parse(template):
            if words:
                parts.append(literal(words))
            if name is not None:
                x = quoted(name)
                parts.append(f"monthname({x}) || ' ' || day({x}) || ', ' || year({x})" if form == "day" else f"format('{{:,}}', {x})" if form == "," else f"CAST({x} AS VARCHAR)")
        return " || ".join(parts)

    drawn = []
    for names, values in own["choose"].items():
        several = names.split(",")
        for k, c in enumerate(several):
            drawn.append(f"([{', '.join(literal(v[k] if len(several) > 1 else v) for v in values)}])[1 + CAST(floor({u(names)} * {len(values)}) AS INTEGER)] AS {quoted(c)}")
    if "day" in own:
        start, first, last, _ = own["day"]
        drawn.append(f"make_date(2026, CAST({first} + floor({u('month')} * {last - first + 1}) AS BIGINT), CAST(1 + floor({u('day')} * 28) AS BIGINT)) AS {start}")
    one = "0" if own.get("first") else f"CAST(floor({u('level')} * {count}) AS INTEGER)"
    bound = lambda k: f"CASE level {' '.join(f'WHEN {n} THEN {quoted(b[k])}' for n, b in enumerate(own['levels']))} END"
    fact = f"CAST({own['day'][0]} + to_days(CAST(v AS INTEGER)) AS DATE) AS {own['day'][3]}" if "day" in own else f"([{', '.join(map(literal, cases.NAMES))}])[1 + (list_position([{', '.join(map(literal, cases.NAMES))}], approver) - 1 + v) % 12] AS signer" if family == "authorization" else f"v AS {own['value']}"
    order = ", ".join(f"{{'u': {u(f'order{i}')}, 'i': {i + 1}}}" for i in range(3))
    told = ", ".join(text(t) for t, _ in own["sentences"])
    kind, _, options = own["ask"]
    keys = "false,true" if kind == "noul" else ",".join(k for k, _ in options) if kind == "choice" else ",".join(map(str, range(len(options))))
    return f"""SELECT 'contrastive/{family}/42-{family}-' || CASE WHEN id < 1000 THEN lpad(CAST(id AS VARCHAR), 4, '0') ELSE CAST(id AS VARCHAR) END || '/' || sibling AS record_id, '{kind}' AS type, '{keys}' AS keys, CAST({_PAIR_LABELS[family]} AS VARCHAR) AS gold, {text(own["policy"])} AS policy,
      array_to_string(list_transform(list_sort([{order}]), lambda x: ([{told}])[x.i]), ' ') AS case_text
      FROM (SELECT *, {fact} FROM (SELECT *, low + CAST(floor(uv * (high - low + 1)) AS INTEGER) AS v FROM (SELECT *, {bound(0)} AS low, {bound(1)} AS high FROM (
        SELECT *, unnest(['a', 'b']) AS sibling, unnest([{one}, ({one} + 1 + CAST(floor({u("other")} * {count - 1}) AS INTEGER)) % {count}]) AS level, unnest([{u("value_a")}, {u("value_b")}]) AS uv
        FROM (SELECT id, {", ".join(drawn)} FROM (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % {len(cases.FAMILIES)} = {number}))))))"""


@query(" UNION ALL ".join(_pair_sql(k, family) for k, family in enumerate(cases.FAMILIES)))
def contrastive_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checked contrastive pairs, one an order, of all eleven families, with their texts."""
    rows = cases.contrastive(spark, _order_ids(spark, sf_dir), 42)[0]
    state = F.from_json("state", "policy string, case string")
    return rows.select("record_id", "type", F.array_join("keys", ",").alias("keys"), "gold", state["policy"].alias("policy"), state["case"].alias("case_text"))


def _u(name: str) -> str:
    return f"(CAST('0x' || substr(sha256('42:late_fee:{name}:' || id), 1, 13) AS BIGINT) / {float(1 << 52)})"


def _chosen(values: str, name: str) -> str:
    return f"({values})[1 + CAST(floor({_u(name)} * len({values})) AS INTEGER)]"


@query(
    f"""WITH d AS (SELECT id, {_chosen("[5, 10, 15]", "grace,cap")} AS grace, {_chosen("[30, 60, 45]", "grace,cap")} AS cap,
      {_chosen("['Mira','Noah','Priya','Tomas','Aiko','Lena','Omar','Sana','Jonas','Ravi','Elin','Kofi']", "name")} AS name,
      {_chosen("[120, 450, 980, 2300]", "amount")} AS amount, {_chosen("['bank transfer','card','cheque']", "method")} AS method,
      CAST(floor({_u("level")} * 3) AS INTEGER) AS one, CAST(floor({_u("other")} * 2) AS INTEGER) AS step, {_u("value_a")} AS ua, {_u("value_b")} AS ub,
      [{_u("order0")}, {_u("order1")}, {_u("order2")}] AS o FROM (SELECT o_orderkey AS id FROM orders)),
    s AS (SELECT *, 'a' AS sibling, one AS level, ua AS u FROM d UNION ALL SELECT *, 'b', (one + 1 + step) % 3, ub FROM d),
    v AS (SELECT *, CASE level WHEN 0 THEN 0 WHEN 1 THEN grace + 1 ELSE cap + 1 END AS low, CASE level WHEN 0 THEN grace WHEN 1 THEN cap ELSE cap + 60 END AS high FROM s),
    w AS (SELECT *, low + CAST(floor(u * (high - low + 1)) AS INTEGER) AS days FROM v),
    t AS (SELECT *, [name || chr(39) || 's invoice for $' || format('{{:,}}', amount) || ' fell due last quarter.', 'Payment was received ' || days || ' days after the due date.', 'The payment was made by ' || method || '.'] AS told FROM w)
    SELECT 'contrastive/late_fee/42-late_fee-' || CASE WHEN id < 1000 THEN lpad(id::VARCHAR, 4, '0') ELSE id::VARCHAR END || '/' || sibling AS record_id, CAST(level AS VARCHAR) AS gold,
      'Invoices paid within ' || grace || ' days after the due date incur no fee. Payments between ' || (grace + 1) || ' and ' || cap || ' days late incur a 2% fee. Payments later than ' || cap || ' days incur a 10% fee and a hold on the account.' AS policy,
      array_to_string(list_transform(list_sort([{{'u': o[1], 'i': 1}}, {{'u': o[2], 'i': 2}}, {{'u': o[3], 'i': 3}}]), lambda x: told[x.i]), ' ') AS case_text FROM t"""
)
def contrastive_late_fee(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One family's pairs with texts and gold levels, whose draws SQL can repeat."""
    rows = cases.contrastive(spark, _order_ids(spark, sf_dir), 42, ("late_fee",))[0]
    state = F.from_json("state", "policy string, case string")
    return rows.select("record_id", "gold", state["policy"].alias("policy"), state["case"].alias("case_text"))


@query("SELECT o_orderkey, monthname(o_orderdate) || ' ' || day(o_orderdate) || ', ' || year(o_orderdate) AS day, '$' || format('{:,}', CAST(round(o_totalprice) AS BIGINT)) AS total FROM orders")
def fact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", pl.day_text(F.col("o_orderdate")).alias("day"), pl.dollars(F.round("o_totalprice").cast("long")).alias("total"))

