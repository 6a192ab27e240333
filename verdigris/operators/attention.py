"""Which tokens of a packed layout see which, as intervals, and what a pass over layouts costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions import questions as qs

#: Tokens of one pass (a row's prefix counts with it), and the longest layout that runs packed.
PASS_TOKENS, PACKED_TOKENS = 16384, 8192
_SPANS = "array<struct<start:int,stop:int>>"


def segment_runs(layouts: DataFrame, seg: str = "seg") -> DataFrame:
    """layouts with `runs`: the runs of equal segment numbers (seg, start, stop) of each layout, in order."""
    n = F.size(seg)
    starts = F.filter(qs.indices(n), lambda i: (i == 0) | (F.get(seg, i) != F.get(seg, i - 1)))
    rows = layouts.withColumn("__starts", starts)
    run = lambda s, k: F.struct(F.get(seg, s).alias("seg"), s.alias("start"), F.coalesce(F.get("__starts", k + 1), n).alias("stop"))
    return rows.withColumn("runs", F.transform("__starts", run)).drop("__starts")


def _closed(run: Column) -> Column:
    """The spans before a run that its tokens see whole: state and the run's own segment, neighbours joined."""
    seen = F.filter("runs", lambda q: (q["stop"] <= run["start"]) & ((q["seg"] == 0) | (q["seg"] == run["seg"])))

    def add(spans: Column, q: Column) -> Column:
        last = F.try_element_at(spans, F.lit(-1))
        one = F.array(F.struct(q["start"].alias("start"), q["stop"].alias("stop")))
        grown = F.array(F.struct(last["start"].alias("start"), q["stop"].alias("stop")))
        return F.when(last["stop"] == q["start"], F.concat(F.slice(spans, F.lit(1), F.size(spans) - 1), grown)).otherwise(F.concat(spans, one))

    return F.aggregate(seen, F.array().cast(_SPANS), add)


def visible(layouts: DataFrame, id_col: str = "record_id", seg: str = "seg") -> DataFrame:
    """A row for each run of tokens of each layout: id_col, seg, start, stop, closed and open.

    A token sees itself and the tokens before it that are of the state (segment 0) or of its own segment: token i of
    the run sees the spans in closed, and from open up to i. So a layout of q questions has q + 1 rows of a few
    spans each, where the mask has a cell for each pair of tokens. Null and empty layouts give no row.
    """
    runs = segment_runs(layouts.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{seg}`").alias("__seg")).where(F.size("__seg") > 0), "__seg")
    rows = runs.select("__id", F.inline(F.transform("runs", lambda r: F.struct(r["seg"].alias("seg"), r["start"].alias("start"), r["stop"].alias("stop"), _closed(r).alias("spans")))))
    last = F.try_element_at("spans", F.lit(-1))
    touches = F.coalesce(last["stop"] == F.col("start"), F.lit(False))
    closed = F.when(touches, F.slice("spans", F.lit(1), F.size("spans") - 1)).otherwise(F.col("spans"))
    return rows.select(F.col("__id").alias(id_col), "seg", "start", "stop", closed.alias("closed"), F.when(touches, last["start"]).otherwise(F.col("start")).alias("open"))


def _width(spans: str) -> Column:
    return F.aggregate(spans, F.lit(0), lambda a, s: a + s["stop"] - s["start"])


def token_view(layouts: DataFrame, id_col: str = "record_id", seg: str = "seg") -> DataFrame:
    """A row for each token: id_col, token, seg, sees (how many tokens) and spans (which, from start up to before stop)."""
    rows = visible(layouts, id_col, seg).withColumn("token", F.explode(F.sequence("start", F.col("stop") - 1)))
    own = F.array(F.struct(F.col("open").alias("start"), (F.col("token") + 1).alias("stop")))
    return rows.select(id_col, "token", "seg", (_width("closed") + F.col("token") + 1 - F.col("open")).alias("sees"), F.concat("closed", own).alias("spans"))


def mask_cells(layouts: DataFrame, id_col: str = "record_id", seg: str = "seg", length: str | None = None) -> DataFrame:
    """By layout: tokens, allowed cells of its mask and all cells, padded to the column `length` (padding sees itself alone)."""
    n = F.col("stop") - F.col("start")
    inside = n * (_width("closed") + F.col("start") - F.col("open")) + n * (n + 1) / 2
    cells = visible(layouts, id_col, seg).groupBy(id_col).agg(F.sum(n).cast("long").alias("tokens"), F.sum(inside).cast("long").alias("allowed"))
    if length is None:
        return cells.select(id_col, "tokens", "allowed", (F.col("tokens") * F.col("tokens")).alias("cells"))
    to = F.col("__to").cast("long")
    padded = cells.join(layouts.select(id_col, F.col(length).alias("__to")), id_col)
    return padded.select(id_col, "tokens", (F.col("allowed") + to - F.col("tokens")).alias("allowed"), (to * to).alias("cells"))


def padded(tokens: Column, length: Column, pad: int, left: bool = False) -> Column:
    """Tokens with pads up to a length, on the right or on the left."""
    pads = F.array_repeat(F.lit(pad), F.greatest(length - F.size(tokens), F.lit(0)).cast("int"))
    return F.concat(pads, tokens) if left else F.concat(tokens, pads)


def pass_costs(layouts: DataFrame, form: str = "cached", budget: int = PASS_TOKENS, packed_limit: int = PACKED_TOKENS) -> DataFrame:
    """By packed layout: the form that it runs in, its passes, and the tokens that are computed.

    A packed layout over the limit runs cached. `packed`: all tokens in one pass. `rows`: each question with its own
    copy of the state. `cached`: the state once, then the questions' branches on copies of its prefix. Rows of
    questions share passes, as many as fit the budget with their prefix when padded to the longest, one at least.
    """
    if form not in ("packed", "rows", "cached"):
        raise ValueError(f"no form {form!r}")
    ok = layouts.where(F.col("status") == "ok")
    branch = F.transform("decide_idx", lambda d, k: d + 1 - F.when(k == 0, F.col("n_state")).otherwise(F.get("decide_idx", k - 1) + 1))
    rows = ok.select("record_id", "n_state", F.size("ids").alias("tokens"), branch.alias("branches"))
    runs = F.when(F.lit(form == "packed") & (F.col("tokens") <= packed_limit), "packed").when(F.lit(form == "rows"), "rows").otherwise("cached")
    # A row holds state and branch either way: computed again (rows) or taken from the prefix (cached).
    each = F.greatest(F.lit(1), F.floor(F.lit(budget) / (F.col("n_state") + F.array_max("branches"))).cast("int"))
    questions = F.size("branches")
    rows = rows.withColumns({"form": runs, "questions": questions, "rows_a_pass": F.least(each, questions)})
    passes = F.when(F.col("form") == "packed", F.lit(1)).otherwise(F.ceil(questions / F.col("rows_a_pass")).cast("int") + (F.col("form") == "cached").cast("int"))
    computed = F.when(F.col("form") == "rows", F.col("tokens") + F.col("n_state") * (questions - 1)).otherwise(F.col("tokens"))
    return rows.select("record_id", "form", "questions", "rows_a_pass", passes.alias("passes"), computed.alias("computed"), (F.col("tokens") + F.col("n_state") * (questions - 1) - computed).alias("saved"))
