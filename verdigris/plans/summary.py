"""The report of an evaluation: every figure as a cell of a small table, then the tables as Markdown."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.operators import evaluation

#: Cells that a report may have; more are refused.
MOST = 20_000
KEYS = ("record_id", "question")
TITLES = {"systems": "Systems", "like_for_like": "Like for like: the questions that a parent could answer", "task": "Accuracy by task", "source_family": "Accuracy by source", "score": "Errors of levels", "order": "Sensitivity to the order of options", "generation": "Generated answers", "performance": "Performance", "sizes": "Sizes", "acceptance": "Acceptance"}
#: How a column's values read: shares as per cent, others with so many places.
SHARES, PLACES = ("agreement", "flip_rate"), {"vs_base": 1, "mean_max_dp": 3, "mae_expected": 3, "mae_modal": 3}


def _cells(rows: DataFrame, section: str, line: str | Column, column: str | Column, value: Column, n: Column) -> DataFrame:
    told = lambda v: F.lit(v) if isinstance(v, str) else v
    return rows.select(F.lit(section).alias("section"), told(line).alias("line"), told(column).alias("column"), value.cast("double").alias("value"), n.cast("long").alias("n"))


def _several(rows: DataFrame, section: str, line: Column, **values: Column) -> DataFrame:
    """A cell for each of the values, of each row."""
    each = F.array(*(F.struct(F.lit(name).alias("column"), v.cast("double").alias("value")) for name, v in values.items()))
    return rows.select(F.lit(section).alias("section"), line.alias("line"), F.inline(each), F.col("n").cast("long").alias("n")).select("section", "line", "column", "value", "n")


def cells(rows: DataFrame, base: str, reference: str, parents: Sequence[str]) -> DataFrame:
    """(section, line, column, value, n) of evaluation rows: all figures of quality.

    systems: accuracy, what it is above base in percentage points, agreement with reference; how many questions weren't
    eligible. task and source_family: accuracy by system. like_for_like: accuracy on what each of parents was eligible for. score: errors of
    levels. order: of reordered variants against canonical ones. Only canonical rows count elsewhere. A figure that can't be
    measured is null.
    """
    canonical = rows.where(F.col("variant") == "canonical")
    found = evaluation.panel_metrics(canonical, ("task", "source_family"))
    overall = found.where("level = 'overall'")
    ground = overall.where(F.col("system") == base).select(F.col("accuracy").alias("ground"))
    beside = overall.withColumn("ground", ground.scalar())
    said = canonical.where(F.col("system") == reference).where(F.col("pred").isNotNull()).select(*KEYS, F.col("pred").alias("__said"))
    same = canonical.where((F.col("system") != reference) & F.col("pred").isNotNull()).join(said, list(KEYS)).groupBy("system").agg(F.count("*").alias("n"), F.avg((F.col("pred") == F.col("__said")).cast("double")).alias("agreement"))
    answerable = canonical.where(F.col("system").isin(*parents) & F.col("eligible")).select(*KEYS, F.col("system").alias("__parent")).distinct()
    alike = evaluation.metrics(canonical.join(answerable, list(KEYS)), "__parent", "system")
    order = evaluation.order_sensitivity(rows)
    parts = [
        _several(beside, "systems", F.col("system"), accuracy=F.col("accuracy"), vs_base=F.when(F.col("system") != base, 100 * (F.col("accuracy") - F.col("ground")))),
        _cells(overall, "systems", F.col("system"), "ineligible", F.col("ineligible"), F.col("n_total")),
        _cells(same, "systems", F.col("system"), "agreement", F.col("agreement"), F.col("n")),
        *(_cells(found.where(F.col("level") == d), d, F.col("value"), F.col("system"), F.col("accuracy"), F.col("n")) for d in ("task", "source_family")),
        _cells(alike, "like_for_like", F.col("__parent"), F.col("system"), F.col("accuracy"), F.col("n")),
        _several(overall.where("score_n > 0").drop("n").withColumnRenamed("score_n", "n"), "score", F.col("system"), mae_expected=F.col("score_mae_expected"), mae_modal=F.col("score_mae_modal")),
        _several(order, "order", F.col("system"), flip_rate=F.col("flip_rate"), mean_max_dp=F.col("mean_max_dp")),
    ]
    return reduce(DataFrame.unionByName, parts)


def measured(rows: DataFrame, section: str, line: str, n: str, *columns: str) -> DataFrame:
    """Cells of any small table (timings, generations, sizes, acceptance): a line a row, its figures by column."""
    return _several(rows.withColumn("n", F.col(n)), section, F.col(line).cast("string"), **{c: F.col(c) for c in columns})


def _told(column: str, share: bool, value: float | None) -> str:
    if value is None:
        return "not measured"
    if share:
        return f"{100 * value:.1f}%"
    return f"{value:+.{PLACES[column]}f}" if column == "vs_base" else f"{value:.{PLACES[column]}f}" if column in PLACES else f"{value:g}"


def markdown(name: str, found: DataFrame, conditions: Mapping[str, str] | None = None, notes: Sequence[str] = (), missing: Sequence[str] = ()) -> str:
    """The report: conditions, notes, a table for each section in a fixed order, and what was not measured.

    A line's cells stand under its section's columns; one that there is none for, or that is null, is told as not measured.
    """
    rows = found.limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError("a report is for small aggregates")
    out = [f"# {name}", ""]
    out += [f"- {k}: {v}" for k, v in (conditions or {}).items()] + ([""] if conditions else [])
    for note in notes:
        out += [f"**Note:** {note}", ""]
    for section in sorted({r["section"] for r in rows}, key=lambda s: (list(TITLES).index(s) if s in TITLES else len(TITLES), s)):
        own = {(r["line"], r["column"]): r for r in rows if r["section"] == section}
        lines, columns = sorted({k for k, _ in own}), sorted({c for _, c in own})
        out += [f"## {TITLES.get(section, section)}", "", "| | " + " | ".join(columns) + " | n |", "|---|" + "---|" * (len(columns) + 1)]
        for line in lines:
            cut = [own.get((line, c)) for c in columns]
            shares = section in ("task", "source_family", "like_for_like")
            said = [_told(c, shares or c in SHARES or c == "accuracy", r["value"] if r else None) for c, r in zip(columns, cut, strict=True)]
            out.append(f"| {line} | " + " | ".join(said) + f" | {max(r['n'] or 0 for r in cut if r)} |")
        out.append("")
    out += [f"- Not measured in this run: {m}" for m in missing]
    return "\n".join(out).rstrip() + "\n"
