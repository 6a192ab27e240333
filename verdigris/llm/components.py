"""Connected components by contraction, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checkpoint


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in edges (a, b): component is the smallest id that id reaches.

    Every round each vertex points at the smallest of itself and its neighbours, pointers are doubled until all
    are at roots, edges move to the roots of their ends, and loops and repeats go. At most half of the vertices
    with edges are roots, so rounds and doublings are logarithmic, also for long chains. A vertex with many
    neighbours is a group whose minimum is taken on each side of the shuffle, never a list. Null ends are
    ignored. Only whether edges or unfinished pointers are left reaches the driver.
    """
    left = checkpoint(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct())
    labels = left.select(F.col("a").alias("id"), F.col("b").alias("component"))  # of no edges: no row
    first = True
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        roots = _roots(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("to")).select(F.col("a").alias("v"), "to"))
        if first:  # every vertex has an edge
            labels, first = roots.select(F.col("v").alias("id"), F.col("to").alias("component")), False
        else:  # a component may have most of the ids by now
            moved = roots.select(F.col("v").alias("component"), "to").withColumn("part", _every_part())
            labels = checkpoint(labels.withColumn("part", _part()).join(moved, ["component", "part"], "left").select("id", F.coalesce("to", "component").alias("component")))
        ends = left.join(roots.select(F.col("v").alias("a"), F.col("to").alias("p")), "a").join(roots.select(F.col("v").alias("b"), F.col("to").alias("q")), "b")
        left = checkpoint(ends.where(F.col("p") != F.col("q")).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct())
    return labels


#: Parts that a component's members go to where the smallest of their names is handed out.
PARTS = 16


def _part() -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(PARTS))


def _every_part() -> Column:
    return F.explode(F.array(*(F.lit(k).cast("long") for k in range(PARTS))))


def smallest_names(found: DataFrame, names: DataFrame) -> DataFrame:
    """(id, root) for every id of found (id, component): root is the smallest name in its component; names: (id, first).

    Minima are taken on each side of the shuffle; a large component's members get theirs in PARTS tasks.
    """
    linked = found.join(names.select("id", "first"), "id")
    roots = linked.groupBy("component").agg(F.min("first").alias("root")).withColumn("part", _every_part())
    return linked.withColumn("part", _part()).join(roots, ["component", "part"]).select("id", "root")


def _roots(points: DataFrame) -> DataFrame:
    """(v, to) with every pointer moved on to its root, the vertex that points at itself; each step doubles what a pointer spans."""
    while True:
        on = points.select(F.col("v").alias("to"), F.col("to").alias("next"))
        moved = checkpoint(points.join(on, "to").select("v", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
        points = moved.select("v", "to")
        if moved.where("moved").isEmpty():
            return points
