"""Connected components by deterministic Borůvka hooking: rounds grow with the logarithm of a component's size, not its width."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import shared
from ..sources.shared import Scratch
from .skew import HOT_ROWS, salted_lookup


def connect(edges: DataFrame, hot_rows: int = HOT_ROWS, scratch: Scratch | None = None) -> DataFrame:
    """``(id, group_id)`` for every vertex of ``edges (a, b)``; ``group_id`` is the smallest vertex linked directly or indirectly.

    Null ends and self-edges are left out.  Each round counts the edges of its vertices once, while it chooses their smallest edges; the
    counts tell which ends are hot when the edges are relabelled.
    """
    scratch = scratch or Scratch(edges.sparkSession, "connect")
    edges = edges.filter("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = scratch.keep(edges)
    forest: list[DataFrame] = []
    while shared.rows(edges):
        chosen = scratch.keep(_hook(edges))
        parent = _collapse(chosen, scratch, hot_rows)
        forest.append(parent)
        roots = parent.filter("v <> p")
        small = shared.rows(edges) <= hot_rows
        nxt = _relabel(_relabel(edges, roots, "a", "b", hot_rows, small), roots, "b", "a", hot_rows, small)
        nxt = scratch.keep(nxt.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        scratch.drop(edges)
        edges = nxt
    if not forest:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("group_id"))
    labels = forest[-1].select("v", "p")
    for parent in reversed(forest[:-1]):  # each round's roots are the vertices of the next
        up = labels.filter("v <> p").select(F.col("v").alias("p"), F.col("p").alias("_to"))
        labels = scratch.keep(salted_lookup(parent, up, ["p"], "v", "left", hot_rows).select("v", F.coalesce("_to", "p").alias("p")))
    return labels.select(F.col("v").alias("id"), F.col("p").alias("group_id"))


def _relabel(edges: DataFrame, roots: DataFrame, end: str, other: str, hot_rows: int, small: bool) -> DataFrame:
    """The edges with the roots of their ``end``; the degree of a vertex bounds how many edges have it as that end."""
    lookup = roots.select(F.col("v").alias(end), F.col("p").alias("_to"), F.col("n").alias("_n"))
    out = edges.join(lookup, end, "left") if small else salted_lookup(edges, lookup, [end], other, "left", hot_rows, counted="_n")
    return out.withColumn(end, F.coalesce("_to", end)).drop("_to", "_n")


def _hook(edges: DataFrame) -> DataFrame:
    """``(v, p, n)``: the other end of each vertex's smallest edge, and the number of its edges; the lower end of a mutual choice is a root.

    If v is the lower end of its smallest edge, no edge of the other end is smaller unless that end hooks further down; so
    the choice is mutual exactly when the other end's smallest edge has v as its lower end too.  The smallest edge of v is (least lower end,
    least higher end with it): below v it is the smallest neighbour, and else v's smallest neighbour as well.
    """
    ends = edges.select(F.col("a").alias("v"), F.col("b").alias("p")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("p")))
    return ends.groupBy("v").agg(F.min("p").alias("p"), F.count(F.lit(1)).alias("n"))


def _collapse(parent: DataFrame, scratch: Scratch, hot_rows: int) -> DataFrame:
    """Pointer doubling until every vertex points at its root; the first step also settles mutual choices."""
    first = True
    while True:
        up = parent.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        step = salted_lookup(parent, up, ["p"], "v", "left", hot_rows).withColumn("pp", F.coalesce("pp", "p"))
        if first:  # v <-> p: the lower one is the root of both
            to = F.when(F.col("pp") == F.col("v"), F.least("v", "p")).otherwise(F.col("p"))
            moved = F.lit(True)
        else:
            to, moved = F.col("pp"), F.col("pp") != F.col("p")
        step = step.select("v", to.alias("to"), moved.alias("moved"), "n")
        step = scratch.keep(step.select("v", F.col("to").alias("p"), "n", "moved"), moved=F.count_if("moved"))
        scratch.drop(parent)
        parent, first = step, False
        if not (shared.measure(step, "moved") or 0):
            return parent
