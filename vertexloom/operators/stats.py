"""Statistics over vertices and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.functions.bins import Bins, histogram
from vertexloom.functions.ordering import numbered_within
from vertexloom.graph import Graph
from vertexloom.operators.degree import selected


def vertex_hist(g: Graph, what: str, bins: list[float], whole: bool = True) -> DataFrame:
    return histogram(selected(g, what, "x"), F.col("x"), Bins(bins, whole))


def edge_hist(g: Graph, prop: str, bins: list[float], whole: bool = False) -> DataFrame:
    return histogram(g.edges, F.col(prop), Bins(bins, whole))


def average(rows: DataFrame, column: str) -> DataFrame:
    """mean and standard error sqrt((E x^2 - mean^2) / n)."""
    return rows.agg(F.avg(column).alias("mean"), (F.stddev_pop(column) / F.sqrt(F.count(column))).alias("std_err"))


def vertex_average(g: Graph, what: str) -> DataFrame:
    return average(selected(g, what, "x"), "x")


def edge_average(g: Graph, prop: str) -> DataFrame:
    return average(g.edges, prop)


def vector_average(rows: DataFrame, column: str) -> DataFrame:
    """Element by element: pos, mean and std_err."""
    return rows.select(F.posexplode(column).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("mean"), (F.stddev_pop("x") / F.sqrt(F.count("x"))).alias("std_err"))


def _pair(g: Graph):
    return ["src", "dst"] if g.directed else [F.least("src", "dst"), F.greatest("src", "dst")]


def label_parallel_edges(g: Graph, mark_only: bool = False) -> DataFrame:
    """eid and label: 0 for the first edge of a pair by eid, then 1, 2, ... (or a flag); loops are pairs."""
    a, b = _pair(g)
    n = numbered_within(g.edges.select("eid", F.col(a).alias("a") if g.directed else a.alias("a"), F.col(b).alias("b") if g.directed else b.alias("b")), ["a", "b"], ["eid"], "label")
    return n.select("eid", (F.col("label") > 0).alias("label") if mark_only else F.col("label"))


def remove_parallel_edges(g: Graph) -> Graph:
    first = g.edges.groupBy(*[F.expr(c) if isinstance(c, str) else c for c in _pair(g)]).agg(F.min("eid").alias("eid")).select("eid")
    return g.with_edges(g.edges.join(first, "eid", "left_semi").select(g.edges.columns))


def label_self_loops(g: Graph, mark_only: bool = False) -> DataFrame:
    """eid and label: loops of a vertex are numbered from 1, other edges get 0."""
    loops = numbered_within(g.edges.where("src = dst").select("eid", "src"), ["src"], ["eid"], "label").select("eid", (F.col("label") + 1).alias("label"))
    out = loops.unionByName(g.edges.where("src <> dst").select("eid", F.lit(0).cast("long").alias("label")))
    return out.select("eid", (F.col("label") > 0).alias("label")) if mark_only else out


def remove_self_loops(g: Graph) -> Graph:
    return g.with_edges(g.edges.where("src <> dst"))


def remove_labeled_edges(g: Graph, labels: DataFrame) -> Graph:
    """Drops edges whose label (eid, label) is above 0."""
    return g.with_edges(g.edges.join(labels.where("label > 0").select("eid"), "eid", "left_anti"))
