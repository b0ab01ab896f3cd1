"""Sparse matrices as (i, j, value) triplets; equal places are summed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.graph import Graph
from vertexloom.operators.degree import degree


def _weight(weight):
    return F.lit(1.0) if weight is None else F.col(weight).cast("double")


def adjacency(g: Graph, weight: str | None = None) -> DataFrame:
    return g.adjacency.select(F.col("dst").alias("i"), F.col("src").alias("j"), _weight(weight).alias("w")).groupBy("i", "j").agg(F.sum("w").alias("value"))


def laplacian(g: Graph, kind: str = "total", normalized: bool = False, weight: str | None = None) -> DataFrame:
    k = degree(g, kind, weight, "k").select("id", F.col("k").cast("double").alias("k"))
    off = g.adjacency.where("src <> dst").select(F.col("dst").alias("i"), F.col("src").alias("j"), _weight(weight).alias("w"))
    if normalized:
        off = off.join(k.withColumnsRenamed({"id": "i", "k": "ki"}), "i").join(k.withColumnsRenamed({"id": "j", "k": "kj"}), "j")
        off = off.select("i", "j", F.when(F.col("ki") * F.col("kj") > 0, -F.col("w") / F.sqrt(F.col("ki") * F.col("kj"))).otherwise(0.0).alias("value"))
        diagonal = k.select(F.col("id").alias("i"), F.col("id").alias("j"), F.when(F.col("k") > 0, 1.0).otherwise(0.0).alias("value"))
    else:
        off = off.select("i", "j", (-F.col("w")).alias("value"))
        diagonal = k.select(F.col("id").alias("i"), F.col("id").alias("j"), F.col("k").alias("value"))
    return off.groupBy("i", "j").agg(F.sum("value").alias("value")).unionByName(diagonal)


def incidence(g: Graph) -> DataFrame:
    """i is the vertex, j the edge."""
    sign = -1.0 if g.directed else 1.0
    ends = F.array(F.struct(F.col("src").alias("i"), F.lit(sign).alias("value")), F.struct(F.col("dst").alias("i"), F.lit(1.0).alias("value")))
    return g.edges.select(F.col("eid").alias("j"), F.explode(ends).alias("x")).groupBy("x.i", "j").agg(F.sum("x.value").alias("value"))


def transition(g: Graph, weight: str | None = None) -> DataFrame:
    """Column-stochastic: value is the weight from j to i over the out-weight of j."""
    k = degree(g, "out", weight, "k").select(F.col("id").alias("j"), F.col("k").cast("double").alias("k"))
    a = g.adjacency.select(F.col("dst").alias("i"), F.col("src").alias("j"), _weight(weight).alias("w"))
    return a.groupBy("i", "j").agg(F.sum("w").alias("w")).join(k, "j").select("i", "j", (F.col("w") / F.col("k")).alias("value"))


def matvec(matrix: DataFrame, x: DataFrame) -> DataFrame:
    """(id, y) from triplets and (id, x)."""
    return matrix.join(x.withColumnRenamed("id", "j"), "j").groupBy(F.col("i").alias("id")).agg(F.sum(F.col("value") * F.col("x")).alias("y"))


def modularity_matvec(g: Graph, x: DataFrame, weight: str | None = None) -> DataFrame:
    """(id, y) of A x - k_out (k_in . x) / E, without the dense rank-one part."""
    total = F.sum(F.col("k"))
    out = degree(g, "out", weight, "k")
    into = degree(g, "in" if g.directed else "out", weight, "k")
    dot = into.join(x, "id").agg(F.coalesce(F.sum(F.col("k") * F.col("x")), F.lit(0.0)).alias("dot"))
    e = out.agg(total.alias("e"))
    y = matvec(adjacency(g, weight), x)
    rows = out.join(y, "id", "left").join(F.broadcast(dot)).join(F.broadcast(e))
    return rows.select("id", (F.coalesce("y", F.lit(0.0)) - F.col("k") * F.col("dot") / F.col("e")).alias("y"))
