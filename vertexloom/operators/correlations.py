"""Correlations over edges and vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.functions.bins import Bins
from vertexloom.graph import Graph
from vertexloom.operators.degree import selected


def _ends(g: Graph, a: str, b: str, weight: str | None = None) -> DataFrame:
    """x at src, y at dst and the weight of every edge as seen from src."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    e = g.adjacency.select("src", "dst", w.alias("w"))
    return e.join(selected(g, a, "x").withColumnRenamed("id", "src"), "src").join(selected(g, b, "y").withColumnRenamed("id", "dst"), "dst").select("x", "y", "w")


def assortativity(g: Graph, what: str) -> DataFrame:
    """r and its jackknife error sigma over classes of ``what``."""
    pairs = _ends(g, what, what).groupBy("x", "y").agg((F.sum("w") * (1.0 if g.directed else 0.5)).alias("n"))
    a = pairs.groupBy("x").agg(F.sum("n").alias("a"))
    b = pairs.groupBy("y").agg(F.sum("n").alias("b"))
    sums = a.join(b, a.x == b.y, "full").agg(F.sum(F.coalesce("a", F.lit(0.0)) * F.coalesce("b", F.lit(0.0))).alias("ab"))
    total = pairs.agg(F.sum("n").alias("e"), F.coalesce(F.sum(F.when(F.col("x") == F.col("y"), F.col("n"))), F.lit(0.0)).alias("same"))
    one = total.join(F.broadcast(sums)).withColumn("t1", F.col("same") / F.col("e")).withColumn("t2", F.col("ab") / F.col("e") ** 2)
    one = one.withColumn("r", (F.col("t1") - F.col("t2")) / (1 - F.col("t2")))
    left = pairs.join(F.broadcast(one)).join(a.withColumnRenamed("x", "ax").withColumnRenamed("a", "aa"), F.col("y") == F.col("ax"), "left").join(b.withColumnRenamed("y", "by").withColumnRenamed("b", "bb"), F.col("x") == F.col("by"), "left")
    # without one edge x -> y: the class sums of its ends fall by one
    step = 1.0
    e1 = F.col("e") - step
    t2 = (F.col("ab") - step * F.coalesce("bb", F.lit(0.0)) - step * F.coalesce("aa", F.lit(0.0))) / e1**2
    t1 = (F.col("same") - F.when(F.col("x") == F.col("y"), step).otherwise(0.0)) / e1
    rl = (t1 - t2) / (1 - t2)
    return left.agg(F.first("r").alias("r"), F.sqrt(F.sum(F.col("n") * (F.col("r") - rl) ** 2)).alias("sigma"))


def scalar_assortativity(g: Graph, what: str) -> DataFrame:
    """Pearson correlation over edges' ends and its jackknife error."""
    rows = _ends(g, what, what).groupBy("x", "y").agg((F.sum("w") * (1.0 if g.directed else 0.5)).alias("n"))
    x, y, n = F.col("x").cast("double"), F.col("y").cast("double"), F.col("n")
    s = rows.agg(F.sum("n").alias("e"), F.sum(n * x).alias("sx"), F.sum(n * y).alias("sy"), F.sum(n * x * x).alias("sxx"), F.sum(n * y * y).alias("syy"), F.sum(n * x * y).alias("sxy"))

    def corr(e, sx, sy, sxx, syy, sxy):
        dx, dy = F.sqrt(sxx / e - (sx / e) ** 2), F.sqrt(syy / e - (sy / e) ** 2)
        cov = sxy / e - sx / e * (sy / e)
        return F.when(dx * dy > 0, cov / (dx * dy)).otherwise(cov)

    c = {k: F.col(k) for k in ("e", "sx", "sy", "sxx", "syy", "sxy")}
    left = rows.join(F.broadcast(s)).withColumn("r", corr(**c)).withColumn("rl", corr(c["e"] - 1, c["sx"] - x, c["sy"] - y, c["sxx"] - x * x, c["syy"] - y * y, c["sxy"] - x * y))
    return left.agg(F.first("r").alias("r"), F.sqrt(F.sum(n * (F.col("r") - F.col("rl")) ** 2)).alias("sigma"))


def _hist2(rows: DataFrame, first: Bins, second: Bins) -> DataFrame:
    at = rows.select(first.index(F.col("x")).alias("i"), second.index(F.col("y")).alias("j"), "w").where("i is not null and j is not null")
    return at.groupBy("i", "j").agg(F.sum("w").alias("count")).select(first.left(F.col("i")).alias("x_left"), second.left(F.col("j")).alias("y_left"), "count")


def corr_hist(g: Graph, a: str, b: str, bins: tuple[list, list], weight: str | None = None) -> DataFrame:
    """Two-dimensional histogram over (vertex, out-neighbour); cells that are not empty."""
    return _hist2(_ends(g, a, b, weight), Bins(bins[0]), Bins(bins[1]))


def combined_corr_hist(g: Graph, a: str, b: str, bins: tuple[list, list]) -> DataFrame:
    rows = selected(g, a, "x").join(selected(g, b, "y"), "id").withColumn("w", F.lit(1.0))
    return _hist2(rows, Bins(bins[0]), Bins(bins[1]))


def _averages(rows: DataFrame, bins: Bins) -> DataFrame:
    """mean of y in bins of x; the second moment is of y times weight, squared."""
    at = rows.select(bins.index(F.col("x")).alias("i"), (F.col("y") * F.col("w")).alias("k"), "w").where("i is not null")
    s = at.groupBy("i").agg(F.sum("k").alias("s"), F.sum(F.col("k") * F.col("k")).alias("s2"), F.sum("w").alias("n"))
    mean = F.col("s") / F.col("n")
    return s.select(bins.left(F.col("i")).alias("bin_left"), mean.alias("mean"), (F.sqrt(F.abs(F.col("s2") / F.col("n") - mean * mean)) / F.sqrt("n")).alias("std_err"))


def avg_neighbour_corr(g: Graph, a: str, b: str, bins: list, weight: str | None = None) -> DataFrame:
    return _averages(_ends(g, a, b, weight), Bins(bins))


def avg_combined_corr(g: Graph, a: str, b: str, bins: list) -> DataFrame:
    return _averages(selected(g, a, "x").join(selected(g, b, "y"), "id").withColumn("w", F.lit(1.0)), Bins(bins))
