"""Vertex positions: random, radial, force-directed (also from coarse graphs up) and attractive-repulsive, as (id, x, y)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.graph import Graph
from vertexloom.plans.iterate import cut


def random_layout(g: Graph, side: float = 1.0, seed: int = 0) -> DataFrame:
    def unit(salt):
        return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(1 << 52)) / float(1 << 52) * side

    return g.vertices.select("id", unit(1).alias("x"), unit(2).alias("y"))


def radial_layout(g: Graph, root: int) -> DataFrame:
    """Rings by distance from the root; angles spread over each ring in id order."""
    from vertexloom.functions.ordering import numbered_within
    from vertexloom.operators.paths import shortest_distance

    d = numbered_within(shortest_distance(g, root).select("id", F.coalesce("dist", F.lit(-1.0)).alias("r")), ["r"], ["id"])
    d = d.join(F.broadcast(d.groupBy("r").agg(F.max("n").alias("last"))), "r")  # a row for each ring
    angle = F.col("n") / (F.col("last") + 1) * 2 * math.pi
    return d.select("id", (F.col("r") * F.cos(angle)).alias("x"), (F.col("r") * F.sin(angle)).alias("y"))


def _pushed(at: DataFrame, cells: DataFrame, strength: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """``at`` with px and py, summed over the cells, which travel as one array: no row for each vertex and cell is made."""
    every = F.broadcast(cells.agg(F.collect_list(F.struct("n", "mx", "my")).alias("_cells")))

    def add(sums, c):
        dx, dy = F.col("x") - c["mx"], F.col("y") - c["my"]
        s = strength(dx, dy, c["n"])
        return F.struct((sums["px"] + s * dx).alias("px"), (sums["py"] + s * dy).alias("py"))

    nothing = F.struct(F.lit(0.0).alias("px"), F.lit(0.0).alias("py"))
    return at.join(every).withColumn("_push", F.aggregate("_cells", nothing, add)).select(*at.columns, "_push.px", "_push.py")


def force_layout(g: Graph, rounds: int = 20, side: float = 10.0, seed: int = 0, start: DataFrame | None = None) -> DataFrame:
    """Springs along edges; repulsion from the mean of each cell of a grid, which stands for its vertices."""
    a = cut(g.as_undirected().adjacency.where("src <> dst").select("src", "dst"))
    n = max(1, g.num_vertices())
    k, heat = side / math.sqrt(n), side / 10
    at = cut(random_layout(g, side, seed) if start is None else start.select("id", "x", "y"))
    box = lambda c: F.greatest(F.lit(-side), F.least(F.lit(2 * side), c))
    for _ in range(rounds):  # 25 by 25 cells at most
        cells = at.groupBy(F.floor(box(F.col("x")) / (side / 8)).alias("cx"), F.floor(box(F.col("y")) / (side / 8)).alias("cy")).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
        push = _pushed(at, cells, lambda dx, dy, n: n * k * k / (dx * dx + dy * dy + 1e-3))
        ends = a.join(at.toDF("src", "x", "y"), "src").join(at.toDF("dst", "u", "v"), "dst")
        length = F.sqrt((F.col("u") - F.col("x")) ** 2 + (F.col("v") - F.col("y")) ** 2)
        pull = ends.groupBy(F.col("src").alias("id")).agg(F.sum((F.col("u") - F.col("x")) * length / k).alias("qx"), F.sum((F.col("v") - F.col("y")) * length / k).alias("qy"))
        f = push.join(pull, "id", "left").withColumn("fx", F.col("px") + F.coalesce("qx", F.lit(0.0))).withColumn("fy", F.col("py") + F.coalesce("qy", F.lit(0.0)))
        norm = F.sqrt(F.col("fx") ** 2 + F.col("fy") ** 2) + 1e-9
        move = F.least(norm, F.lit(heat)) / norm
        at = cut(f.select("id", box(F.col("x") + F.col("fx") * move).alias("x"), box(F.col("y") + F.col("fy") * move).alias("y")))
        heat *= 0.9
    return at


def multilevel_layout(g: Graph, rounds: int = 10, side: float = 10.0, least: int = 64, seed: int = 0) -> DataFrame:
    """``force_layout`` of the coarsest graph first; each finer one starts where its blocks lie, a little apart."""
    from vertexloom.operators.transform import coarse_stack, merged

    stack, graphs = coarse_stack(g, least=least, seed=seed), [g]
    for x, blocks in stack:  # the edges of each level are written once, for the next one
        graphs.append(x.with_edges(cut(merged(graphs[-1], blocks))))
    at = force_layout(graphs[-1], rounds, side, seed)
    for level in range(len(stack) - 1, -1, -1):
        apart = random_layout(graphs[level], side / 100, seed).toDF("id", "dx", "dy")
        start = stack[level][1].join(at.withColumnRenamed("id", "block"), "block").join(apart, "id").select("id", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"))
        at = force_layout(graphs[level], rounds, side, seed, start)
    return at


def arf_layout(g: Graph, rounds: int = 30, a: float = 10.0, d: float = 0.5, dt: float = 1e-3, seed: int = 0) -> DataFrame:
    """Every vertex is drawn to all others (``a`` times as strongly along edges) and pushed off at constant force ``d`` sqrt(N) by
    each, where the cells of a grid stand for the vertices in them."""
    n = max(1, g.num_vertices())
    e = cut(g.as_undirected().adjacency.where("src <> dst").select("src", "dst"))
    at = cut(random_layout(g, math.sqrt(n), seed))
    for _ in range(rounds):
        ends = at.agg(F.avg("x").alias("ax"), F.avg("y").alias("ay"), F.min("x").alias("lx"), F.min("y").alias("ly"), (F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")) / 16 + 1e-9).alias("w"))
        placed = at.join(F.broadcast(ends))
        cells = placed.groupBy(F.floor((F.col("x") - F.col("lx")) / F.col("w")).alias("cx"), F.floor((F.col("y") - F.col("ly")) / F.col("w")).alias("cy")).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"))  # 17 by 17 at most
        push = _pushed(placed, cells, lambda dx, dy, n: n / (F.sqrt(dx * dx + dy * dy) + 1e-6))
        near = e.join(at.toDF("src", "x", "y"), "src").join(at.toDF("dst", "u", "v"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("u") - F.col("x")).alias("qx"), F.sum(F.col("v") - F.col("y")).alias("qy"))
        f = push.join(near, "id", "left")

        def moved(c, mean, pushed, pulled):
            return F.col(c) + dt * (n * (F.col(mean) - F.col(c)) + (a - 1) * F.coalesce(pulled, F.lit(0.0)) + d * math.sqrt(n) * F.col(pushed))

        at = cut(f.select("id", moved("x", "ax", "px", "qx").alias("x"), moved("y", "ay", "py", "qy").alias("y")))
    return at
