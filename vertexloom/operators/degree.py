"""Degrees and vertex/edge properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.functions.ordering import ranks
from vertexloom.graph import Graph, on_vertices


def degree(g: Graph, kind: str = "total", weight: str | None = None, name: str = "degree") -> DataFrame:
    """id and the degree, or the sum of ``weight``. Undirected: in is 0, out and total count incident ends."""
    ends = {"in": ["dst"], "out": ["src"], "total": ["src", "dst"]}[kind]
    if not g.directed:
        if kind == "in":
            return g.vertices.select("id", F.lit(0).cast("long").alias(name))
        ends = ["src", "dst"]
    w = F.lit(1).cast("long") if weight is None else F.col(weight)
    each = g.edges.select(F.explode(F.array(*ends)).alias("id"), w.alias("w"))
    return on_vertices(g, each.groupBy("id").agg(F.sum("w").alias(name)), name)


def selected(g: Graph, what: str, name: str) -> DataFrame:
    """A degree selector or a numeric vertex property as (id, name)."""
    return degree(g, what, name=name) if what in ("in", "out", "total") else g.vertices.select("id", F.col(what).alias(name))


def edge_endpoint(g: Graph, prop: str, end: str = "source", name: str = "value") -> DataFrame:
    """eid and the property of the edge's source or target; undirected: the smaller id is the source."""
    side = {"source": "src", "target": "dst"}[end]
    at = F.col(side) if g.directed else (F.least("src", "dst") if end == "source" else F.greatest("src", "dst"))
    return g.edges.select("eid", at.alias("id")).join(g.vertices.select("id", F.col(prop).alias(name)), "id").select("eid", name)


def incident(g: Graph, op: str, prop: str, side: str = "out", name: str = "value") -> DataFrame:
    """id and the sum, prod, min or max of an edge property over in- or out-edges; 0 without edges."""
    fold = {"sum": F.sum, "prod": F.product, "min": F.min, "max": F.max}[op]
    key = "src" if side == "out" else "dst"
    return on_vertices(g, g.adjacency.groupBy(F.col(key).alias("id")).agg(fold(prop).alias(name)), name)


def infect(g: Graph, prop: str, values: list) -> DataFrame:
    """id and the property after vertices that hold one of ``values`` have passed it to their out-neighbours (of several the one from the smallest id)."""
    carriers = g.vertices.where(F.col(prop).isin(values)).select(F.col("id").alias("src"), F.col(prop).alias("passed"))
    got = g.adjacency.join(carriers, "src").groupBy(F.col("dst").alias("id")).agg(F.min_by("passed", "src").alias("passed"))
    return g.vertices.select("id", prop).join(got, "id", "left").select("id", F.coalesce("passed", prop).alias(prop))


def find_vertex(g: Graph, prop: str, low, high=None) -> DataFrame:
    """Vertices whose property or degree equals ``low``, or lies in low..high."""
    rows = selected(g, prop, "_p").join(g.vertices, "id") if prop in ("in", "out", "total") else g.vertices.withColumn("_p", F.col(prop))
    return rows.where(F.col("_p").between(low, low if high is None else high)).drop("_p")


def find_edge(g: Graph, prop: str, low, high=None) -> DataFrame:
    return g.edges.where(F.col(prop).between(low, low if high is None else high))


def neighbours(g: Graph, v: int, kind: str = "out") -> DataFrame:
    """Neighbours of a vertex, one row for each edge."""
    a = g.adjacency
    out = a.where(F.col("src") == v).select("eid", F.col("dst").alias("id"))
    into = a.where(F.col("dst") == v).select("eid", F.col("src").alias("id"))
    if not g.directed:
        return out
    return {"out": out, "in": into, "all": out.union(into)}[kind]


def edges_between(g: Graph, s: int, t: int) -> DataFrame:
    hit = (F.col("src") == s) & (F.col("dst") == t)
    return g.edges.where(hit if g.directed else hit | ((F.col("src") == t) & (F.col("dst") == s)))


def copied(df: DataFrame, src: str, tgt: str, kind: str | None = None) -> DataFrame:
    return df.withColumn(tgt, F.col(src) if kind is None else F.col(src).cast(kind))


def grouped(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Scalar columns to one vector."""
    return df.withColumn(name, F.array(*columns))


def ungrouped(df: DataFrame, vector: str, places: list[int], names: list[str]) -> DataFrame:
    """Places of a vector as columns, null where it is short."""
    return df.withColumns({n: F.get(vector, F.lit(p)) for p, n in zip(places, names, strict=True)})


def perfect_hash(frames: list[tuple[DataFrame, str]], name: str = "hash") -> list[DataFrame]:
    """One dictionary for several properties: dense numbers from 0 in value order, as column ``name``."""
    every = frames[0][0].select(F.col(frames[0][1]).alias("k"))
    for df, c in frames[1:]:
        every = every.union(df.select(c))
    codes = ranks(every.where("k is not null"), F.col("k"), name)
    return [df.join(codes.withColumnRenamed("key", c), c, "left") for df, c in frames]


def mapped(df: DataFrame, column: str, table: DataFrame, name: str) -> DataFrame:
    """Look ``column`` up in ``table`` (key, value)."""
    return df.join(table.select(F.col("key").alias(column), F.col("value").alias(name)), column, "left")


def reversed_map(df: DataFrame, column: str, name: str = "id") -> DataFrame:
    """value and the smallest id that has it."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.min(name).alias(name))


def continuous(df: DataFrame, column: str, name: str) -> DataFrame:
    """Relabel to 0..k-1 in value order."""
    return df.join(ranks(df, F.col(column), name).withColumnRenamed("key", column), column)


def to_size(df: DataFrame, column: str, low: float = 0.0, high: float = 5.0, power: float = 0.5, log: bool = False, name: str = "size") -> DataFrame:
    """Rescale to low..high along a power of the place in the range; a constant column gets ``low``. ``log`` takes natural logarithms first."""
    x: Column = F.log(column) if log else F.col(column).cast("double")
    ends = df.agg(F.min(x).alias("_a"), F.max(x).alias("_b"))
    share = F.when(F.col("_b") > F.col("_a"), (x - F.col("_a")) / (F.col("_b") - F.col("_a"))).otherwise(0.0)
    return df.join(F.broadcast(ends)).withColumn(name, F.lit(low) + (high - low) * F.pow(share, F.lit(power))).drop("_a", "_b")


def marked(g: Graph, mapping: DataFrame, edge_mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flags on vertices and edges for the embedding given as (id) and (eid)."""
    v = g.vertices.join(mapping.select("id", F.lit(True).alias("marked")).distinct(), "id", "left").select("id", F.coalesce("marked", F.lit(False)).alias("marked"))
    e = g.edges.join(edge_mapping.select("eid", F.lit(True).alias("marked")).distinct(), "eid", "left").select("eid", F.coalesce("marked", F.lit(False)).alias("marked"))
    return v, e
