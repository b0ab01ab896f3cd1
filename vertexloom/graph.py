"""A graph is two DataFrames and a flag: vertices(id, ...), edges(eid, src, dst, ...), directed."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    """Multigraph with properties as columns; immutable, every method plans a new one. ``eid`` names an edge."""

    vertices: DataFrame
    edges: DataFrame
    directed: bool = True

    @staticmethod
    def from_edges(edges: DataFrame, vertices: DataFrame | None = None, directed: bool = True) -> Graph:
        """``edges`` needs src and dst; eid is made where it lacks (unique, not dense). Vertices default to end points."""
        if "eid" not in edges.columns:
            edges = edges.withColumn("eid", F.monotonically_increasing_id())
        if vertices is None:
            vertices = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        return Graph(vertices, edges, directed)

    @property
    def adjacency(self) -> DataFrame:
        """Edges as seen from src: both ways if undirected, where a loop counts twice."""
        if self.directed:
            return self.edges
        return self.edges.unionByName(swapped(self.edges))

    def reversed(self) -> Graph:
        return replace(self, edges=swapped(self.edges))

    def as_directed(self, directed: bool = True) -> Graph:
        return replace(self, directed=directed)

    def as_undirected(self) -> Graph:
        return self.as_directed(False)

    def view(self, vertex: Column | None = None, edge: Column | None = None) -> Graph:
        """Vertices and edges that meet the conditions; edges need both ends."""
        edges = self.edges if edge is None else self.edges.where(edge)
        if vertex is None:
            return replace(self, edges=edges)
        kept = self.vertices.where(vertex)
        return replace(self, vertices=kept, edges=induced(edges, kept))

    def with_edges(self, edges: DataFrame) -> Graph:
        return replace(self, edges=edges)

    def with_vertices(self, vertices: DataFrame) -> Graph:
        return replace(self, vertices=vertices)

    def num_vertices(self) -> int:
        return self.vertices.count()

    def num_edges(self) -> int:
        return self.edges.count()

    def simple(self, weight: str | None = None) -> Graph:
        """Undirected, without loops or parallel edges; weights of merged edges add up."""
        pairs = self.edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "eid", *([weight] if weight else []))
        edges = pairs.groupBy("src", "dst").agg(F.min("eid").alias("eid"), *([F.sum(weight).alias(weight)] if weight else []))
        return Graph(self.vertices, edges, False)


def swapped(edges: DataFrame) -> DataFrame:
    """src and dst exchanged, at once."""
    return edges.select(*[F.col({"src": "dst", "dst": "src"}.get(c, c)).alias(c) for c in edges.columns])


def induced(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    ids = vertices.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(edges.columns)


def on_vertices(g: Graph, values: DataFrame, *names: str, default=0) -> DataFrame:
    """``values`` (id, names) for every vertex, ``default`` where there is none."""
    out = g.vertices.select("id").join(values, "id", "left")
    return out.select("id", *[F.coalesce(F.col(n), F.lit(default)).alias(n) if default is not None else F.col(n) for n in names])
