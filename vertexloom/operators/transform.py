"""Graph to graph, and generators."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vertexloom.functions.ordering import numbered
from vertexloom.graph import Graph, induced
from vertexloom.local import pairs as local_pairs


def line_graph(g: Graph) -> Graph:
    """A vertex for each edge. Directed: an edge from e to f if e ends where f begins. Undirected: pairs that share an end."""
    if g.directed:
        a = g.edges.select(F.col("eid").alias("src"), F.col("dst").alias("v"))
        b = g.edges.select(F.col("eid").alias("dst"), F.col("src").alias("v"))
        edges = a.join(b, "v").select("src", "dst")
    else:
        ends = g.edges.select("eid", F.explode(F.array("src", "dst")).alias("v"))
        edges = ends.toDF("src", "v").join(ends.toDF("dst", "v"), "v").where("src < dst").select("src", "dst")
    return Graph.from_edges(edges, g.edges.select(F.col("eid").alias("id")), g.directed)


def union(g: Graph, h: Graph, merge: DataFrame | None = None) -> Graph:
    """Both graphs; ids of ``h`` come after those of ``g``, but those in ``merge`` (id of h, into of g) become those."""
    off = F.lit((g.vertices.agg(F.max("id")).first()[0] or 0) + 1)
    e_off = F.lit((g.edges.agg(F.max("eid")).first()[0] or 0) + 1)
    ids = h.vertices.select("id")
    ids = ids.select("id", (F.col("id") + off).alias("new")) if merge is None else ids.join(merge.select("id", "into"), "id", "left").select("id", F.coalesce("into", F.col("id") + off).alias("new"))
    edges = h.edges.join(ids.toDF("src", "s"), "src").join(ids.toDF("dst", "d"), "dst")
    edges = edges.select((F.col("eid") + e_off).alias("eid"), F.col("s").alias("src"), F.col("d").alias("dst"), *[c for c in h.edges.columns if c not in ("eid", "src", "dst")])
    own = h.vertices.join(ids, "id").drop("id").withColumnRenamed("new", "id")
    added = own.join(g.vertices.select("id"), "id", "left_anti")
    return Graph(g.vertices.unionByName(added, allowMissingColumns=True), g.edges.unionByName(edges, allowMissingColumns=True), g.directed)


def predecessor_tree(pred: DataFrame) -> Graph:
    """Edges pred -> id of a predecessor map (id, pred), roots being their own."""
    edges = pred.where("pred is not null and pred <> id").select(F.col("pred").alias("src"), F.col("id").alias("dst"))
    return Graph.from_edges(edges, pred.select("id"), True)


def condensation(g: Graph, block: str, vweight: str | None = None, eweight: str | None = None, averages: list[str] = (), edge_averages: list[str] = (), self_loops: bool = True) -> Graph:
    """A vertex for each value of ``block``, with count (or weight) and weighted means; an edge for each pair that edges join."""
    vw = F.lit(1.0) if vweight is None else F.col(vweight).cast("double")
    ew = F.lit(1.0) if eweight is None else F.col(eweight).cast("double")
    v = g.vertices.withColumn("_w", vw)
    vertices = v.groupBy(F.col(block).alias("id")).agg(F.sum("_w").alias("count"), *[(F.sum(F.col(p) * F.col("_w")) / F.sum("_w")).alias(p) for p in averages])
    names = g.vertices.select("id", block)
    e = g.edges.withColumn("_w", ew).join(names.toDF("src", "bs"), "src").join(names.toDF("dst", "bd"), "dst")
    if not g.directed:
        e = e.withColumn("_b", F.least("bs", "bd")).withColumn("bd", F.greatest("bs", "bd")).withColumn("bs", F.col("_b"))
    if not self_loops:
        e = e.where("bs <> bd")
    edges = e.groupBy(F.col("bs").alias("src"), F.col("bd").alias("dst")).agg(F.sum("_w").alias("count"), *[(F.sum(F.col(p) * F.col("_w")) / F.sum("_w")).alias(p) for p in edge_averages], F.min("eid").alias("eid"))
    return Graph.from_edges(edges, vertices, g.directed)


def copy(g: Graph, vertex: Column | None = None, edge: Column | None = None, order: str | None = None) -> Graph:
    """A pruned copy, with vertices renumbered densely by ``order`` if given (old ids stay as ``old_id``)."""
    g = g.view(vertex, edge)
    if order is None:
        return g
    new = numbered(g.vertices.withColumnRenamed("id", "old_id"), [order if order != "id" else "old_id", "old_id"], "id")
    ids = new.select("old_id", "id")
    edges = g.edges.join(ids.toDF("src", "s"), "src").join(ids.toDF("dst", "d"), "dst").drop("src", "dst").withColumnsRenamed({"s": "src", "d": "dst"})
    return Graph(new, edges.select(g.edges.columns), g.directed)


def half_edges(g: Graph) -> Graph:
    """Every edge's ends as two vertices (node is the old one), joined by it."""
    v = g.edges.select(F.explode(F.array(F.struct((F.col("eid") * 2).alias("id"), F.col("src").alias("node")), F.struct((F.col("eid") * 2 + 1).alias("id"), F.col("dst").alias("node")))).alias("x")).select("x.*")
    return Graph(v, g.edges.select("eid", (F.col("eid") * 2).alias("src"), (F.col("eid") * 2 + 1).alias("dst")), g.directed)


def augmented(g: Graph, blocks: DataFrame) -> Graph:
    """Vertices split by the block of the half-edge at each end; ``blocks`` has (id, block) over half-edge vertices."""
    h = half_edges(g)
    named = h.vertices.join(blocks, "id").withColumn("key", F.struct("node", "block"))
    ids = numbered(named.select("node", "block").distinct(), ["node", "block"], "new")
    at = named.join(ids, ["node", "block"]).select(F.col("id").alias("h"), "new")
    e = h.edges.join(at.toDF("src", "s"), "src").join(at.toDF("dst", "d"), "dst").select("eid", F.col("s").alias("src"), F.col("d").alias("dst"))
    return Graph(ids.withColumnRenamed("new", "id"), e, g.directed)


def block_gradient(g: Graph, vector: str) -> DataFrame:
    """eid and both ends' block vectors normalised to sum 1."""
    v = g.vertices.withColumn("_s", F.aggregate(vector, F.lit(0.0), lambda a, x: a + x)).select("id", F.transform(vector, lambda x: x / F.col("_s")).alias("p"))
    return g.edges.join(v.toDF("src", "source"), "src").join(v.toDF("dst", "target"), "dst").select("eid", "source", "target")


def lattice(spark: SparkSession, shape: list[int], periodic: bool = False) -> Graph:
    """A grid; index is mixed-radix with the first dimension fastest. Undirected."""
    n = math.prod(shape)
    v = spark.range(n)
    steps, stride = [], 1
    for size in shape:
        at = F.floor(F.col("id") / stride) % size
        inside, wrap = F.col("id") + stride, F.col("id") - stride * (size - 1)
        if periodic and size > 2:
            to = F.when(at < size - 1, inside).otherwise(wrap)
        else:
            to = F.when(at < size - 1, inside)
        steps.append(to.cast("long"))
        stride *= size
    edges = v.select(F.col("id").alias("src"), F.posexplode(F.array(*steps)).alias("d", "dst")).where("dst is not null").select((F.col("src") * len(shape) + F.col("d")).alias("eid"), "src", "dst")
    return Graph(v, edges, False)


def complete_graph(spark: SparkSession, n: int, self_loops: bool = False, directed: bool = False) -> Graph:
    v = spark.range(n)
    pairs = v.select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("dst"))
    keep = (F.col("src") != F.col("dst")) if directed else F.col("src") < F.col("dst")
    pairs = pairs.where(keep | (F.col("src") == F.col("dst")) if self_loops else keep)
    return Graph(v, pairs.select((F.col("src") * n + F.col("dst")).alias("eid"), "src", "dst"), directed)


def circular_graph(spark: SparkSession, n: int, k: int = 1, self_loops: bool = False, directed: bool = False) -> Graph:
    """Every vertex to its k nearest on a ring (both sides if directed)."""
    v = spark.range(n)
    steps = list(range(0 if self_loops else 1, k + 1)) + ([-s for s in range(1, k + 1)] if directed else [])
    e = v.select(F.col("id").alias("src"), F.posexplode(F.array(*[F.lit(s) for s in steps])).alias("p", "s"))
    return Graph(v, e.select((F.col("src") * len(steps) + F.col("p")).alias("eid"), "src", F.pmod(F.col("src") + F.col("s"), F.lit(n)).alias("dst")), directed)


def geometric_graph(points: DataFrame, radius: float, coordinates: list[str], box: list[tuple[float, float]] | None = None) -> Graph:
    """Undirected pairs of points (id and up to three coordinates) within ``radius``, on a torus if ``box`` is given.

    Cells of side ``radius``: a point meets only those of its own and the adjacent cells, in an equi-join on the cell.
    """
    if not 1 <= len(coordinates) <= 3:
        raise ValueError("one to three coordinates")
    cells = [F.floor((F.col(c) - F.lit(box[k][0] if box else 0.0)) / radius) for k, c in enumerate(coordinates)]
    counts = [max(1, math.floor((b - a) / radius)) for a, b in box] if box else None
    if box:
        cells = [F.pmod(F.least(c, F.lit(n - 1)), F.lit(n)) for c, n in zip(cells, counts, strict=True)]
    home = points.select("id", *coordinates, *[c.alias(f"_c{k}") for k, c in enumerate(cells)])
    near = home
    for k in range(len(coordinates)):
        near = near.withColumn(f"_c{k}", F.explode(F.array(*[F.col(f"_c{k}") + s for s in (-1, 0, 1)])))
        if box:
            near = near.withColumn(f"_c{k}", F.pmod(f"_c{k}", F.lit(counts[k])))
    keys = [f"_c{k}" for k in range(len(coordinates))]
    if box:
        near = near.distinct()
    other = near.withColumnsRenamed({"id": "dst", **{c: f"_{c}" for c in coordinates}})
    d2 = F.lit(0.0)
    for k, c in enumerate(coordinates):
        d = F.abs(F.col(c) - F.col(f"_{c}"))
        if box:
            d = F.least(d, F.lit(box[k][1] - box[k][0]) - d)
        d2 = d2 + d * d
    pairs = home.withColumnRenamed("id", "src").join(other, keys).where((F.col("src") < F.col("dst")) & (F.sqrt(d2) <= radius)).select("src", "dst")
    return Graph.from_edges(pairs, points.select("id", *coordinates), False)


def random_graph(spark: SparkSession, degrees: DataFrame, directed: bool = True, seed: int = 0, parallel_edges: bool = True, self_loops: bool = True, at_most: int = 50) -> Graph:
    """Configuration model from (id, k_out, k_in) (undirected: k_out alone): stubs are numbered, those of one side in hashed
    order, and equal numbers meet. Where loops or parallel edges are not allowed, rounds of rewiring swap them away; if
    ``at_most`` rounds leave some, as where the degrees admit no other graph, that is an error."""
    from vertexloom.plans.iterate import cut

    def stubs(column: str, salt: int) -> DataFrame:
        s = degrees.where(F.col(column) > 0).select("id", F.explode(F.sequence(F.lit(1), F.col(column).cast("int"))).alias("k"))
        return numbered(s.withColumn("h", F.xxhash64("id", "k", F.lit(seed), F.lit(salt))), ["h", "id", "k"], "n").select("n", "id")

    if directed:
        edges = stubs("k_out", 1).withColumnRenamed("id", "src").join(stubs("k_in", 2).withColumnRenamed("id", "dst"), "n").select(F.col("n").alias("eid"), "src", "dst")
    else:
        s = stubs("k_out", 1).withColumn("eid", F.floor(F.col("n") / 2))
        edges = s.groupBy("eid").agg(F.min_by("id", "n").alias("src"), F.max_by("id", "n").alias("dst"), F.count(F.lit(1)).alias("c")).where("c = 2").select("eid", "src", "dst")
    g = Graph(degrees.select("id"), edges, directed)
    pair = ["src", "dst"] if directed else [F.least("src", "dst"), F.greatest("src", "dst")]
    for n in range(at_most if not (parallel_edges and self_loops) else 0):
        g = g.with_edges(cut(g.edges))
        bad = (not self_loops and not g.edges.where("src = dst").isEmpty()) or (not parallel_edges and not g.edges.groupBy(*pair).count().where("count > 1").isEmpty())
        if not bad:
            return g
        g = random_rewire(g, rounds=1, parallel_edges=parallel_edges, self_loops=self_loops, seed=seed + 1 + n)
    if not (parallel_edges and self_loops):
        raise ValueError("loops or parallel edges are left")
    return g


def random_rewire(g: Graph, model: str = "uncorrelated", rounds: int = 1, parallel_edges: bool = False, self_loops: bool = False, block: str | None = None, seed: int = 0, probability: DataFrame | None = None) -> Graph:
    """Rewired graph of the same size. A round pairs edges at random (within classes of their targets if the model is correlated)
    and swaps the targets of all pairs at once, where that makes no loop, or parallel edge (also between swaps), unless allowed.

    Models: erdos (uniform ends), uncorrelated (keeps degrees), correlated (keeps degrees and, for each edge, the degree class of its target, or
    its ``block``), probabilistic or blockmodel (keeps degrees; a swap passes with the ratio of its edges' ``probability``, a
    table of r, s and p over values of ``block``), blockmodel-traditional (blocks drawn by p, uniform ends within them).
    """
    from vertexloom.operators.degree import degree
    from vertexloom.plans.iterate import cut

    if model == "erdos":
        n = g.num_vertices()
        ids = numbered(g.vertices.select("id"), ["id"], "n")
        pick = g.edges.select("eid", F.pmod(F.xxhash64("eid", F.lit(seed)), F.lit(n)).alias("a"), F.pmod(F.xxhash64("eid", F.lit(seed + 1)), F.lit(n if self_loops else max(n - 1, 1))).alias("b"))
        b = F.col("b") if self_loops else F.when(F.col("b") >= F.col("a"), F.col("b") + 1).otherwise(F.col("b"))
        e = pick.withColumn("b", b).join(ids.toDF("src", "a"), "a").join(ids.toDF("dst", "b"), "b").select("eid", "src", "dst")
        return g.with_edges(e)
    if model == "blockmodel-traditional":
        return g.with_edges(_by_blocks(g, block, probability, seed))
    if model not in ("uncorrelated", "correlated", "probabilistic", "blockmodel"):
        raise ValueError(f"unknown model {model}")
    weighed = model in ("probabilistic", "blockmodel")
    edges = cut(g.edges.select("eid", "src", "dst"))
    if model == "correlated":
        kinds = g.vertices.select("id", F.col(block).alias("k")) if block else degree(g, "total", name="_t").join(degree(g, "in", name="_i"), "id").select("id", F.struct("_t", "_i").alias("k"))
        kinds = cut(kinds)
    if weighed:
        kinds = cut(g.vertices.select("id", F.col(block).alias("k")))
    for r in range(rounds):
        e = edges.withColumn("h", F.xxhash64("eid", F.lit(seed), F.lit(r)))
        e = e.join(kinds.withColumnRenamed("id", "dst"), "dst") if model == "correlated" else e.withColumn("k", F.lit(0))
        order = numbered(e.select("eid", "src", "dst", "k", "h"), ["k", "h", "eid"], "n").withColumn("p", F.floor(F.col("n") / 2))
        first = F.col("n") % 2 == 0
        ends = [F.max(F.when(first if side == "x" else ~first, F.col(c))).alias(f"{side}_{c}") for side in "xy" for c in ("eid", "src", "dst")]  # plain numbers, which hash aggregation keeps
        meet = F.count(F.lit(1)) == 2 if model != "correlated" else (F.count(F.lit(1)) == 2) & (F.min_by("k", "n") == F.max_by("k", "n"))
        two = cut(order.groupBy("p").agg(*ends, meet.alias("meet")))

        old, swapped = (F.array(*[F.struct(F.col(f"{s}_eid").alias("eid"), F.col(f"{s}_src").alias("src"), F.col(f"{t}_dst").alias("dst")) for s, t in sides]) for sides in (("xx", "yy"), ("xy", "yx")))
        new = two.where("meet").select("p", F.explode(swapped).alias("e")).select("p", "e.*")
        bad = new.limit(0).select("p")
        if not self_loops:
            bad = bad.union(new.where("src = dst").select("p"))
        if not parallel_edges:
            key = ["src", "dst"] if g.directed else [F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")]
            made = new.select("p", *key)
            every = made.select("src", "dst", F.lit(1).alias("new")).union(edges.select(*key, F.lit(0)))
            taken = every.groupBy("src", "dst").agg(F.sum("new").alias("c"), F.count(F.lit(1)).alias("all")).where("c > 1 or (c = 1 and all > 1)")
            bad = bad.union(made.join(taken, ["src", "dst"], "left_semi").select("p"))
        if weighed:
            moves = two.where("meet").select("p", F.explode(old).alias("e")).select("p", "e.src", "e.dst", F.lit(-1.0).alias("sign")).unionByName(new.select("p", "src", "dst", F.lit(1.0).alias("sign")))
            at = moves.join(kinds.toDF("src", "r"), "src").join(kinds.toDF("dst", "s"), "dst").join(probability.select("r", "s", F.col("p").alias("q")), ["r", "s"], "left")
            gain = at.groupBy("p").agg(F.sum(F.col("sign") * F.log(F.greatest(F.coalesce("q", F.lit(0.0)), F.lit(1e-12)))).alias("gain"))
            u = (F.pmod(F.xxhash64("p", F.lit(seed), F.lit(-1 - r)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
            bad = bad.union(gain.where(F.log(u) >= F.col("gain")).select("p"))
        stays = two.join(bad.distinct().withColumn("bad", F.lit(True)), "p", "left")
        edges = cut(stays.select(F.explode(F.when(F.col("meet") & F.col("bad").isNull(), swapped).otherwise(old)).alias("e")).select("e.*").where("eid is not null"))
    return g.with_edges(edges)


def _by_blocks(g: Graph, block: str, probability: DataFrame, seed: int) -> DataFrame:
    """eid, src and dst of as many edges as ``g`` has: a pair of blocks by its weight, then an end of each by hash."""
    from vertexloom.plans.iterate import cut

    pairs = cut(numbered(probability.where("p > 0").select("r", "s", "p"), ["r", "s"], "id"))
    drawn = sample(pairs.select("id", F.col("p").alias("weight")), g.num_edges(), seed).join(pairs.drop("p"), "id")
    places = cut(numbered(g.vertices.select("id", F.col(block).alias("b")), ["b", "id"], "n"))
    spans = cut(places.groupBy("b").agg(F.min("n").alias("low"), F.count(F.lit(1)).alias("size")))
    out = cut(numbered(g.edges.select("eid"), ["eid"], "draw")).join(drawn, "draw")
    for key, end, salt in (("r", "src", 1), ("s", "dst", 2)):
        out = out.join(spans.withColumnRenamed("b", key), key).withColumn("n", F.col("low") + F.pmod(F.xxhash64("eid", F.lit(seed), F.lit(salt)), F.col("size"))).drop("low", "size")
        out = out.join(places.select("n", F.col("id").alias(end)), "n").drop("n")
    return out.select("eid", "src", "dst")


def coarse(g: Graph, method: str = "matching", weight: str | None = None, seed: int = 0) -> tuple[Graph, DataFrame]:
    """A smaller graph and (id, block): ends of a greedy matching are one vertex, or (independent) every vertex joins the
    smallest neighbour in a maximal independent set. Vertex and edge ``count`` hold what was merged."""
    from vertexloom.operators.components import greedy_matching, independent_set
    from vertexloom.plans.iterate import cut

    if method == "matching":
        pairs = g.edges.join(greedy_matching(g, weight, seed=seed, held=0), "eid", "left_semi").select(F.explode(F.array("src", "dst")).alias("id"), F.least("src", "dst").alias("b"))
    elif method == "independent":
        centres = cut(independent_set(g, seed))
        pairs = g.as_undirected().adjacency.where("src <> dst").join(centres.toDF("dst"), "dst", "left_semi").groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("b"))
    else:
        raise ValueError(f"unknown method {method}")
    blocks = cut(g.vertices.select("id").join(pairs, "id", "left").select("id", F.coalesce("b", "id").alias("block")))
    v = g.vertices.drop("block").join(blocks, "id")
    vweight, eweight = ("count" if "count" in x.columns else None for x in (g.vertices, g.edges))
    out = condensation(Graph(v, g.edges, g.directed), "block", vweight, eweight, self_loops=False)
    return Graph(cut(out.vertices), cut(out.edges), g.directed), blocks


def coarse_stack(g: Graph, method: str = "matching", least: int = 64, weight: str | None = None, seed: int = 0, held: int | None = None) -> list[tuple[Graph, DataFrame]]:
    """Coarser and coarser graphs, until ``least`` vertices are left or a level merges less than a tenth of them, as it
    does where a matching meets stars. Tasks match all levels of weak components of up to ``held`` rows; edges of their coarse
    graphs are merged from those of the level before, where they are read."""
    from vertexloom.operators.components import MATCH_HELD

    out, n = [], g.num_vertices()
    if n <= least:
        return out
    small, large, sizes = None, g, {}
    if method == "matching":
        most = 2 + math.ceil(math.log(n / max(least, 1)) / -math.log(0.9))  # levels, each of which merges a tenth
        rows, large = _coarse_rows(g, weight, seed, most, MATCH_HELD if held is None else held)
        gone = dict(rows.where(F.size("levels") > 0).groupBy(F.col("levels")[0]).count().collect())
        small, of_small = g.with_edges(g.edges.join(rows.select(F.col("id").alias("src")), "src", "left_semi")), rows.count()
        sizes = {k: of_small - sum(c for at, c in gone.items() if at <= k) for k in range(most + 1)}
    while n > least:
        k, parts, m = len(out) + 1, [], 0
        if large is not None:
            parts.append(coarse(large, method, weight if not out else "count", seed + len(out)))
            m += parts[0][0].num_vertices()
        if small is not None:
            parts.append(_level(small, rows, k))
            m += sizes[k]
        if m < n:
            graphs, blocks = zip(*parts, strict=True)
            whole = graphs[0] if len(parts) == 1 else Graph(graphs[0].vertices.unionByName(graphs[1].vertices), graphs[0].edges.unionByName(graphs[1].edges), g.directed)
            out.append((whole, blocks[0] if len(parts) == 1 else blocks[0].unionByName(blocks[1])))
        if m > 0.9 * n:
            break
        n = m
        large = parts[0][0] if large is not None else None
        small = parts[-1][0] if small is not None else None
    return out


def _level(g: Graph, rows: DataFrame, k: int) -> tuple[Graph, DataFrame]:
    """The coarse graph of level ``k``, of which ``g`` is the one before, and (id, block), from the ``rows`` of all levels."""

    def at(level, levels, values, default):
        many = F.size(F.filter(levels, lambda x: x <= level))
        return F.when(many == 0, F.col(default)).otherwise(F.get(values, many - 1))

    vertices = rows.where(at(k, "levels", "blocks", "id") == F.col("id")).select("id", at(k, "since", "sizes", "size").alias("count"))
    blocks = rows.where(at(k - 1, "levels", "blocks", "id") == F.col("id")).select("id", at(k, "levels", "blocks", "id").alias("block"))
    return Graph(vertices, merged(g, blocks), g.directed), blocks


def merged(g: Graph, blocks: DataFrame) -> DataFrame:
    """Edges of the coarse graph that ``blocks`` (id, block) make of ``g``."""
    return condensation(Graph(blocks, g.edges, g.directed), "block", None, "count" if "count" in g.edges.columns else None, self_loops=False).edges


def _coarse_rows(g: Graph, weight: str | None, seed: int, most: int, held: int) -> tuple[DataFrame, Graph | None]:
    """id, size, the levels at which its block changes and these blocks, the levels since which it has a size as a block and
    these sizes, for each vertex of a component of at most ``held`` rows; and the graph of the other components."""
    from vertexloom.operators.components import dealt_by_component, weak_components
    from vertexloom.plans.iterate import cut

    ends = ("src", "dst") if g.directed else (F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    w = F.lit(0.0) if weight is None else -F.col(weight).cast("double")
    of = F.lit(1.0) if "count" not in g.edges.columns else F.col("count").cast("double")
    own = F.lit(1.0) if "count" not in g.vertices.columns else F.col("count").cast("double")
    e = g.edges.where("src <> dst").select(*ends, "eid", of.alias("c"), F.coalesce(w, F.lit(-math.inf)).alias("w"), F.xxhash64("eid", F.lit(seed)).alias("h"))
    plain = [F.lit(0.0).alias("w"), F.min("h").alias("h")] if weight is None else [F.min("w").alias("w"), F.min_by("h", F.struct("w", "h", "eid")).alias("h")]
    # of the edges of a pair the first one orders it; where two have the same hash, the least eid stands for that one too
    links = cut(e.groupBy("src", "dst").agg(F.min("eid").alias("eid"), F.sum("c").alias("size"), *plain))
    label = cut(weak_components(Graph(g.vertices, links, True)))
    every = g.vertices.select(F.col("id").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(None).cast("long").alias("eid"), F.coalesce(own, F.lit(0.0)).alias("size"), F.lit(0.0).alias("w"), F.lit(0).cast("long").alias("h")).unionByName(links)
    tasks, spread, large, over = dealt_by_component(cut(every.join(label.toDF("src", "label"), "src")), held)
    tasks = tasks.select("src", "dst", "eid", "size", "w", "h", "own", "key")
    directed = g.directed

    def run(table):
        col = {c: table.column(c).to_numpy() for c in ("src", "size", "w", "h")}
        lone = table.column("dst").is_null().to_numpy()
        order = np.argsort(col["src"][lone])
        ids, size = col["src"][lone][order], col["size"][lone][order]
        eid, dst = (table.column(c).filter(pa.array(~lone)).to_numpy() for c in ("eid", "dst"))
        links = {c: v[~lone] for c, v in col.items()}
        moved, grown = local_pairs.coarsened(ids, size, links["src"], dst, eid, links["size"], (links["w"], links["h"], eid), seed, directed, most)

        def listed(of, values, kind):
            offsets = np.searchsorted(of, np.arange(len(ids) + 1)).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(kind)))

        return pa.table({"id": ids, "size": size, "levels": listed(moved[0], moved[1], np.int32), "blocks": listed(moved[0], moved[2], np.int64), "since": listed(grown[0], grown[1], np.int32), "sizes": listed(grown[0], grown[2], np.float64)})

    rows = cut(tasks.repartition(spread, "own", "key").groupBy("own", "key").applyInArrow(run, "id long, size double, levels array<int>, blocks array<long>, since array<int>, sizes array<double>"))
    if not over:
        return rows, None
    rest = g.vertices.join(label.join(large, "label", "left_semi").select("id"), "id", "left_semi")
    return rows, Graph(rest, g.edges.join(rest.select(F.col("id").alias("src")), "src", "left_semi"), g.directed)


def sample(weights: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """draw and id of ``n`` draws from (id, weight): a cumulative sum, in blocks, and a range join on its bucketed steps."""
    from vertexloom.plans.iterate import cut

    w = cut(numbered(weights.where("weight > 0"), ["id"], "_n").withColumn("_b", F.floor(F.col("_n") / 65536)))
    blocks = w.groupBy("_b").agg(F.sum("weight").alias("_s"))
    total = blocks.agg(F.sum("_s")).first()[0] or 0.0
    before = blocks.select("_b", (F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_s")).alias("_o"))
    cum = F.sum("weight").over(Window.partitionBy("_b").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0))
    steps = w.withColumn("hi", cum).join(before, "_b").withColumn("hi", F.col("hi") + F.col("_o")).withColumn("lo", F.col("hi") - F.col("weight"))
    width = total / max(1, min(n, 1024))
    steps = steps.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    u = weights.sparkSession.range(n).select(F.col("id").alias("draw"), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52) * total).alias("u"))
    return u.withColumn("cell", F.floor(F.col("u") / width)).join(steps, "cell").where("u >= lo and u < hi").select("draw", "id")


def remove(g: Graph, vertices: DataFrame) -> Graph:
    kept = g.vertices.join(vertices.select("id"), "id", "left_anti")
    return Graph(kept, induced(g.edges, kept), g.directed)
