"""Components, reachability, cores, orders and trees by rounds over DataFrames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.graph import Graph
from vertexloom.local import pairs
from vertexloom.local.kernels import strong_labels
from vertexloom.plans.iterate import Rows, cut


def _stars(edges: DataFrame) -> DataFrame:
    """u, v: each node of ``edges`` (u > v) hangs on the smallest of its component; by large and small stars in turn, once
    every task has joined what hangs together among its own edges, those of a range of u."""
    state, mark = cut(_joined(edges.repartitionByRange("u", "v"))), None
    while True:
        digest = state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
        if digest == mark:
            return state
        mark = digest
        both = state.union(state.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        state = cut(large.join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(near).distinct())


def _joined(edges: DataFrame) -> DataFrame:
    """u and v: of each partition a star for each component of its edges; an array for each of its nodes is held."""

    def run(batches):
        u = v = np.zeros(0, np.int64)
        held, size = [], 0

        def joined():
            return pairs.stars(np.concatenate([u, *(b[0] for b in held)]), np.concatenate([v, *(b[1] for b in held)]))

        for batch in batches:
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v")])
            size += batch.num_rows
            if size > 1 << 20 and size > len(u):
                (u, v), held, size = joined(), [], 0
        u, v = joined()
        for k in range(0, len(u), 1 << 16):
            yield pa.RecordBatch.from_pydict({"u": u[k : k + (1 << 16)], "v": v[k : k + (1 << 16)]})

    return edges.select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(run, "u long, v long")


def weak_components(g: Graph) -> DataFrame:
    """id and label (the smallest id of the weakly connected component)."""
    e = g.edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    stars = _stars(e)
    return g.vertices.select("id").join(stars.withColumnRenamed("u", "id"), "id", "left").select("id", F.coalesce("v", "id").alias("label"))


def strong_components(g: Graph, at_most: int = 100_000) -> DataFrame:
    """id and label (the smallest id of the strongly connected component).

    A graph of ``at_most`` different edges is searched on the driver, once they are counted; of a larger one each weak component
    in a task, and those too large for that in rounds (all, if ``at_most`` is 0).

    Rounds of colouring: every vertex left takes the smallest id that reaches it; those that reach back within a colour
    form the component of the colour's root. Vertices without edges in or out among those left are trimmed first.
    """
    left, edges, done = cut(g.vertices.select("id")), cut(g.edges.where("src <> dst").select("src", "dst").distinct()), Rows()
    if edges.count() <= at_most:
        found = strong_labels([(r["src"], r["dst"]) for r in edges.collect()])
        labels = g.edges.sparkSession.createDataFrame(sorted(found.items()), "id long, label long")
        return left.join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("label"))
    if at_most:
        from vertexloom.operators.paths import by_component

        def run(rows, _):
            yield {"id": rows.ids, "label": rows.ids[pairs.strong(rows)]}

        labels, large = by_component(Graph(left, edges.withColumn("eid", F.lit(0)), True), run, "id long, label long", split=False)
        labels = labels if large is None else labels.union(strong_components(large, 0))
        return left.join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("label"))

    while not left.isEmpty():
        alone = left.join(edges.select(F.col("src").alias("id")), "id", "left_anti").union(left.join(edges.select(F.col("dst").alias("id")), "id", "left_anti")).distinct()
        alone = cut(alone)
        if not alone.isEmpty():
            done.add(alone.select("id", F.col("id").alias("label")))
            left = cut(left.join(alone, "id", "left_anti"))
            edges = cut(edges.join(alone.withColumnRenamed("id", "src"), "src", "left_anti").join(alone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"))
            continue
        colour = _spread(left.select("id", F.col("id").alias("c")), edges)
        inside = edges.join(colour.withColumnsRenamed({"id": "src", "c": "cs"}), "src").join(colour.withColumnsRenamed({"id": "dst", "c": "cd"}), "dst").where("cs = cd").select("src", "dst")
        inside = cut(inside)
        back = reach(colour.where("id = c").select("id"), inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        found = cut(colour.join(back, "id", "left_semi"))
        done.add(found.select("id", F.col("c").alias("label")))
        left = cut(left.join(found, "id", "left_anti"))
        edges = cut(edges.join(found.select(F.col("id").alias("src")), "src", "left_anti").join(found.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst"))
    found = done.all()
    return left.select("id", F.col("id").alias("label")) if found is None else found


def _spread(state: DataFrame, edges: DataFrame) -> DataFrame:
    """The smallest c over everything that reaches a vertex; only changed vertices send."""
    state = cut(state)
    changed = state
    while not changed.isEmpty():
        got = changed.join(edges.withColumnRenamed("src", "id"), "id").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("n"))
        new = cut(state.join(got, "id", "left").select("id", F.least("c", "n").alias("c"), (F.col("n") < F.col("c")).alias("less")))
        changed = new.where("less").select("id", "c")
        state = new.select("id", "c")
    return state


def reach(start: DataFrame, edges: DataFrame) -> DataFrame:
    """ids that can be reached from ``start`` (id) along ``edges`` (src, dst), start included."""
    seen = cut(start.select("id").distinct())
    front = seen
    while True:
        front = cut(front.join(edges.withColumnRenamed("src", "id"), "id").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti"))
        if front.isEmpty():
            return seen
        seen = cut(seen.union(front))


def label_components(g: Graph, directed: bool | None = None) -> DataFrame:
    return strong_components(g) if (g.directed if directed is None else directed) else weak_components(g)


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))


def attractors(g: Graph, labels: DataFrame) -> DataFrame:
    """label and is_attractor: no edge leaves the component."""
    e = g.edges.join(labels.withColumnsRenamed({"id": "src", "label": "ls"}), "src").join(labels.withColumnsRenamed({"id": "dst", "label": "ld"}), "dst")
    leaving = e.where("ls <> ld").select(F.col("ls").alias("label"), F.lit(False).alias("stays")).distinct()
    return labels.select("label").distinct().join(leaving, "label", "left").select("label", F.coalesce("stays", F.lit(True)).alias("is_attractor"))


def largest_component(g: Graph, directed: bool | None = None) -> DataFrame:
    """id and in_largest; of equal components the one with the smallest label."""
    labels = cut(label_components(g, directed))
    best = component_sizes(labels).agg(F.min_by("label", F.struct(-F.col("size"), "label")).alias("best"))
    return labels.join(F.broadcast(best)).select("id", (F.col("label") == F.col("best")).alias("in_largest"))


def out_component(g: Graph, root: int) -> DataFrame:
    """id and reachable from root."""
    seen = reach(g.vertices.where(F.col("id") == root).select("id"), g.adjacency.select("src", "dst").distinct()).withColumn("r", F.lit(True))
    return g.vertices.select("id").join(seen, "id", "left").select("id", F.coalesce("r", F.lit(False)).alias("reachable"))


def kcore(g: Graph, kind: str = "total") -> DataFrame:
    """id and core number by peeling: all vertices of degree k or less go in rounds, then k grows to the least degree left.

    ``kind`` is the degree of a directed graph that counts; parallel edges count, loops don't.
    """
    a = cut((g.adjacency if not g.directed or kind != "total" else g.as_undirected().adjacency).where("src <> dst").select("src", "dst"))
    key, other = ("dst", "src") if g.directed and kind == "in" else ("src", "dst")
    state = cut(g.vertices.select("id").join(a.groupBy(F.col(key).alias("id")).count(), "id", "left").select("id", F.coalesce("count", F.lit(0)).alias("k")))
    done, level = Rows(), 0
    while True:
        least = state.agg(F.min("k")).first()[0]
        if least is None:
            found = done.all()
            return found if found is not None else state.select("id", F.col("k").alias("core"))
        level = max(level, least)
        gone = state.where(F.col("k") <= level).select("id", F.lit(level).cast("long").alias("core"))
        done.add(gone)
        lost = a.join(gone.select(F.col("id").alias(other)), other).groupBy(F.col(key).alias("id")).count()
        state = cut(state.where(F.col("k") > level).join(lost, "id", "left").select("id", (F.col("k") - F.coalesce("count", F.lit(0))).alias("k")))


def topological_levels(g: Graph) -> DataFrame | None:
    """id and level (longest path from a source) by peeling vertices without in-edges; None if there is a cycle."""
    left, edges, done, level = cut(g.vertices.select("id")), cut(g.edges.select("src", "dst")), Rows(), 0
    while not left.isEmpty():
        free = cut(left.join(edges.select(F.col("dst").alias("id")), "id", "left_anti"))
        if free.isEmpty():
            return None
        done.add(free.select("id", F.lit(level).alias("level")))
        left = cut(left.join(free, "id", "left_anti"))
        edges = cut(edges.join(free.withColumnRenamed("id", "src"), "src", "left_anti").select("src", "dst"))
        level += 1
    return done.all() if level else left.select("id", F.lit(0).alias("level"))


def is_dag(g: Graph) -> bool:
    return topological_levels(g) is not None


def transitive_closure(g: Graph, held: int | None = None) -> DataFrame:
    """src and dst of every pair with a path of one edge or more. A task lists the pairs from some vertices of one weak component;
    components too large for that go by squaring, where path lengths double in a round."""
    from vertexloom.operators.paths import HELD, by_component

    def run(rows, roots):
        for src, dst in pairs.closure(rows, roots):
            yield {"src": rows.ids[src], "dst": rows.ids[dst]}

    out, large = by_component(g, run, "src long, dst long", HELD if held is None else held)
    loops = cut(g.edges.where("src = dst").select("src", "dst").distinct())
    if not loops.isEmpty():
        out = out.join(loops, ["src", "dst"], "left_anti").union(loops)
    if large is None:
        return out
    seen = cut(large.edges.select("src", "dst").distinct())
    while True:
        new = seen.join(seen.toDF("dst", "end"), "dst").select("src", F.col("end").alias("dst")).distinct().join(seen, ["src", "dst"], "left_anti")
        new = cut(new)
        if new.isEmpty():
            return out.union(seen.join(loops, ["src", "dst"], "left_anti"))
        seen = cut(seen.union(new))


def bipartite(g: Graph) -> tuple[bool, DataFrame]:
    """Whether the undirected graph has a two-colouring and (id, side), all 0 if it has none.

    Components of the double cover (each vertex in two copies, edges between unlike ones): a vertex joined to its own copy
    is on an odd cycle.
    """
    e = g.edges.select("src", "dst")
    two = e.select(F.explode(F.array(F.struct((F.col("src") * 2).alias("a"), (F.col("dst") * 2 + 1).alias("b")), F.struct((F.col("src") * 2 + 1).alias("a"), (F.col("dst") * 2).alias("b")))).alias("x"))
    roots = cut(_stars(two.select(F.greatest("x.a", "x.b").alias("u"), F.least("x.a", "x.b").alias("v")).where("u <> v")))
    copies = g.vertices.select(F.explode(F.array(F.col("id") * 2, F.col("id") * 2 + 1)).alias("u")).join(roots, "u", "left").select("u", F.coalesce("v", "u").alias("v"))
    sides = cut(copies.groupBy(F.floor(F.col("u") / 2).alias("id")).agg(F.min_by("v", "u").alias("even"), F.max_by("v", "u").alias("odd")))
    ok = sides.where("even = odd").isEmpty() and g.edges.where("src = dst").isEmpty()
    return ok, sides.select("id", (F.when(F.col("even") < F.col("odd"), 0).otherwise(1) if ok else F.lit(0)).alias("side"))


def min_spanning_forest(g: Graph, weight: str | None = None, root: int | None = None) -> DataFrame:
    """eid of a minimum spanning forest (ties by eid), by rounds in which every component takes its lightest edge out; with a
    ``root``, of the tree that holds it."""
    if root is not None:
        inside = reach(g.vertices.where(F.col("id") == root).select("id"), g.as_undirected().adjacency.select("src", "dst").distinct())
        return min_spanning_forest(g.with_edges(g.edges.join(inside.withColumnRenamed("id", "src"), "src", "left_semi")), weight)
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    edges = cut(g.edges.where("src <> dst").select("eid", F.col("src").alias("a"), F.col("dst").alias("b"), w.alias("w")))
    tree = None
    while not edges.isEmpty():
        ends = edges.select(F.explode(F.array("a", "b")).alias("c"), F.struct("w", "eid").alias("k"), "eid", "a", "b")
        best = cut(ends.groupBy("c").agg(F.min_by(F.struct("eid", "a", "b"), "k").alias("e")).select("e.*").distinct())
        tree = cut(best.select("eid") if tree is None else tree.union(best.select("eid")).distinct())
        roots = _stars(best.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
        on_a, on_b = roots.toDF("a", "ra"), roots.toDF("b", "rb")
        edges = cut(edges.join(on_a, "a", "left").join(on_b, "b", "left").select("eid", F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"), "w").where("a <> b"))
    return tree if tree is not None else edges.select("eid")


def reciprocity(g: Graph) -> DataFrame:
    """reciprocity: the share of edges whose reverse exists; a loop is its own."""
    back = g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct().withColumn("back", F.lit(1.0))
    return g.edges.join(back, ["src", "dst"], "left").agg((F.coalesce(F.sum("back"), F.lit(0.0)) / F.count(F.lit(1))).alias("reciprocity"))


def similarity(g: Graph, h: Graph, label: str = "id", norm: bool = True, other_label: str | None = None) -> DataFrame:
    """similarity: what the multisets of neighbour labels have in common over vertices of equal label, over the larger number of edges."""

    def ends(x: Graph, label: str) -> DataFrame:
        names = x.vertices.select(F.col("id").alias("_v"), F.col(label).alias("_l"))
        e = x.adjacency.select("src", "dst").join(names.toDF("src", "ls"), "src").join(names.toDF("dst", "ld"), "dst")
        return e.groupBy("ls", "ld").count()

    both = ends(g, label).join(ends(h, other_label or label).withColumnRenamed("count", "other"), ["ls", "ld"])
    s = both.agg((F.coalesce(F.sum(F.least("count", "other")), F.lit(0)) * (1.0 if g.directed else 0.5)).alias("s"))
    sizes = g.edges.agg(F.count(F.lit(1)).alias("n1")).join(h.edges.agg(F.count(F.lit(1)).alias("n2")))
    return s.join(sizes).select((F.col("s") / (F.greatest("n1", "n2") if norm else F.lit(1))).alias("similarity"))


def independent_set(g: Graph, seed: int = 0, high_degree: bool = False) -> DataFrame:
    """id of a maximal independent set: rounds in which vertices of locally smallest hash (or degree first) join."""
    a = cut(g.simple().adjacency.select("src", "dst"))
    k = g.vertices.select("id").join(a.groupBy(F.col("src").alias("id")).count(), "id", "left").select("id", F.coalesce("count", F.lit(0)).alias("k"))
    order = -F.col("k") if high_degree else F.lit(0)
    left = cut(k.select("id", F.struct(order.alias("o"), F.xxhash64("id", F.lit(seed)).alias("h"), "id").alias("p")))
    chosen = None
    while not left.isEmpty():
        near = a.join(left.select(F.col("id").alias("dst"), "p"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("p").alias("q"))
        won = cut(left.join(near, "id", "left").where("q is null or p < q").select("id"))
        chosen = cut(won if chosen is None else chosen.union(won))
        hit = a.join(won.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"))
        left = cut(left.join(won.union(hit).distinct(), "id", "left_anti"))
    return chosen if chosen is not None else left.select("id")


def colouring(g: Graph, seed: int = 0, held: int | None = None) -> DataFrame:
    """id and color of a proper colouring: independent sets are taken off one after the other. In the order of hashes that gives
    each vertex the first colour that no neighbour before it has, which a task finds for a weak component; components too
    large for that go by sets, in rounds."""
    from vertexloom.graph import induced
    from vertexloom.operators.paths import HELD, by_component

    def run(rows, _):
        yield {"id": rows.ids, "color": pairs.first_fit(rows).astype(np.int32)}

    done, left = by_component(g.simple(), run, "id long, color int", HELD if held is None else held, F.first(F.xxhash64("src", F.lit(seed))), split=False)
    done = g.vertices.select("id").join(done if left is None else done.union(left.vertices.select("id", F.lit(-1))), "id", "left").select("id", F.coalesce("color", F.lit(0)).alias("color"))
    if left is None:
        return done
    done, colour = cut(done.where("color >= 0")), 0
    while not left.vertices.isEmpty():
        layer = independent_set(left, seed).select("id", F.lit(colour).alias("color"))
        done = cut(done.unionByName(layer))
        rest = cut(left.vertices.join(layer, "id", "left_anti"))
        left = Graph(rest, cut(induced(left.edges, rest)), g.directed)
        colour += 1
    return done


#: Rows (pairs of neighbours, and vertices where they are sent) of a component that one task matches.
MATCH_HELD = 4_000_000


def dealt_by_component(rows: DataFrame, held: int) -> tuple[DataFrame, int, DataFrame, bool]:
    """``rows`` (with label) of components of at most ``held`` rows with the keys own and key of the task of each, in which small ones
    share tasks; the number of partitions for them; the labels of larger components, and whether there are any."""
    many = cut(rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")))
    fits, small = F.col("n") <= held, F.col("n") <= 1 << 16
    alone, crowd, over = many.agg(F.count_if(fits & ~small), F.sum(F.when(fits & small, F.col("n"))), F.count_if(~fits)).first()
    bins = 1 + (crowd or 0) // (1 << 18)
    key = F.when(small, F.pmod(F.xxhash64("label"), F.lit(bins))).otherwise(F.col("label"))
    tasks = rows.join(many.where(fits).select("label", (~small).alias("own"), key.alias("key")), "label")
    return tasks, min(480, 8 * (alone + bins)), many.where(~fits).select("label"), over > 0


def greedy_matching(g: Graph, weight: str | None = None, minimize: bool = False, seed: int = 0, held: int | None = None) -> DataFrame:
    """eid of a maximal matching: rounds in which edges that are first at both ends (by weight, then hash) are taken. That takes
    edges in this order where both ends are free, which a task does for weak components of up to ``held`` pairs; larger ones go
    by rounds over DataFrames."""
    w = F.lit(0.0) if weight is None else F.col(weight).cast("double") * (1 if minimize else -1)
    left = cut(g.edges.where("src <> dst").select("src", "dst", F.struct(w.alias("w"), F.xxhash64("eid", F.lit(seed)).alias("h"), "eid").alias("p")))
    held = MATCH_HELD if held is None else held
    if held <= 0:
        return _matched_by_rounds(g, left)
    first = cut(left.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("p").alias("p")))
    label = cut(weak_components(Graph(g.vertices, first, False)))
    tasks, spread, large, over = dealt_by_component(first.join(label.toDF("src", "label"), "src"), held)

    def run(table):
        src, dst, w, h, eid = (table.column(c).to_numpy() for c in ("src", "dst", "w", "h", "eid"))
        order = np.lexsort((eid, h, w))
        ids, at = np.unique(np.concatenate([src[order], dst[order]]), return_inverse=True)
        return pa.table({"eid": eid[order][pairs.matched(at[: len(src)], at[len(src) :], len(ids))]})

    rows = tasks.select("own", "key", "src", "dst", F.coalesce("p.w", F.lit(float("-inf"))).alias("w"), "p.h", "p.eid")
    done = cut(rows.repartition(spread, "own", "key").groupBy("own", "key").applyInArrow(run, "eid long"))
    if not over:
        return done
    rest = label.join(large, "label", "left_semi").select(F.col("id").alias("src"))
    return done.union(_matched_by_rounds(g, cut(left.join(rest, "src", "left_semi").select("src", "dst", "p"))))


def _matched_by_rounds(g: Graph, left: DataFrame) -> DataFrame:
    done = None
    while not left.isEmpty():
        first = left.select(F.explode(F.array("src", "dst")).alias("id"), "p").groupBy("id").agg(F.min("p").alias("f"))
        won = left.join(first.toDF("src", "fs"), "src").join(first.toDF("dst", "fd"), "dst").where("p = fs and p = fd").select("src", "dst", F.col("p.eid").alias("eid"))
        won = cut(won)
        done = cut(won.select("eid") if done is None else done.union(won.select("eid")))
        used = won.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        left = cut(left.join(used.toDF("src"), "src", "left_anti").join(used.toDF("dst"), "dst", "left_anti").select("src", "dst", "p"))
    return done if done is not None else g.edges.select("eid").limit(0)
