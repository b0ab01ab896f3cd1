"""Small graphs whose results are known by hand, file formats, local kernels and streams."""

import gzip
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vertexloom.functions.bins import Bins
from vertexloom.functions.special import average_degree_limit, lbinom, max_blocks, partition_entropy
from vertexloom.graph import Graph
from vertexloom.local import kernels
from vertexloom.local.kernels import Local
from vertexloom.operators import centrality, clustering, community, components, correlations, degree, flow, layout, paths, spectral, stats, transform
from vertexloom.sources import datasets, formats
from vertexloom.streaming.degrees import degree_stream

NAMES = "Bob Alice Carol Carlos Chuck Dave Eve Isaac Oscar Imothep".split()
EDGES = [(0, 6, 3.2379021125126695), (0, 4, 4.021182464976445), (0, 3, 4.292771164145089), (0, 7, 3.4548743589401303), (1, 8, 2.1247566162072657), (1, 5, 3.3159797834419913), (1, 3, 4.626387708530117), (2, 6, 6.033511179007139), (2, 9, 1.5457695532230873), (3, 6, 5.382496461685263), (3, 9, 5.96817851937166), (4, 6, 1.3854437512876694), (4, 7, 2.3444036834012607), (4, 9, 5.316167567138506), (5, 8, 2.705405148355667), (6, 7, 3.032153810493577), (6, 9, 4.51068184664055)]


def make(spark, edges, n, directed=True):
    rows = [(k, *e, *([1.0] if len(e) == 2 else [])) for k, e in enumerate(edges)]
    return Graph(spark.range(n).withColumn("block", F.col("id") % 2), spark.createDataFrame(rows, "eid long, src long, dst long, weight double"), directed)


def column(df, name, key="id"):
    return [r[name] for r in df.orderBy(key).collect()]


@pytest.fixture(scope="module")
def people(spark):
    return make(spark, EDGES, 10, False)


def test_example_distances(people):
    assert column(paths.shortest_distance(people, 0), "dist") == [0, 2, 2, 1, 1, 3, 1, 1, 3, 2]
    d = column(paths.shortest_distance(people, 0, "weight"), "dist")
    assert d == pytest.approx([0, 8.91915887, 9.27141329, 4.29277116, 4.02118246, 12.23513866, 3.23790211, 3.45487436, 11.04391549, 7.74858396])
    dist = paths.shortest_distance(people, 0, "weight")
    assert column(paths.predecessors(people, dist, "weight"), "pred") == [0, 3, 6, 0, 0, 1, 0, 0, 1, 6]
    path = column(paths.shortest_path(people, 0, 8, "weight"), "id", "step")
    assert path == [0, 3, 1, 8]


def test_example_counts(people):
    assert column(degree.degree(people), "degree") == [4, 3, 2, 4, 4, 2, 6, 3, 2, 4]
    counts = clustering.local_counts(people)
    assert column(counts, "triangles") == [4, 1, 1, 2, 4, 1, 7, 3, 1, 3]
    assert clustering.global_clustering(people).first()["clustering"] == 0.5625
    assert column(components.kcore(people), "core") == [3, 2, 2, 3, 3, 2, 3, 3, 2, 3]
    mst = components.min_spanning_forest(people, "weight").join(people.edges, "eid").agg(F.count("*"), F.sum("weight")).first()
    assert mst[0] == 9 and mst[1] == pytest.approx(26.77352158)
    ranks = column(centrality.pagerank(people, epsilon=0, max_iter=10), "rank")
    assert ranks == pytest.approx([0.10722391, 0.10611709, 0.06046152, 0.11340726, 0.10660268, 0.07869175, 0.15672797, 0.0825734, 0.07869175, 0.10950267], abs=1e-7)


def test_betweenness(spark, people):
    v, e = paths.betweenness(make(spark, [(0, 1), (1, 2), (2, 3)], 4, False))
    assert column(v, "betweenness") == pytest.approx([0, 2 / 3, 2 / 3, 0])
    assert column(e, "betweenness", "eid") == pytest.approx([3 / 6, 4 / 6, 3 / 6])
    star, _ = paths.betweenness(make(spark, [(0, k) for k in range(1, 5)], 5, False))
    assert column(star, "betweenness") == pytest.approx([1, 0, 0, 0, 0])
    assert centrality.central_point_dominance(star).first()[0] == pytest.approx(1)


def brute_betweenness(n, edges):
    """Over all pairs and simple paths of an undirected graph."""
    ways = {}

    def walk(path, length):
        ways.setdefault((path[0], path[-1]), []).append((round(length, 9), tuple(path)))
        for a, b, w in edges:
            for x, y in ((a, b), (b, a)):
                if x == path[-1] and y not in path:
                    walk([*path, y], length + w)

    for v in range(n):
        walk([v], 0.0)
    out = [0.0] * n
    for (s, t), found in ways.items():
        best = [p for length, p in found if length == min(found)[0]]
        for v in range(n):
            if v not in (s, t):
                out[v] += sum(v in p for p in best) / len(best)
    return [x / ((n - 1) * (n - 2)) for x in out]


def test_weighted_betweenness(spark):
    edges = [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 2.0), (2, 3, 0.5), (1, 4, 3.0), (4, 3, 0.5), (0, 4, 4.0), (3, 5, 1.0)]
    g = make(spark, edges, 6, False)
    for batches in (1, 3):
        v, e = paths.betweenness(g, weight="weight", batches=batches)
        assert column(v, "betweenness") == pytest.approx(brute_betweenness(6, edges))
    assert column(paths.betweenness(g, batches=2)[1], "betweenness", "eid") == pytest.approx(column(paths.betweenness(g)[1], "betweenness", "eid"))


def test_hubs_are_split(spark):
    edges = [(0, k) for k in range(1, 40)] + [(k, 0) for k in range(1, 40)] + [(k, k + 1) for k in range(1, 39)]
    g = make(spark, edges, 40)
    pairs = centrality._weighted(g, None)
    x = g.vertices.select("id", (F.col("id") * 1.5).alias("x"))
    for key in ("src", "dst"):
        whole, split = (centrality.Links(pairs, key, hub).pull(x, F.col("x") * F.col("w")) for hub in (1 << 17, 7))
        assert column(split, "got") == pytest.approx(column(whole, "got"))


def test_numbers_within_hot_groups(spark):
    from vertexloom.functions.ordering import numbered_within

    rows = [(k, 0 if k < 700 else k % 13 if k % 17 else None) for k in range(1000)]
    df = spark.createDataFrame(rows, "id long, key long").repartition(5)
    groups = {}
    for k, key in rows:
        groups.setdefault(key, []).append(k)
    want = {k: n for ids in groups.values() for n, k in enumerate(ids)}
    assert {r["id"]: r["n"] for r in numbered_within(df, ["key"], ["id"]).collect()} == want


def test_estimates_stay_finite(spark):
    """A loop that joins its state with itself: each cut's estimate is a square of the one before, until it is written."""
    from vertexloom.plans.iterate import ABSURD_BITS, Rows, cut

    state = cut(spark.range(5))
    for _ in range(12):
        state = cut(state.join(state.select(F.col("id").alias("other")), F.col("id") <= F.col("other")).groupBy("id").agg(F.max("other")).select("id"))
        assert int(state._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()).bit_length() < ABSURD_BITS
    assert state.count() == 5
    rows = Rows(many=3)
    assert rows.all() is None
    for k in range(10):
        rows.add(spark.range(k, k + 1))
    assert sorted(r[0] for r in rows.all().collect()) == list(range(10)) and sum(map(len, rows.levels)) <= 4


def test_documented_closed_forms():
    assert max_blocks(1e6, 5e6) == 1572
    assert average_degree_limit(10, math.log(10) / 100, 100) == pytest.approx(2.414413, abs=1e-5)
    assert average_degree_limit(10, math.log(10) / 100) == pytest.approx(200)


def test_refusals(spark):
    with pytest.raises(ValueError):
        clustering.pattern_matches(make(spark, [(0, 1)], 2), [(0, 1), (2, 3)])
    with pytest.raises(ValueError):
        flow.price_network(spark, 1000, at_most=10)


def test_isomorphism_of_a_deep_graph(spark):
    n = 1500
    g, h = (make(spark, [(f(k), f(k + 1)) for k in range(n - 1)], n) for f in (lambda k: k, lambda k: n - 1 - k))
    found = flow.isomorphism(g, h)
    assert {r["id"]: r["image"] for r in found.collect()} == {k: n - 1 - k for k in range(n)}


def test_micro_graphs(spark):
    empty = make(spark, [(0, 0)], 3).view(edge=F.lit(False))
    assert column(degree.degree(empty), "degree") == [0, 0, 0]
    loop = make(spark, [(0, 0)], 1, False)
    assert column(degree.degree(loop), "degree") == [2] and column(degree.degree(loop, "in"), "degree") == [0]
    three = make(spark, [(0, 1)] * 3, 2)
    assert column(stats.label_parallel_edges(three), "label", "eid") == [0, 1, 2]
    two = make(spark, [(0, 1), (2, 3)], 5)
    assert column(components.weak_components(two), "label") == [0, 0, 2, 2, 4]
    cycle = make(spark, [(0, 1), (1, 2), (2, 0)], 3)
    assert column(components.strong_components(cycle), "label") == [0, 0, 0] and not components.is_dag(cycle)
    diamond = make(spark, [(0, 1), (0, 2), (1, 3), (2, 3)], 4)
    assert column(components.topological_levels(diamond), "level") == [0, 1, 1, 2]
    assert column(flow.dominator_tree(diamond, 0), "idom") == [0, 0, 0, 0]
    assert components.reciprocity(make(spark, [(0, 1), (1, 0)], 2)).first()[0] == 1.0
    assert components.bipartite(diamond)[0] and not components.bipartite(cycle)[0]
    assert components.transitive_closure(cycle).count() == 9
    assert column(components.largest_component(two), "in_largest") == [True, False, False, False, False]


def test_flow(spark):
    g = make(spark, [(0, 1, 3.0), (0, 2, 2.0), (1, 2, 1.0), (1, 3, 2.0), (2, 3, 3.0)], 4)
    value, residual = flow.max_flow(g, 0, 3, "weight")
    assert value == 5 and column(flow.min_st_cut(g, 0, "weight", residual), "on_source_side") == [True, False, False, False]
    with pytest.raises(ValueError):
        flow.max_flow(g.as_undirected(), 0, 3, "weight")
    value, side = flow.min_cut(make(spark, [(0, 1), (1, 2), (2, 0), (2, 3)], 4, False))
    assert value == 1 and side.where("side").count() in (1, 3)


def test_local_kernels(spark, people):
    label, points = flow.biconnected_components(make(spark, [(0, 1), (1, 2), (2, 0), (2, 3)], 4, False))
    assert column(points, "articulation") == [False, False, True, False] and label.select("label").distinct().count() == 2
    assert flow.max_cardinality_matching(people).count() == 5
    assert flow.random_spanning_tree(people, 0, seed=1).count() == 9
    assert flow.isomorphism(people, Graph(people.vertices, people.edges.withColumn("src", 9 - F.col("src")).withColumn("dst", 9 - F.col("dst")), False)) is not None
    assert flow.isomorphism(people, make(spark, [(0, 1)], 10, False)) is None
    assert not flow.is_planar(make(spark, [(a, b) for a in range(5) for b in range(a)], 5, False))
    assert flow.is_planar(make(spark, [(0, 1), (1, 2), (2, 0)], 3, False))
    assert flow.kuratowski_edges(make(spark, [(a, b) for a in range(3) for b in range(3, 6)], 6, False)).count() == 9
    assert flow.make_maximal_planar(make(spark, [(0, 1), (1, 2), (2, 3)], 4, False)).edges.count() == 6
    tour = column(flow.tsp_tour(people, 0, "weight"), "id", "step")
    assert tour[0] == tour[-1] == 0 and sorted(tour[:-1]) == list(range(10))
    colours = {r["id"]: r["color"] for r in flow.sequential_vertex_coloring(people).collect()}
    assert all(colours[s] != colours[t] for s, t, _ in EDGES)
    assert flow.price_network(spark, 20, 2).edges.count() == 37
    square = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 0.0, 1.1), (3, 1.0, 1.0)], "id long, x double, y double")
    assert flow.triangulation(square).edges.count() == 5
    with pytest.raises(ValueError):
        Local.of(people, 3)


def test_searches(people):
    g = Local.of(people, properties=("weight",))
    seen = []
    kernels.bfs_search(g, 0, lambda event, x: seen.append(x) if event == "discover_vertex" else None)
    assert len(seen) == 10

    def stop(event, x):
        if event == "discover_vertex":
            seen.append(x)
            if x == 9:
                raise kernels.StopSearch

    seen.clear()
    kernels.dfs_search(g, 0, stop)
    assert seen[-1] == 9
    dist, pred = kernels.dijkstra_search(g, 0, "weight")
    assert dist[5] == pytest.approx(12.23513866) and pred[5] == 1
    widest, _ = kernels.dijkstra_search(g, 0, "weight", combine=min, compare=lambda a, b: a > b, zero=math.inf, infinity=0.0)
    assert widest[6] == pytest.approx(4.51068184664055, abs=1)
    length, path = kernels.astar_search(g, 0, 8, "weight", lambda v: 0.0)
    assert length == pytest.approx(11.04391549) and path == [0, 3, 1, 8]


def test_negative_weights(spark):
    ok, d = paths.bellman_ford(make(spark, [(0, 1, 4.0), (0, 2, 1.0), (2, 1, -2.0)], 3), 0, "weight")
    assert ok and column(d, "dist") == [0, -1, 1]
    assert not paths.bellman_ford(make(spark, [(0, 1, 1.0), (1, 0, -2.0)], 2), 0, "weight")[0]


def test_bins():
    for bad in ([1], [0, 0], [2, 2, 2]):
        with pytest.raises(ValueError):
            Bins(bad)


def test_histogram_keeps_empty_bins(spark):
    g = make(spark, [(0, 1)] * 4 + [(1, 0)], 2)
    got = [(r[0], r[1]) for r in stats.vertex_hist(g, "out", [0.0, 1.0]).orderBy("bin_left").collect()]
    assert got == [(0, 0), (1, 1), (2, 0), (3, 0), (4, 1)]


def test_spectral(spark):
    g = make(spark, [(0, 1), (1, 2)], 3, False)
    rows = {(r["i"], r["j"]): r["value"] for r in spectral.laplacian(g).collect()}
    assert rows == {(0, 0): 1, (1, 1): 2, (2, 2): 1, (0, 1): -1, (1, 0): -1, (1, 2): -1, (2, 1): -1}
    sums = spectral.transition(g).groupBy("j").agg(F.sum("value").alias("s"))
    assert all(abs(r["s"] - 1) < 1e-12 for r in sums.collect())


def test_correlations(spark, people):
    r = correlations.assortativity(people, "block").first()
    assert -1 <= r["r"] <= 1 and r["sigma"] > 0


def test_rewiring_keeps_degrees(spark, people):
    for model in ("uncorrelated", "correlated"):
        g = make(spark, [(s, t) for s, t, _ in EDGES], 10)
        out = transform.random_rewire(g, model, 3, seed=1)
        assert column(degree.degree(out, "out"), "degree") == column(degree.degree(g, "out"), "degree")
        assert column(degree.degree(out, "in"), "degree") == column(degree.degree(g, "in"), "degree")
        assert out.edges.where("src = dst").isEmpty() and out.edges.groupBy("src", "dst").count().where("count > 1").isEmpty()
    assert transform.random_rewire(people, "erdos", seed=2).edges.count() == 17


def test_transforms(spark):
    g = make(spark, [(0, 1), (1, 2), (2, 0)], 3)
    assert transform.line_graph(g).edges.count() == 3
    merged = transform.union(g, g, spark.createDataFrame([(0, 0)], "id long, into long"))
    assert merged.num_vertices() == 5 and merged.num_edges() == 6
    assert transform.half_edges(g).num_vertices() == 6
    draws = transform.sample(spark.createDataFrame([(1, 1.0), (2, 3.0)], "id long, weight double"), 400, 5)
    assert draws.count() == 400 and 240 < draws.where("id = 2").count() < 360
    torus = transform.geometric_graph(spark.createDataFrame([(0, 0.02), (1, 0.98), (2, 0.5)], "id long, x double"), 0.1, ["x"], [(0.0, 1.0)])
    assert [(r["src"], r["dst"]) for r in torus.edges.collect()] == [(0, 1)]


def test_communities(spark):
    two = [(a, b) for a in range(5) for b in range(a)] + [(a + 5, b + 5) for a in range(5) for b in range(a)] + [(0, 5)]
    g = make(spark, two, 10, False)
    length, blocks = community.minimize_blocks(g, 2, seed=1, deg_corr=False)
    assert len({blocks[v] for v in range(5)}) == 1 and len({blocks[v] for v in range(5, 10)}) == 1 and blocks[0] != blocks[9]
    state = community.BlockState(g, spark.createDataFrame(sorted(blocks.items()), "id long, block long"), False)
    local = community.LocalBlocks(Local.of(g), blocks, False)
    assert state.entropy() == pytest.approx(local.entropy())
    before = local.entropy()
    assert local.move(0, blocks[9]) == pytest.approx(local.entropy() - before)
    spins = {r["id"]: r["spin"] for r in community.label_propagation(g, 12).collect()}
    assert len(set(spins.values())) < 10
    assert lbinom(5, 2) == pytest.approx(math.log(10)) and partition_entropy([2, 2]) > 0


def test_formats(spark, tmp_path, people):
    named = people.with_vertices(people.vertices.select("id", F.element_at(F.array(*map(F.lit, NAMES)), (F.col("id") + 1).cast("int")).alias("name")))
    for name in ("g.graphml", "g.gml.gz", "g.dot.bz2", "g.gt.xz", "folder"):
        path, fmt = f"{tmp_path}/{name}", {"g.graphml": "graphml", "g.gml.gz": "gml", "g.dot.bz2": "dot", "g.gt.xz": "gt"}.get(name, "parquet")
        formats.save_graph(named, path, fmt)
        back = formats.load_graph(spark, path)
        assert not back.directed and back.num_vertices() == 10
        assert sorted(column(back.vertices, "name")) == sorted(NAMES)
        assert back.edges.agg(F.sum(F.col("weight").cast("double"))).first()[0] == pytest.approx(sum(w for _, _, w in EDGES))
        assert "name" not in formats.load_graph(spark, path, ignore_vp=("name",)).vertices.columns
    with gzip.open(f"{tmp_path}/x.dot.gz", "wb") as f:
        f.write(b'digraph { a -> b -> c [w=2]; c [label="x y"]; /* no */ }')
    g = formats.load_graph(spark, f"{tmp_path}/x.dot.gz")
    assert g.directed and g.num_edges() == 2 and g.edges.where("w = 2").count() == 2


def test_files_are_made_and_read_in_parts(spark, tmp_path, monkeypatch):
    """No part of a graph is collected whole, and lines are parsed by several tasks, in any of which ends may be named first."""
    monkeypatch.setattr(formats, "PIECE", 64)
    monkeypatch.setattr(formats, "_collected", None, raising=False)  # what fetched up to 1,000,000 rows and refused more
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        v = spark.range(0, 600, 2).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit('a<&"\''), "id")).alias("name"), (F.col("id") % 4 == 0).alias("even"), F.when(F.col("id") > 9, F.col("id")).alias("part"))
        e = spark.range(900).select(F.col("id").alias("eid"), (F.col("id") * 14 % 600).alias("src"), (F.col("id") * 22 % 600).alias("dst"), (F.col("id") / 7).alias("w"))
        want = sorted((r["src"], r["dst"], r["w"]) for r in e.collect())
        for name in ("g.graphml", "g.gml", "g.dot", "g.gt", "g.gt.gz", "g.gml.xz"):
            formats.save_graph(Graph(v, e), f"{tmp_path}/{name}", name.split(".")[1])
            back = formats.load_graph(spark, f"{tmp_path}/{name}")
            assert back.directed and column(back.vertices, "id") == list(range(300))
            assert sorted((2 * r["src"], 2 * r["dst"], float(r["w"])) for r in back.edges.collect()) == want, name
            names = [r["name"] or None for r in back.vertices.orderBy("id").collect()]
            quote = "'" if name.split(".")[1] in ("gml", "dot") else '"'
            assert names == [f"a<&{quote}'{k}" if k % 3 else None for k in range(0, 600, 2)], name
            assert back.vertices.where(F.lower(F.col("even").cast("string")) == "true").count() == 150
        formats.save_graph(Graph(v.withColumn("name", F.lit("x\n  node [ id 7 ]")), e), f"{tmp_path}/two.gml", "gml")
        assert formats.load_graph(spark, f"{tmp_path}/two.gml").vertices.where("name = 'x\n  node [ id 7 ]'").count() == 300
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_strong_components_both_ways(spark):
    import random

    rng = random.Random(6)
    g = make(spark, [(rng.randrange(40), rng.randrange(40)) for _ in range(55)], 40)
    want = column(components.strong_components(g), "label")
    assert column(components.strong_components(g, at_most=0), "label") == want and len(set(want)) < 40


@pytest.fixture(scope="module")
def parts(spark):
    """Weak components of several kinds, a loop and a vertex alone; trusts repeat."""
    rng = random.Random(8)
    edges = [(rng.randrange(20), rng.randrange(20), rng.choice([0.2, 0.5, 1.0])) for _ in range(34)]
    return make(spark, edges + [(20 + k, 21 + k, 0.5) for k in range(9)] + [(40, 40, 1.0), (41, 42, 1.0), (42, 41, 1.0)], 45)


def same(one, other):
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))


def test_closure_by_components(parts):
    same(components.transitive_closure(parts), components.transitive_closure(parts, held=0))


def test_trusts_by_component(parts):
    for source in (0, 20, 44):
        same(centrality.trust_transitivity(parts, "weight", source), centrality.trust_transitivity(parts, "weight", source, held=0))


def test_extended_clustering_by_components(parts, people):
    for g in (parts.as_undirected(), people):
        same(clustering.extended_clustering(g, 3), clustering.extended_clustering(g, 3, held=0))


def test_pseudo_diameter_by_component(parts):
    for g, source in ((parts.as_undirected(), 0), (parts, 20), (parts.as_undirected(), 25), (parts, 44)):
        assert paths.pseudo_diameter(g, source) == paths.pseudo_diameter(g, source, held=0)


def test_strong_components_by_components(parts, monkeypatch):
    want = column(components.strong_components(parts, 0), "label")
    monkeypatch.setattr(components, "_spread", None)  # no rounds
    assert column(components.strong_components(parts, 1), "label") == want


def test_colours_by_components(parts):
    same(components.colouring(parts.as_undirected(), 2), components.colouring(parts.as_undirected(), 2, held=0))


def test_cells_push_without_a_row_for_each_vertex(spark):
    at = spark.createDataFrame([(0, 0.0, 0.0), (1, 3.0, 4.0)], "id long, x double, y double")
    cells = spark.createDataFrame([(2, 0.0, 1.0), (1, 3.0, 0.0)], "n long, mx double, my double")
    got = layout._pushed(at, cells, lambda dx, dy, n: n / (dx * dx + dy * dy)).orderBy("id").collect()
    assert got[0][3:] == pytest.approx((-1 / 3, -2.0)) and got[1][3:] == pytest.approx((2 * 3 / 18, 2 * 3 / 18 + 4 / 16))


def test_tasks_join_their_own_edges(spark):
    from vertexloom.local.pairs import stars

    u, v = stars(*[[9, 5, 7, 8, 3], [5, 2, 6, 7, 1]])
    assert list(zip(u.tolist(), v.tolist())) == [(3, 1), (5, 2), (7, 6), (8, 6), (9, 2)]


def test_block_rewiring(spark, people):
    g = make(spark, [(s, t) for s, t, _ in EDGES], 10)
    odd = spark.createDataFrame([(0, 0, 1.0), (1, 1, 1.0)], "r long, s long, p double")
    drawn = transform.random_rewire(g, "blockmodel-traditional", block="block", seed=4, probability=odd)
    assert drawn.edges.count() == 17 and drawn.edges.where("src % 2 <> dst % 2").isEmpty()
    swapped = transform.random_rewire(g, "probabilistic", 2, block="block", seed=1, probability=odd)
    assert column(degree.degree(swapped, "out"), "degree") == column(degree.degree(g, "out"), "degree")
    assert swapped.edges.where("src % 2 = dst % 2").count() >= g.edges.where("src % 2 = dst % 2").count()


def test_coarse_graphs(spark, people):
    for method in ("matching", "independent"):
        small, blocks = transform.coarse(people, method)
        assert small.num_vertices() < 10 and blocks.count() == 10
        assert small.vertices.agg(F.sum("count")).first()[0] == 10
    stack = transform.coarse_stack(people, least=2)
    assert stack[-1][0].num_vertices() <= 2


def test_motif_samples(spark, people):
    whole = clustering.motif_sets(people, 3)
    assert clustering.motif_sets(people, 3, 0.5).exceptAll(whole).isEmpty()
    z = clustering.motif_significance(make(spark, EDGES, 10), 3, 2)
    assert z.where("count < 0 or isnan(z)").isEmpty() and z.agg(F.sum("count")).first()[0] == whole.count()


def test_nested_blocks(spark, people):
    levels = [{v: v % 4 for v in range(10)}, {b: b % 2 for b in range(4)}, {0: 0, 1: 0}]
    assert community.project_level(levels, 1) == {v: v % 4 % 2 for v in range(10)}
    parts = community.nested_entropy(people, levels)
    assert len(parts) == 3 and all(math.isfinite(x) for x in parts)
    assert parts[2] == pytest.approx(lbinom(3 + 17 - 1, 17) + partition_entropy([2]))


def test_more_searches(people):
    g = Local.of(people, properties=("weight",))
    done, dist, pred = kernels.bellman_ford_search(g, 0, "weight")
    assert done and dist[5] == pytest.approx(12.23513866) and pred[5] == 1
    length, path = kernels.astar_implicit((0, 0), (3, 2), lambda p: [((p[0] + 1, p[1]), 1.0), ((p[0], p[1] + 1), 1.0)] if p[0] < 4 and p[1] < 4 else [], lambda p: abs(3 - p[0]) + abs(2 - p[1]))
    assert length == 5 and path[0] == (0, 0) and path[-1] == (3, 2)


def test_numbers_of_large_tables(spark):
    from vertexloom.functions.ordering import following, numbered

    df = spark.range(50_000).select(F.xxhash64("id").alias("k"))
    n = numbered(df, ["k"])
    assert n.agg(F.max("n"), F.count_distinct("n")).first() == (49_999, 50_000)
    led = following(df, ["k"], "k", "after").join(n, "k")
    assert led.where("after is null").count() == 1
    assert led.join(n.select(F.col("k").alias("after"), F.col("n").alias("m")), "after").where("m = n + 1").count() == 49_999


def test_edge_lists(spark):
    g = formats.from_edge_list(spark, [(0, 1), (1, 2)])
    more = formats.add_edge_list(g, spark.createDataFrame([(2, 7)], "src long, dst long"))
    assert more.num_edges() == 3 and more.num_vertices() == 4
    assert datasets.load(spark, "tree", "/root/testdata/sf0.001").directed


def test_layouts(people):
    for df in (layout.random_layout(people), layout.radial_layout(people, 0), layout.force_layout(people, 2), layout.arf_layout(people, 2), layout.multilevel_layout(people, 1, least=4)):
        assert df.count() == 10 and df.where("x is null or isnan(y)").isEmpty()


def test_every_cell_repels(spark):
    place = [(k, -9.4 + 1.25 * (k % 20), -9.4 + 1.25 * (k // 20)) for k in range(400)]  # each in a cell of its own
    g = make(spark, [(0, 0)], 400, False)
    got = {r["id"]: (r["x"], r["y"]) for r in layout.force_layout(g, 1, start=spark.createDataFrame(place, "id long, x double, y double")).collect()}
    for k, x, y in place[::37]:
        px, py = (sum(0.25 * d / ((x - u) ** 2 + (y - v) ** 2 + 1e-3) for _, u, v in place for d in [(x - u, y - v)[c]]) for c in (0, 1))
        move = min(1.0, 1 / (math.hypot(px, py) + 1e-9))
        assert got[k] == pytest.approx((max(-10, min(20, x + px * move)), max(-10, min(20, y + py * move))), abs=1e-6)


def test_stream(spark, tmp_path):
    spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long").write.parquet(f"{tmp_path}/in")
    edges = spark.readStream.schema("src long, dst long").parquet(f"{tmp_path}/in")
    q = degree_stream(edges).writeStream.outputMode("complete").format("memory").queryName("degrees").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("degrees").collect()} == {(0, 1), (1, 2), (2, 1)}


def test_more_options(spark, people):
    two = make(spark, [(0, 1, 1.0), (1, 2, 1.0), (3, 4, 1.0), (4, 5, 2.0)], 6, False)
    assert column(components.min_spanning_forest(two, "weight", root=4), "eid", "eid") == [2, 3]
    square = make(spark, [(0, 1), (1, 2), (2, 3), (3, 0)], 4, False)
    marked = square.with_vertices(square.vertices.withColumn("mark", F.col("id") == 2))
    other = square.with_vertices(square.vertices.withColumn("mark", F.col("id") == 3))
    assert {r["id"]: r["image"] for r in flow.isomorphism(marked, other, invariant="mark").collect()}[2] == 3
    assert flow.isomorphism(marked, square.with_vertices(square.vertices.withColumn("mark", F.lit(False))), invariant="mark") is None
    assert clustering.pattern_matches(square, [(0, 1), (1, 2)], max_n=3).count() == 3
    assert column(clustering.motifs(square, 4), "count", "motif") == [1]
    pentagon = make(spark, [(k, (k + 1) % 5) for k in range(5)], 5, False)
    assert clustering.motifs(pentagon, 5).count() == 1
    assert clustering.motifs(pentagon, 3, motif_list=[[(0, 1), (1, 2), (2, 0)]]).count() == 0
    trust = make(spark, [(0, 1, 0.5), (1, 2, 0.5), (0, 2, 0.1)], 3)
    whole = {r["id"]: r["trust"] for r in centrality.trust_transitivity(trust, "weight", 0).collect()}
    assert [tuple(r) for r in centrality.trust_transitivity(trust, "weight", 0, target=2).collect()] == [(2, whole[2])]
    assert column(degree.reversed_map(marked.vertices, "mark"), "id", "value") == [0, 2]
    wanted = spark.createDataFrame([(k, 2) for k in range(30)], "id long, k_out long")
    made = transform.random_graph(spark, wanted, False, 1, False, False)
    pairs = {tuple(sorted((r["src"], r["dst"]))) for r in made.edges.collect()}
    assert len(pairs) == 30 and all(a != b for a, b in pairs)
    with pytest.raises(ValueError):
        transform.random_graph(spark, spark.createDataFrame([(0, 2), (1, 2)], "id long, k_out long"), False, 1, False, False, at_most=3)


def test_label_rings(people):
    from vertexloom.operators import layout

    at = {r["id"]: math.hypot(r["x"], r["y"]) for r in layout.radial_layout(people, 0).collect()}
    assert [round(at[k], 6) for k in range(10)] == [0, 2, 2, 1, 1, 3, 1, 1, 3, 2]


def test_isomorphism_of_many_twins(spark):
    """Leaves of one hub are one class, so more of them than the search may hold are mapped."""
    n = 3000
    g = make(spark, [(0, 1), (0, 2), *[(1 + k % 2, 3 + k) for k in range(n)]], n + 3)
    h = Graph(g.vertices.select((-F.col("id")).alias("id")), g.edges.select("eid", (-F.col("src")).alias("src"), (-F.col("dst")).alias("dst")), True)
    image = {r["id"]: r["image"] for r in flow.isomorphism(g, h, at_most=10).collect()}
    assert len(set(image.values())) == n + 3
    assert {(image[r["src"]], image[r["dst"]]) for r in g.edges.collect()} == {(r["src"], r["dst"]) for r in h.edges.collect()}


def test_motif_counts_are_not_listed(spark, monkeypatch):
    """Counts of a graph with loops, parallel edges and all shapes are those of the listed sets."""
    rng = random.Random(5)
    g = make(spark, [(rng.randrange(14), rng.randrange(14)) for _ in range(55)], 14, False)
    listed = {k: {r["motif"]: r["count"] for r in clustering.motif_sets(g, k).groupBy("motif").count().collect()} for k in (3, 4)}
    monkeypatch.setattr(clustering, "motif_sets", None)
    for k in (3, 4):
        assert {r["motif"]: r["count"] for r in clustering.motifs(g, k).collect()} == listed[k]
    assert len(listed[4]) == 6
    assert clustering.motifs(make(spark, [(0, k) for k in range(1, 400)], 400, False), 4).collect() == [(7, 399 * 398 * 397 // 6)]


def test_all_pairs_by_component(spark, monkeypatch):
    """Tasks by component and rounds over DataFrames come to the same; the first need no rounds."""
    rng = random.Random(7)
    edges = [(rng.randrange(9), rng.randrange(9)) for _ in range(20)] + [(10 + k, 11 + k) for k in range(5)]
    for directed in (False, True):
        g = make(spark, edges, 18, directed)
        rounds = [{tuple(r) for r in paths.all_distances(g, held=0).collect()}, *[{r[0]: r[1] for r in x.collect()} for x in paths.betweenness(g, held=0)]]
        with monkeypatch.context() as m:
            m.setattr(paths, "distances", None)
            assert {tuple(r) for r in paths.all_distances(g).collect()} == rounds[0]
            assert {r["id"]: (r["dist"], r["n"]) for r in paths.distance_counts(g).where("dist = 1").collect()} == {v: (1.0, n) for v in range(18) if (n := sum(a == v and d == 1 for a, _, d in rounds[0]))}
            for got, want in zip(paths.betweenness(g), rounds[1:], strict=True):
                assert {r[0]: r[1] for r in got.collect()} == pytest.approx(want)


def test_only_what_matters_is_fetched(spark):
    """Limits hold for what the source reaches, or for a component, not for the whole graph."""
    far = [(10 + k, 11 + k) for k in range(60)]
    g = make(spark, [(0, 1), (1, 2), (0, 2), (2, 3), *far], 72)
    value, residual = flow.max_flow(g, 0, 3, "weight", at_most=10)
    assert value == 1 and residual.count() == 64 and residual.where("residual = 0").count() >= 2
    assert {r["id"]: r["idom"] for r in flow.dominator_tree(g, 0, at_most=10).collect()} == {0: 0, 1: 0, 2: 0, 3: 2}
    label, points = flow.biconnected_components(g, at_most=60)
    assert column(label, "label", "eid")[:5] == [0, 0, 0, 3, 4]
    assert {r["id"] for r in points.where("articulation").collect()} == {2, *range(11, 70)}


def test_min_cut_of_a_dense_graph_takes_few_orders(monkeypatch):
    rng = random.Random(3)
    edges = [(k, a, b) for k, (a, b) in enumerate((a, b) for a in range(60) for b in range(a))]
    g = Local(list(range(60)), edges, False, {"w": {k: rng.random() + 0.5 for k, _, _ in edges}})
    orders, heapify = [], kernels.heapq.heapify
    monkeypatch.setattr(kernels.heapq, "heapify", lambda heap: (orders.append(len(heap)), heapify(heap)))
    value, side = kernels.min_cut(g, "w")
    assert len(orders) < 20 and len(side) == 1  # one for each vertex, if edges are not merged
    assert value == pytest.approx(min(sum(x for k, a, b in edges if v in (a, b) for x in [g.values["w"][k]]) for v in range(60)))
    two = Local([0, 1, 2, 3], [(0, 0, 1), (1, 2, 3)], False)
    assert kernels.min_cut(two)[0] == 0


def test_directed_motifs_of_three_are_not_listed(spark, monkeypatch):
    rnd = random.Random(5)
    dense = [(a, b) for a in range(14) for b in range(14) if rnd.random() < 0.3]  # loops among them
    star = [(0, b) if b % 2 else (b, 0) for b in range(1, 30)] + [(0, 2), (3, 0), (2, 4), (4, 2), (0, 2)]
    for edges in (dense, star, [(0, 1), (1, 0), (0, 0)], [(0, 0)]):
        g = make(spark, edges, 30)
        listed = {r["motif"]: r["count"] for r in clustering.motif_sets(g, 3).groupBy("motif").count().collect()}
        with monkeypatch.context() as m:
            m.setattr(clustering, "motif_sets", None)
            assert {r["motif"]: r["count"] for r in clustering.motifs(g, 3).collect()} == listed
            path = clustering.motif_code([(0, 1), (1, 2)], 3, True)
            assert {r["motif"]: r["count"] for r in clustering.motifs(g, 3, motif_list=[[(0, 1), (1, 2)]]).collect()} == {k: n for k, n in listed.items() if k == path}


def test_coarse_stacks_by_tasks_are_those_by_rounds(spark, monkeypatch):
    from vertexloom.local.pairs import hashed, matched
    from vertexloom.operators import components as found

    ids = [0, 1, -7, 1 << 40, -(1 << 62)]
    same = spark.createDataFrame([(n, k) for n, k in enumerate(ids)], "n int, k long").orderBy("n").select(F.xxhash64("k", F.lit(3)))
    assert hashed(np.array(ids), 3).tolist() == [r[0] for r in same.collect()]
    chain = np.arange(300)
    assert matched(chain, chain + 1, 301).tolist() == [k % 2 == 0 for k in range(300)]

    rnd = random.Random(9)
    edges = [(a, rnd.randrange(a + 1, 60)) if rnd.random() < 0.5 else (rnd.randrange(a + 1, 60), a) for a in range(59) for _ in range(2)]
    edges += [(60 + rnd.randrange(40), 60 + rnd.randrange(40)) for _ in range(90)] + [(3, 5), (5, 3), (3, 5), (7, 7)]
    for directed, weight in ((True, None), (False, "weight")):
        g = make(spark, [(*e, float(rnd.randrange(9))) for e in edges], 105, directed)

        def told(held):
            return [(sorted(map(tuple, x.vertices.select("id", "count").collect())), sorted(map(tuple, x.edges.select("src", "dst", "count", "eid").collect())), sorted(map(tuple, b.select("id", "block").collect()))) for x, b in transform.coarse_stack(g, least=12, weight=weight, seed=2, held=held)]

        with monkeypatch.context() as m:
            m.setattr(found, "greedy_matching", None)
            tasks = told(None)
        assert len(tasks) > 2 and tasks == told(150)  # one component by rounds, the other by tasks


def test_matchings_by_tasks_are_those_by_rounds(spark, monkeypatch):
    rnd = random.Random(4)
    edges = [(rnd.randrange(40), rnd.randrange(40), float(rnd.randrange(5))) for _ in range(120)] + [(50, 51, 1.0), (51, 50, 3.0), (51, 52, 2.0)]
    g = make(spark, edges, 60)
    rounds = sorted(r["eid"] for r in components.greedy_matching(g, "weight", held=0).collect())
    assert sorted(r["eid"] for r in components.greedy_matching(g, "weight", held=20).collect()) == rounds
    monkeypatch.setattr(components, "_matched_by_rounds", None)
    assert sorted(r["eid"] for r in components.greedy_matching(g, "weight").collect()) == rounds
