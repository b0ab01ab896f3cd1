"""Modularity and stochastic block models. Block tables are small (blocks by blocks); vertices and edges stay in Spark."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.functions.special import fast_partitions, lbinom, partition_entropy, xlogx
from vertexloom.graph import Graph
from vertexloom.local.kernels import Local

#: Blocks that a table on the driver may have, squared.
MOST_BLOCKS = 4096


def modularity(g: Graph, block: str, weight: str | None = None) -> DataFrame:
    """modularity, one row; the graph counts as undirected."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    names = g.vertices.select("id", block)
    e = g.edges.select("src", "dst", w.alias("w")).join(names.toDF("src", "bs"), "src").join(names.toDF("dst", "bd"), "dst")
    ends = e.select(F.explode(F.array(F.struct(F.col("bs").alias("r"), "w", F.when(F.col("bs") == F.col("bd"), F.col("w")).otherwise(0.0).alias("own")), F.struct(F.col("bd").alias("r"), "w", F.when(F.col("bs") == F.col("bd"), F.col("w")).otherwise(0.0).alias("own")))).alias("x"))
    er = ends.groupBy("x.r").agg(F.sum("x.w").alias("er"), F.sum("x.own").alias("err"))
    total = er.agg(F.sum("er").alias("W"))
    return er.join(F.broadcast(total)).agg((F.sum(F.col("err") - F.col("er") ** 2 / F.col("W")) / F.first("W")).alias("modularity"))


@dataclass
class BlockState:
    """A partition of a graph: ``blocks`` is (id, block). Counts by block come from Spark, entropies from the driver."""

    graph: Graph
    blocks: DataFrame
    deg_corr: bool = True
    layer: str | None = None

    @property
    def matrix(self) -> DataFrame:
        """r, s and e_rs (r <= s and single if undirected), by layer if there is one."""
        e = self.graph.edges.join(self.blocks.toDF("src", "r"), "src").join(self.blocks.toDF("dst", "s"), "dst")
        if not self.graph.directed:
            e = e.select(F.least("r", "s").alias("r"), F.greatest("r", "s").alias("s"), *([self.layer] if self.layer else []))
        return e.groupBy(*([self.layer] if self.layer else []), "r", "s").agg(F.count(F.lit(1)).alias("e_rs"))

    @property
    def sizes(self) -> DataFrame:
        return self.blocks.groupBy("block").agg(F.count(F.lit(1)).alias("n_r"))

    @property
    def block_degrees(self) -> DataFrame:
        """block, e_out and e_in (undirected: e_out counts ends)."""
        m = self.matrix
        if self.graph.directed:
            out = m.groupBy(F.col("r").alias("block")).agg(F.sum("e_rs").alias("e_out"))
            into = m.groupBy(F.col("s").alias("block")).agg(F.sum("e_rs").alias("e_in"))
            return self.sizes.select("block").join(out, "block", "left").join(into, "block", "left").fillna(0)
        ends = m.select(F.explode(F.array("r", "s")).alias("block"), "e_rs").groupBy("block").agg(F.sum("e_rs").alias("e_out"))
        return self.sizes.select("block").join(ends, "block", "left").fillna(0)

    def block_graph(self) -> Graph:
        from vertexloom.operators.transform import condensation

        return condensation(Graph(self.blocks, self.graph.edges, self.graph.directed), "block")

    def _tables(self):
        sizes = {r[0]: r[1] for r in self.sizes.limit(MOST_BLOCKS + 1).collect()}
        if len(sizes) > MOST_BLOCKS:
            raise ValueError(f"more than {MOST_BLOCKS} blocks")
        return sizes, self.matrix.collect(), {r["block"]: r for r in self.block_degrees.collect()}

    def entropy(self, dense: bool = False, multigraph: bool = True, complete: bool = False, dl: bool = False, edges_dl: bool = True) -> float:
        """Sparse or dense entropy, with parallel-edge and degree terms if ``complete``, and description length if ``dl``."""
        sizes, matrix, degrees = self._tables()
        directed, s = self.graph.directed, 0.0
        e = sum(r["e_rs"] for r in matrix)
        if dense:
            for r in matrix:
                n = sizes[r["r"]] * sizes[r["s"]]
                if not directed and r["r"] == r["s"]:
                    n = sizes[r["r"]] * (sizes[r["r"]] + 1) / 2 if multigraph else sizes[r["r"]] * (sizes[r["r"]] - 1) / 2
                s += lbinom(n + r["e_rs"] - 1, r["e_rs"]) if multigraph else lbinom(n, r["e_rs"])
        else:
            for r in matrix:
                s -= 0.5 * xlogx(2 * r["e_rs"]) if not directed and r["r"] == r["s"] else xlogx(r["e_rs"])
            for b, n in sizes.items():
                k_out, k_in = degrees[b]["e_out"], degrees[b]["e_in"] if directed else degrees[b]["e_out"]
                if self.deg_corr:
                    s += (xlogx(k_out) + xlogx(k_in)) * (1 if directed else 0.5)
                else:
                    s += (k_out + k_in) * math.log(n) * (1 if directed else 0.5)
            s += -e if self.deg_corr else e
            if complete:
                if self.deg_corr:
                    from vertexloom.operators.degree import degree

                    for kind in ("out", "in") if directed else ("out",):
                        s -= sum(r["count"] * math.lgamma(r["k"] + 1) for r in degree(self.graph, kind, name="k").groupBy("k").count().collect())
                if multigraph:
                    pair = ["src", "dst"] if directed else [F.least("src", "dst"), F.greatest("src", "dst")]
                    many = self.graph.edges.groupBy(*pair).agg(F.count(F.lit(1)).alias("m")).groupBy("m").count().where("m > 1").collect()
                    s += sum(r["count"] * math.lgamma(r["m"] + 1) for r in many)
        if dl:
            s += partition_entropy(list(sizes.values()))
            if edges_dl:
                b = len(sizes)
                s += lbinom((b * b if directed else b * (b + 1) / 2) + e - 1, e)
            if self.deg_corr and not dense:
                s += self._degree_length(sizes, degrees)
        return s

    def _degree_length(self, sizes, degrees) -> float:
        """For each block the cheaper of two codes of its degree sequence."""
        from vertexloom.operators.degree import degree

        d = degree(self.graph, "out", name="k_out")
        d = d.join(degree(self.graph, "in", name="k_in"), "id") if self.graph.directed else d.withColumn("k_in", F.lit(0))
        hist = d.join(self.blocks, "id").groupBy("block", "k_out", "k_in").count().groupBy("block").agg(F.collect_list("count").alias("n")).collect()
        total = 0.0
        for row in hist:
            n, e_out = sizes[row["block"]], degrees[row["block"]]["e_out"]
            e_in = degrees[row["block"]]["e_in"] if self.graph.directed else 0
            first = fast_partitions(n, e_out) + fast_partitions(n, e_in) + math.lgamma(n + 1) - sum(math.lgamma(c + 1) for c in row["n"])
            second = lbinom(n + e_out - 1, e_out) + (lbinom(n + e_in - 1, e_in) if self.graph.directed else 0.0)
            total += min(first, second)
        return total


def vertex_marginals(samples: DataFrame) -> DataFrame:
    """id, block and n from sampled partitions (sample, id, block)."""
    return samples.groupBy("id", "block").agg(F.count(F.lit(1)).alias("n"))


def edge_marginals(g: Graph, samples: DataFrame) -> DataFrame:
    """eid, r, s and n."""
    s = samples.select("sample", F.col("id").alias("src"), F.col("block").alias("r"))
    t = samples.select("sample", F.col("id").alias("dst"), F.col("block").alias("s"))
    return g.edges.join(s, "src").join(t, ["sample", "dst"]).groupBy("eid", "r", "s").agg(F.count(F.lit(1)).alias("n"))


def _mean_entropy(marginals: DataFrame, key: list[str]) -> DataFrame:
    total = marginals.groupBy(*key).agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    return marginals.join(total, key).groupBy(*key).agg((-F.sum(p * F.log(p))).alias("h"))


def mf_entropy(marginals: DataFrame) -> DataFrame:
    """Mean-field entropy: the sum over vertices of their marginals' entropy."""
    return _mean_entropy(marginals, ["id"]).agg(F.coalesce(F.sum("h"), F.lit(0.0)).alias("entropy"))


def bethe_entropy(g: Graph, samples: DataFrame) -> DataFrame:
    """Sum of edge entropies, less (degree - 1) times the vertex entropies."""
    from vertexloom.operators.degree import degree

    e = _mean_entropy(edge_marginals(g, samples), ["eid"]).agg(F.coalesce(F.sum("h"), F.lit(0.0)).alias("e"))
    v = _mean_entropy(vertex_marginals(samples), ["id"]).join(degree(g, "total", name="k"), "id").agg(F.coalesce(F.sum((F.col("k") - 1) * F.col("h")), F.lit(0.0)).alias("v"))
    return e.join(v).select((F.col("e") - F.col("v")).alias("entropy"))


def overlap_sets(half_blocks: DataFrame) -> DataFrame:
    """node and its blocks with the number of half-edges in each, from (node, block) rows of half-edges."""
    n = half_blocks.groupBy("node", "block").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("block", "n"))).alias("blocks"))


def majority_blocks(half_blocks: DataFrame) -> DataFrame:
    """node and the block of most of its half-edges, the smaller of equals."""
    n = half_blocks.groupBy("node", "block").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("node").agg(F.min_by("block", F.struct(-F.col("n"), "block")).alias("block"))


def nonoverlap_blocks(half_blocks: DataFrame) -> DataFrame:
    """node and a number for its set of blocks."""
    sets = half_blocks.groupBy("node").agg(F.sort_array(F.collect_set("block")).alias("k"))
    from vertexloom.operators.degree import continuous

    return continuous(sets, "k", "block").select("node", "block")


def label_propagation(g: Graph, rounds: int = 10, gamma: float = 1.0, seed: int = 0) -> DataFrame:
    """id and spin: synchronous sweeps of a Potts model at zero temperature. Half of the vertices (by hash and round) move
    to the spin with the largest weight of neighbours less ``gamma`` times what a random graph gives."""
    from vertexloom.operators.degree import degree
    from vertexloom.plans.iterate import cut

    a = cut(g.as_undirected().adjacency.where("src <> dst").select("src", "dst"))
    k = cut(degree(g.as_undirected(), "total", name="k"))
    two_e = float(a.count() or 1)
    state = cut(k.select("id", "k", F.col("id").alias("spin")))
    for r in range(rounds):
        mass = state.groupBy("spin").agg(F.sum("k").alias("mass"))
        pull = a.join(state.select(F.col("id").alias("dst"), "spin"), "dst").groupBy(F.col("src").alias("id"), "spin").agg(F.count(F.lit(1)).alias("n"))
        own = state.select("id", "k", F.col("spin").alias("was"))
        score = pull.join(mass, "spin").join(own, "id").withColumn("v", F.col("n") - gamma * F.col("k") * (F.col("mass") - F.when(F.col("spin") == F.col("was"), F.col("k")).otherwise(0)) / two_e)
        best = score.groupBy("id").agg(F.min_by("spin", F.struct(-F.col("v"), "spin")).alias("new"))
        moves = F.pmod(F.xxhash64("id", F.lit(seed), F.lit(r)), F.lit(2)) == 0
        state = cut(state.join(best, "id", "left").select("id", "k", F.when(moves, F.coalesce("new", "spin")).otherwise(F.col("spin")).alias("spin")))
    return state.select("id", "spin")


class LocalBlocks:
    """Block state of a small graph on the driver, for moves one vertex at a time."""

    def __init__(self, local: Local, block: dict[int, int], deg_corr: bool = True, layers: dict[int, int] | None = None):
        self.g, self.b, self.deg_corr = local, dict(block), deg_corr
        self.layer = layers or {}
        self.e: Counter = Counter()
        self.out: Counter = Counter()
        self.into: Counter = Counter()
        self.n: Counter = Counter(self.b.values())
        self.ends = defaultdict(list)
        for eid, s, t in local.edges:
            self._count(eid, self.b[s], self.b[t], 1)
            self.ends[s].append((eid, t))
            if s != t:
                self.ends[t].append((eid, s))
        self.by_end = {eid: (s, t) for eid, s, t in local.edges}

    def _count(self, eid, r, s, n):
        if not self.g.directed and s < r:
            r, s = s, r
        self.e[self.layer.get(eid, 0), r, s] += n
        self.out[r] += n
        self.into[s] += n

    def _block_term(self, r) -> float:
        """What depends on a block's totals."""
        if self.g.directed:
            a, b, f = self.out[r], self.into[r], 1.0
        else:
            a = b = self.out[r] + self.into[r]
            f = 0.5
        return f * ((xlogx(a) + xlogx(b)) if self.deg_corr else (a + b) * math.log(self.n[r]) if self.n[r] else 0.0)

    def _pair_term(self, key) -> float:
        _, r, s = key
        x = self.e[key]
        return -0.5 * xlogx(2 * x) if not self.g.directed and r == s else -xlogx(x)

    def entropy(self) -> float:
        m = sum(self.e.values())
        return sum(self._pair_term(k) for k in list(self.e)) + sum(self._block_term(r) for r in self.n if self.n[r]) + (-m if self.deg_corr else m)

    def move(self, v, r) -> float:
        """Moves the vertex and returns the change of the entropy."""
        old = self.b[v]
        if old == r:
            return 0.0
        keys, blocks = set(), {old, r}
        edges = [(eid, *self.by_end[eid]) for eid, _ in self.ends[v]]
        for eid, s, t in edges:
            for new in (old, r):
                a, b = (new if s == v else self.b[s]), (new if t == v else self.b[t])
                if not self.g.directed and b < a:
                    a, b = b, a
                keys.add((self.layer.get(eid, 0), a, b))
                blocks |= {a, b}
        before = sum(self._pair_term(k) for k in keys) + sum(self._block_term(x) for x in blocks)
        for eid, s, t in edges:
            self._count(eid, self.b[s], self.b[t], -1)
        self.n[old] -= 1
        self.n[r] += 1
        self.b[v] = r
        for eid, s, t in edges:
            self._count(eid, self.b[s], self.b[t], 1)
        return sum(self._pair_term(k) for k in keys) + sum(self._block_term(x) for x in blocks) - before

    def sweep(self, rng: random.Random, beta: float = 1.0, c: float = 1.0) -> tuple[float, int]:
        """Metropolis-Hastings over all vertices in random order: the change of the entropy and the number of moves."""
        ds, moves = 0.0, 0
        blocks = sorted(r for r in self.n if self.n[r])
        for v in rng.sample(sorted(self.b), len(self.b)):
            r = self.b[v]
            if self.n[r] == 1 and math.isinf(beta):
                continue
            s, forward = self._propose(rng, v, blocks, c)
            if s == r:
                continue
            delta = self.move(v, s)
            _, back = None, self._chance(v, r, len(blocks), c)
            if math.isinf(beta):
                accept = delta < 0
            else:
                a = -beta * delta + math.log(back or 1e-300) - math.log(forward or 1e-300)
                accept = a > 0 or rng.random() < math.exp(a)
            if accept:
                ds, moves = ds + delta, moves + 1
            else:
                self.move(v, r)
        return ds, moves

    def _between(self, t, s) -> int:
        return sum(self.e[k] for k in ((y, *p) for y in set(self.layer.values()) | {0} for p in {(t, s), (s, t)}))

    def _propose(self, rng, v, blocks, c):
        if not self.ends[v]:
            return rng.choice(blocks), 1 / len(blocks)
        t = self.b[rng.choice(self.ends[v])[1]]
        e_t = self.out[t] + self.into[t]
        if rng.random() < c * len(blocks) / (e_t + c * len(blocks)):
            s = rng.choice(blocks)
        else:
            s = rng.choices(blocks, [self._between(t, x) + 1e-12 for x in blocks])[0]
        return s, self._chance(v, s, len(blocks), c)

    def _chance(self, v, s, b, c) -> float:
        if not self.ends[v]:
            return 1 / b
        return sum((self._between(self.b[u], s) + c) / (self.out[self.b[u]] + self.into[self.b[u]] + c * b) for _, u in self.ends[v]) / len(self.ends[v])

    def merge(self, to: int, rng: random.Random) -> None:
        """Greedy merges of the pair of blocks that costs least, until ``to`` blocks are left."""
        while (live := sorted(r for r in self.n if self.n[r])) and len(live) > to:
            best = None
            for r in live:
                near = {self.b[u] for v, b in self.b.items() if b == r for _, u in self.ends[v]} - {r} or set(live) - {r}
                for s in sorted(near):
                    cost = self._merge_cost(r, s)
                    if best is None or cost < best[0]:
                        best = (cost, r, s)
            _, r, s = best
            for v in [v for v, b in self.b.items() if b == r]:
                self.move(v, s)

    def _merge_cost(self, r, s) -> float:
        members = [v for v, b in self.b.items() if b == r]
        cost = sum(self.move(v, s) for v in members)
        for v in members:
            self.move(v, r)
        return cost

    def length(self) -> float:
        """Entropy with the partition's and the block matrix's description."""
        sizes, m = [x for x in self.n.values() if x], len(self.g.edges)
        b = len(sizes)
        return self.entropy() + partition_entropy(sizes) + lbinom((b * b if self.g.directed else b * (b + 1) / 2) + m - 1, m)


def minimize_blocks(g: Graph, blocks: int | None = None, sweeps: int = 5, seed: int = 0, deg_corr: bool = True, at_most: int = 5_000, layer: str | None = None) -> tuple[float, dict[int, int]]:
    """Description length and id -> block of a small graph: merges from single vertices down, with greedy sweeps between, keeping the
    shortest (or stopping at ``blocks``). The graph must have at most ``at_most`` edges: it is collected."""
    local = Local.of(g, at_most)
    layers = {r["eid"]: r[layer] for r in g.edges.select("eid", layer).collect()} if layer else None
    rng = random.Random(seed)
    state = LocalBlocks(local, {v: k for k, v in enumerate(sorted(local.vertices))}, deg_corr, layers)
    best, count = None, len(local.vertices)
    while count >= (blocks or 1):
        for _ in range(sweeps):
            if not state.sweep(rng, math.inf)[1]:
                break
        if best is None or blocks is not None or state.length() < best[0]:
            best = (state.length(), dict(state.b))
        if count == (blocks or 1):
            break
        count = max(blocks or 1, int(sum(1 for x in state.n.values() if x) / 1.6))
        state.merge(count, rng)
    names = {b: k for k, b in enumerate(sorted(set(best[1].values())))}
    return best[0], {v: names[b] for v, b in best[1].items()}


def minimize_nested(g: Graph, seed: int = 0, at_most: int = 5_000) -> list[dict[int, int]]:
    """Levels of partitions, each of the block graph below, until one block is left."""
    levels = []
    while True:
        _, b = minimize_blocks(g, seed=seed, at_most=at_most)
        levels.append(b)
        if len(set(b.values())) <= 1 or len(set(b.values())) == len(b):
            return levels
        spark = g.edges.sparkSession
        rows = spark.createDataFrame(sorted(b.items()), "id long, block long")
        e = g.edges.join(F.broadcast(rows.toDF("src", "bs")), "src").join(F.broadcast(rows.toDF("dst", "bd")), "dst")
        g = Graph(rows.select(F.col("block").alias("id")).distinct(), e.select("eid", F.col("bs").alias("src"), F.col("bd").alias("dst")), g.directed)


def hierarchy_tree(spark, levels: list[dict[int, int]]) -> Graph:
    """Edges from each vertex (level, id) to its block one level up, with ids numbered level after level."""
    rows, off = [], 0
    for level in levels:
        size = max(level) + 1
        rows += [(off + size + b, off + v) for v, b in sorted(level.items())]
        off += size
    return Graph.from_edges(spark.createDataFrame(rows, "src long, dst long"))


def nested_stack(g: Graph, levels: list[dict[int, int]], deg_corr: bool = True) -> list[BlockState]:
    """The state of each level: its graph is the multigraph of the blocks below, an edge for each of ``g``."""
    spark, out = g.edges.sparkSession, []
    for level, blocks in enumerate(levels):
        rows = spark.createDataFrame(sorted(blocks.items()), "id long, block long")
        out.append(BlockState(g, rows, deg_corr and not level))
        e = g.edges.join(rows.toDF("src", "bs"), "src").join(rows.toDF("dst", "bd"), "dst")
        g = Graph(rows.select(F.col("block").alias("id")).distinct(), e.select("eid", F.col("bs").alias("src"), F.col("bd").alias("dst")), g.directed)
    return out


def nested_entropy(g: Graph, levels: list[dict[int, int]], deg_corr: bool = True) -> list[float]:
    """What each level adds to the description length; upper ones in the dense multigraph form."""
    return [s.entropy(dense=n > 0, multigraph=True, dl=True, edges_dl=False) for n, s in enumerate(nested_stack(g, levels, deg_corr))]


def project_level(levels: list[dict[int, int]], level: int) -> dict[int, int]:
    """Vertices to their blocks at a level."""
    out = dict(levels[0])
    for up in levels[1 : level + 1]:
        out = {v: up[b] for v, b in out.items()}
    return out
