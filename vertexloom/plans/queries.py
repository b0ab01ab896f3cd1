"""The registered queries over the supplied tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.functions import special
from vertexloom.graph import Graph
from vertexloom.operators import centrality, clustering, community, components, correlations, degree, flow, layout, paths, spectral, stats, transform
from vertexloom.plans import iterate
from vertexloom.plans.testgraphs import POINTS, SIMPLE, SUPPLY, TREE, USERS, VISITS, points, simple_users, supply, table, tree, users, visits
from vertexloom.sources import formats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql
        return f

    return register


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), places) for c in columns})


# Degrees and properties

for _kind, _sql in (("out", "select src as id, w from e"), ("in", "select dst as id, w from e"), ("total", "select src as id, w from e union all select dst, w from e")):
    query(f"with {USERS}, x as ({_sql}) select v.id, count(x.id) as degree from v left join x on x.id = v.id group by v.id", f"degree_{_kind}")(lambda s, d, k=_kind: degree.degree(users(s, d), k))
    query(f"with {USERS}, x as ({_sql}) select v.id, round(coalesce(sum(x.w), 0), 6) as degree from v left join x on x.id = v.id group by v.id", f"degree_weighted_{_kind}")(lambda s, d, k=_kind: rounded(degree.degree(users(s, d), k, "w"), "degree"))


@query(f"with {USERS} select eid, score from (select e.eid, round(v.score, 6) as score from e join v on v.id = e.src)")
def edge_endpoint_source(s, d):
    return rounded(degree.edge_endpoint(users(s, d), "score", "source", "score"), "score")


@query(f"with {USERS} select e.eid, round(v.score, 6) as score from e join v on v.id = e.dst")
def edge_endpoint_target(s, d):
    return rounded(degree.edge_endpoint(users(s, d), "score", "target", "score"), "score")


for _op in ("sum", "min", "max"):
    query(f"with {USERS} select v.id, round(coalesce({_op}(e.w), 0), 6) as value from v left join e on e.src = v.id group by v.id", f"incident_{_op}")(lambda s, d, o=_op: rounded(degree.incident(users(s, d), o, "w"), "value"))


@query(f"with {VISITS}, x as (select *, 1 + (eid % 3) as f from t) select v.id, round(coalesce(product(x.f), 0), 6) as value from v left join x on x.dst = v.id group by v.id")
def incident_prod(s, d):
    g = visits(s, d)
    return rounded(degree.incident(g.with_edges(g.edges.withColumn("f", 1 + F.col("eid") % 3)), "prod", "f", "in"), "value")


@query(f"with {VISITS}, c as (select dst as id, min(v.id) as m from t join v on v.id = t.src where v.block in (1, 2) group by dst) select v.id, coalesce(c.m % 5, v.block) as block from v left join c using (id)")
def infect_property(s, d):
    return degree.infect(visits(s, d), "block", [1, 2])


@query(f"with {USERS} select id, events from v where events between 40 and 80")
def find_vertex_range(s, d):
    return degree.find_vertex(users(s, d), "events", 40, 80).select("id", "events")


@query(f"with {USERS}, k as (select src as id, count(*) as n from e group by src) select id, n as degree from k where n between 60 and 70")
def find_vertex_degree(s, d):
    g = users(s, d)
    return degree.find_vertex(g, "out", 60, 70).select("id").join(degree.degree(g, "out"), "id")


@query(f"with {USERS} select eid, src, dst, round(w, 6) as w from e where w between 10 and 20")
def find_edge_range(s, d):
    return rounded(degree.find_edge(users(s, d), "w", 10.0, 20.0).select("eid", "src", "dst", "w"), "w")


@query(f"with {USERS} select eid, src, dst from e where label = 'click'")
def find_edge_label(s, d):
    return degree.find_edge(users(s, d), "label", "click").select("eid", "src", "dst")


@query(f"with {USERS} select eid, src, dst, label from e where label <> 'view' and src in (select id from v where block <> 0) and dst in (select id from v where block <> 0)")
def graph_view(s, d):
    return users(s, d).view(F.col("block") != 0, F.col("label") != "view").edges.select("eid", "src", "dst", "label")


@query(f"with {USERS} select eid, dst as src, src as dst from e")
def reversed_graph(s, d):
    return users(s, d).reversed().edges.select("eid", "src", "dst")


@query(f"with {USERS}, m as (select min(id) as id from v) select eid, dst as id from e where src = (select id from m) union all select eid, src from e where dst = (select id from m)")
def all_neighbours(s, d):
    g = users(s, d)
    first = g.vertices.agg(F.min("id")).first()[0]
    return degree.neighbours(g, first, "all")


@query(f"with {USERS}, k as (select label as k from e union select event_type from events), c as (select k, dense_rank() over (order by k) - 1 as hash from k) select e.eid, c.hash from e join c on c.k = e.label")
def perfect_prop_hash(s, d):
    e = users(s, d).edges
    return degree.perfect_hash([(e, "label"), (table(s, d, "events"), "event_type")])[0].select("eid", "hash")


@query(f"with {USERS} select id, dense_rank() over (order by events) - 1 as code from v")
def continuous_map(s, d):
    return degree.continuous(users(s, d).vertices, "events", "code").select("id", "code")


@query(f"with {USERS}, k as (select src as id, count(*) as n from e group by 1), r as (select min(n) as a, max(n) as b from k) select id, round(1 + 4 * pow((n - a)::double / (b - a), 0.5), 6) as size from k, r")
def prop_to_size(s, d):
    g = users(s, d)
    return rounded(degree.to_size(g.edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n")), "n", 1.0, 5.0).select("id", "size"), "size")


@query("select vec_id as id, round(embedding[1]::double, 6) as a, round(embedding[3]::double, 6) as b from embeddings")
def group_vector(s, d):
    t = table(s, d, "embeddings")
    pair = degree.ungrouped(t, "embedding", [0, 1, 2], ["x", "y", "z"])
    back = degree.ungrouped(degree.grouped(pair, ["x", "z"], "v"), "v", [0, 1], ["a", "b"])
    return rounded(back.select(F.col("vec_id").alias("id"), "a", "b"), "a", "b")


# Statistics

_BINNED = "with {g}, h as (select floor(({x} - {o}) / {w})::bigint as b, count(*) as n from {t} where {x} >= {o} group by 1), r as (select unnest(generate_series(0, (select max(b) from h))) as b) select round({o} + r.b * {w}, 6) as bin_left, coalesce(h.n, 0) as count from r left join h on h.b = r.b"


@query(_BINNED.format(g=USERS + ", k as (select v.id, count(e.eid) as x from v left join e on e.src = v.id group by v.id)", x="x", o="0.0", w="5.0", t="k"))
def vertex_hist(s, d):
    return rounded(stats.vertex_hist(users(s, d), "out", [0.0, 5.0]), "bin_left")


@query(f"""with {USERS}, k as (select v.id, count(e.eid) as x from v left join e on e.dst = v.id group by v.id), b as (select * from (values (0.0, 40.0), (40.0, 60.0), (60.0, 65.0), (65.0, 100.0)) as t(lo, hi))
select lo::double as bin_left, count(k.id) as count from b left join k on k.x >= lo and k.x < hi group by lo""")
def vertex_hist_irregular(s, d):
    return stats.vertex_hist(users(s, d), "in", [0, 40, 60, 65, 100])


@query(_BINNED.format(g=USERS, x="w", o="0.0", w="10.0", t="e"))
def edge_hist(s, d):
    return rounded(stats.edge_hist(users(s, d), "w", [0.0, 10.0]), "bin_left")


@query(f"with {USERS}, k as (select v.id, count(e.eid) as x from v left join e on e.src = v.id group by v.id) select round(avg(x), 6) as mean, round(stddev_pop(x) / sqrt(count(x)), 6) as std_err from k")
def vertex_average(s, d):
    return rounded(stats.vertex_average(users(s, d), "out"), "mean", "std_err")


@query(f"with {USERS} select round(avg(w), 6) as mean, round(stddev_pop(w) / sqrt(count(w)), 6) as std_err from e")
def edge_average(s, d):
    return rounded(stats.edge_average(users(s, d), "w"), "mean", "std_err")


@query("with x as (select unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as pos from embeddings) select pos, round(avg(x::double), 6) as mean, round(stddev_pop(x::double) / sqrt(count(x)), 6) as std_err from x group by pos")
def vector_average(s, d):
    t = table(s, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("e"))
    return rounded(stats.vector_average(t, "e"), "mean", "std_err").select(F.col("pos").cast("long").alias("pos"), "mean", "std_err")


@query(f"with {USERS} select eid, row_number() over (partition by src, dst order by eid) - 1 as label from e")
def label_parallel_edges(s, d):
    return stats.label_parallel_edges(users(s, d))


@query(f"with {USERS} select eid, row_number() over (partition by least(src, dst), greatest(src, dst) order by eid) > 1 as label from e")
def mark_parallel_edges_undirected(s, d):
    return stats.label_parallel_edges(users(s, d).as_undirected(), True)


@query(f"with {USERS} select min(eid) as eid, src, dst from e group by src, dst")
def remove_parallel_edges(s, d):
    return stats.remove_parallel_edges(users(s, d)).edges.select("eid", "src", "dst")


@query(f"with {USERS} select eid, case when src = dst then row_number() over (partition by src, src = dst order by eid) else 0 end as label from e")
def label_self_loops(s, d):
    return stats.label_self_loops(users(s, d))


@query(f"with {USERS} select eid, src, dst from e where src <> dst")
def remove_self_loops(s, d):
    return stats.remove_self_loops(users(s, d)).edges.select("eid", "src", "dst")


@query(f"with {USERS}, l as (select eid, src, dst, row_number() over (partition by src, dst order by eid) - 1 as label from e) select eid, src, dst from l where label <= 0")
def remove_labeled_edges(s, d):
    g = users(s, d)
    return stats.remove_labeled_edges(g, stats.label_parallel_edges(g)).edges.select("eid", "src", "dst")


# Correlations

_DEG = USERS + ", ko as (select v.id, count(e.eid) as k from v left join e on e.src = v.id group by v.id), ki as (select v.id, count(e.eid) as k from v left join e on e.dst = v.id group by v.id)"


@query(f"""with {USERS}, p as (select a.block as x, b.block as y, count(*)::double as n from e join v a on a.id = e.src join v b on b.id = e.dst group by 1, 2),
a as (select x, sum(n) as a from p group by x), b as (select y, sum(n) as b from p group by y), t as (select sum(n) as e, sum(case when x = y then n else 0 end) as same from p),
ab as (select sum(a.a * b.b) as ab from a join b on a.x = b.y), o as (select e, same, ab, same / e as t1, ab / (e * e) as t2 from t, ab), r as (select *, (t1 - t2) / (1 - t2) as r from o),
l as (select p.n, r.r, (same - case when p.x = p.y then 1 else 0 end) / (e - 1) as l1, (ab - coalesce(b.b, 0) - coalesce(a.a, 0)) / ((e - 1) * (e - 1)) as l2 from p cross join r left join a on a.x = p.y left join b on b.y = p.x)
select round(any_value(r), 6) as r, round(sqrt(sum(n * pow(r - (l1 - l2) / (1 - l2), 2))), 6) as sigma from l""")
def assortativity(s, d):
    return rounded(correlations.assortativity(users(s, d), "block"), "r", "sigma")


@query(f"""with {_DEG}, r as (select a.k::double as x, b.k::double as y from e join ko a on a.id = e.src join ko b on b.id = e.dst),
s as (select count(*)::double as n, sum(x) as sx, sum(y) as sy, sum(x * x) as sxx, sum(y * y) as syy, sum(x * y) as sxy from r),
l as (select (sxy / n - sx / n * (sy / n)) / (sqrt(sxx / n - pow(sx / n, 2)) * sqrt(syy / n - pow(sy / n, 2))) as r,
((sxy - x * y) / (n - 1) - (sx - x) / (n - 1) * ((sy - y) / (n - 1))) / (sqrt((sxx - x * x) / (n - 1) - pow((sx - x) / (n - 1), 2)) * sqrt((syy - y * y) / (n - 1) - pow((sy - y) / (n - 1), 2))) as rl from r, s)
select round(any_value(r), 6) as r, round(sqrt(sum(pow(r - rl, 2))), 6) as sigma from l""")
def scalar_assortativity(s, d):
    return rounded(correlations.scalar_assortativity(users(s, d), "out"), "r", "sigma")


@query(f"with {_DEG} select floor(a.k / 5) * 5.0::double as x_left, floor(b.k / 10) * 10.0::double as y_left, count(*)::double as count from e join ko a on a.id = e.src join ki b on b.id = e.dst group by 1, 2")
def corr_hist(s, d):
    return correlations.corr_hist(users(s, d), "out", "in", ([0.0, 5.0], [0.0, 10.0]))


@query(f"with {_DEG} select floor(ko.k / 5) * 5.0::double as x_left, floor(ki.k / 10) * 10.0::double as y_left, count(*)::double as count from ko join ki using (id) group by 1, 2")
def combined_corr_hist(s, d):
    return correlations.combined_corr_hist(users(s, d), "out", "in", ([0.0, 5.0], [0.0, 10.0]))


_AVG = "select bin_left, round(sum(k * w) / sum(w), 6) as mean, round(sqrt(abs(sum(k * w * k * w) / sum(w) - pow(sum(k * w) / sum(w), 2))) / sqrt(sum(w)), 6) as std_err from x group by bin_left"


@query(f"with {_DEG}, x as (select floor(a.k / 5) * 5.0::double as bin_left, b.k::double as k, e.w from e join ko a on a.id = e.src join ki b on b.id = e.dst) {_AVG}")
def avg_neighbour_corr(s, d):
    return rounded(correlations.avg_neighbour_corr(users(s, d), "out", "in", [0.0, 5.0], "w"), "mean", "std_err")


@query(f"with {_DEG}, x as (select floor(ko.k / 5) * 5.0::double as bin_left, ki.k::double as k, 1.0::double as w from ko join ki using (id)) {_AVG}")
def avg_combined_corr(s, d):
    return rounded(correlations.avg_combined_corr(users(s, d), "out", "in", [0.0, 5.0]), "mean", "std_err")


# Clustering

_TRI = SIMPLE + """, tri as (select a.src as x, a.dst as y, b.dst as z from s a join s b on b.src = a.dst join s c on c.src = a.src and c.dst = b.dst),
tv as (select id, count(*) as t from (select x as id from tri union all select y from tri union all select z from tri) group by id), kv as (select src as id, count(*) as k from u group by src),
lc as (select v.id, coalesce(t, 0) as t, coalesce(k * (k - 1) / 2, 0) as n from v left join tv using (id) left join kv using (id))"""


@query(f"with {_TRI} select id, round(case when n > 0 then t / n else 0 end, 6) as clustering from lc")
def local_clustering(s, d):
    return rounded(clustering.local_clustering(users(s, d)), "clustering")


@query(f"with {_TRI}, a as (select sum(t) as t, sum(n) as n from lc) select round(any_value(a.t / a.n), 6) as clustering, round(sqrt(sum(pow(a.t / a.n - (a.t - lc.t) / (a.n - lc.n), 2))), 6) as std_err from lc, a")
def global_clustering(s, d):
    return rounded(clustering.global_clustering(users(s, d)), "clustering", "std_err")


@query(f"with {_TRI} select count(*) as triangles from tri")
def triangle_count(s, d):
    return clustering.triangles(users(s, d)).agg(F.count(F.lit(1)).alias("triangles"))


_EXT = VISITS + """, st as (select src as v, dst as s from b), d1 as (select st.v, st.s, b.dst as x from st join b on b.src = st.s where b.dst <> st.v and b.dst <> st.s group by all),
d2 as (select d1.v, d1.s, b.dst as x from d1 join b on b.src = d1.x where b.dst <> d1.v and b.dst <> d1.s and not exists (select 1 from d1 o where o.v = d1.v and o.s = d1.s and o.x = b.dst) group by all),
k as (select v, count(*) * (count(*) - 1) as n from st group by v), h as (select 1 as depth, * from d1 union all select 2, * from d2), c as (select h.depth, h.v, count(*) as c from h join st on st.v = h.v and st.s = h.x group by 1, 2),
g as (select v.id, unnest([1, 2]) as depth from v)"""


@query(f"with {_EXT} select g.id, g.depth::int as depth, round(case when k.n > 0 then coalesce(c.c, 0) / k.n else 0 end, 6) as clustering from g left join k on k.v = g.id left join c on c.v = g.id and c.depth = g.depth")
def extended_clustering(s, d):
    return rounded(clustering.extended_clustering(visits(s, d).as_undirected(), 2), "clustering")


@query(f"with {_TRI}, w as (select sum(n) as n from lc), t as (select count(*) as t from tri) select * from (select 3::bigint as motif, (w.n - 3 * t.t)::bigint as count from w, t union all select 7, t.t from t) where count > 0")
def motifs3(s, d):
    return clustering.motifs(simple_users(s, d), 3)


# Connected sets of four by their numbers of edges and largest degrees; the numbers of the motifs are their least bit sets.
_MOTIFS4 = VISITS + """, s3 as (select distinct list_sort([a.src, a.dst, c.dst]) as s from b a join b c on c.src = a.dst where a.src < a.dst and c.dst <> a.src
union select distinct list_sort([a.src, a.dst, c.dst]) from b a join b c on c.src = a.src where a.src < a.dst and c.dst <> a.dst),
s4 as (select distinct list_sort(list_append(s, b.dst)) as s from (select s, unnest(s) as x from s3) join b on b.src = x where not list_contains(s, b.dst)),
m4 as (select s, unnest(s) as x from s4), k4 as (select s, x, (select count(*) from b where b.src = x and list_contains(s, b.dst)) as k from m4),
f4 as (select s, sum(k) / 2 as e, max(k) as k from k4 group by s)"""


@query(f"with {_MOTIFS4} select case when e = 3 and k = 3 then 7 when e = 3 then 13 when e = 4 and k = 3 then 15 when e = 4 then 30 when e = 5 then 31 else 63 end::bigint as motif, count(*) as count from f4 group by 1")
def motifs4(s, d):
    return clustering.motifs(visits(s, d).as_undirected(), 4)


@query(f"with {VISITS} select a.src as v0, a.dst as v1, c.dst as v2 from p a join p c on c.src = a.dst where a.src <> c.dst")
def subgraph_path(s, d):
    return clustering.pattern_matches(stats.remove_self_loops(visits(s, d)), [(0, 1), (1, 2)])


@query(f"with {VISITS} select a.src as v0, a.dst as v1, c.dst as v2 from b a join b c on c.src = a.dst where a.src <> c.dst and not exists (select 1 from b x where x.src = a.src and x.dst = c.dst)")
def subgraph_path_induced(s, d):
    return clustering.pattern_matches(visits(s, d).as_undirected(), [(0, 1), (1, 2)], induced=True)


# Matrices


@query(f"with {USERS} select dst as i, src as j, round(sum(w), 6) as value from e group by 1, 2")
def adjacency(s, d):
    return rounded(spectral.adjacency(users(s, d), "w"), "value")


_LAP = SIMPLE + ", k as (select v.id, count(u.src)::double as k from v left join u on u.src = v.id group by v.id)"


@query(f"with {_LAP} select dst as i, src as j, -1.0::double as value from u union all select id, id, k from k")
def laplacian(s, d):
    return spectral.laplacian(simple_users(s, d))


@query(f"with {_LAP} select u.dst as i, u.src as j, round(-1 / sqrt(a.k * c.k), 6) as value from u join k a on a.id = u.src join k c on c.id = u.dst union all select id, id, case when k > 0 then 1.0 else 0.0 end from k")
def norm_laplacian(s, d):
    return rounded(spectral.laplacian(simple_users(s, d), normalized=True), "value")


@query(f"with {USERS} select i, j, sum(value) as value from (select src as i, eid as j, -1.0::double as value from e union all select dst, eid, 1.0 from e) group by i, j")
def incidence(s, d):
    return spectral.incidence(users(s, d))


@query(f"with {USERS}, k as (select src, sum(w) as k from e group by src) select e.dst as i, e.src as j, round(sum(e.w) / any_value(k.k), 6) as value from e join k on k.src = e.src group by 1, 2")
def transition(s, d):
    return rounded(spectral.transition(users(s, d), "w"), "value")


@query(f"with {_DEG}, x as (select id, (id % 7)::double as x from v), y as (select e.dst as id, sum(x.x) as y from e join x on x.id = e.src group by 1), t as (select sum(k) as e from ko), dt as (select sum(ki.k * x.x) as dot from ki join x using (id)) select ko.id, round(coalesce(y.y, 0) - ko.k * dt.dot / t.e, 6) as y from ko left join y using (id), t, dt")
def modularity_matvec(s, d):
    g = users(s, d)
    return rounded(spectral.modularity_matvec(g, g.vertices.select("id", (F.col("id") % 7).cast("double").alias("x"))), "y")


# Centralities, by a fixed number of steps that the SQL unrolls


def _steps(n: int, body: Callable[[int], str]) -> str:
    return ", ".join(f"r{k} as ({body(k)})" for k in range(1, n + 1))


_PAIR = USERS + ", a as (select src, dst, sum(w) as w, count(*)::double as c from e group by 1, 2), n as (select count(*)::double as n from v)"
_PR = _PAIR + ", o as (select src, sum(c) as k from a group by 1), q as (select a.src, a.dst, a.c / o.k as p from a join o using (src)), r0 as (select id, 1 / n.n as x from v, n), " + _steps(10, lambda k: f"select v.id, 0.15 / any_value(n.n) + 0.85 * coalesce(sum(r.x * q.p), 0) as x from v cross join n left join q on q.dst = v.id left join r{k - 1} r on r.id = q.src group by v.id")


@query(f"with {_PR} select id, round(x, 8) as rank from r10")
def pagerank10(s, d):
    return rounded(centrality.pagerank(users(s, d), epsilon=0, max_iter=10), "rank", places=8)


_KATZ = _PAIR + ", r0 as (select id, 1 / n.n as x from v, n), " + _steps(10, lambda k: f"select v.id, 1 + 0.001 * coalesce(sum(r.x * a.c), 0) as x from v left join a on a.dst = v.id left join r{k - 1} r on r.id = a.src group by v.id")


@query(f"with {_KATZ}, z as (select sqrt(sum(x * x)) as z from r10) select id, round(x / z, 8) as x from r10, z")
def katz10(s, d):
    return rounded(centrality.katz(users(s, d), alpha=0.001, epsilon=0, max_iter=10), "x", places=8)


_EIG = _PAIR + ", r0 as (select id, 1 / n.n as x from v, n), " + ", ".join(f"m{k} as (select v.id, coalesce(sum(r.x * a.w), 0) as x from v left join a on a.dst = v.id left join r{k - 1} r on r.id = a.src group by v.id), r{k} as (select id, x / (select sqrt(sum(x * x)) from m{k}) as x from m{k})" for k in range(1, 7))


@query(f"with {_EIG} select id, round(x, 8) as x from r6")
def eigenvector6(s, d):
    return rounded(centrality.eigenvector(users(s, d), "w", 0, 6)[1], "x", places=8)


_HITS = _PAIR + ", r0 as (select id, 1 / n.n as x, 1 / n.n as y from v, n), " + ", ".join(
    f"""x{k} as (select v.id, coalesce(sum(r.y * a.c), 0) as x from v left join a on a.dst = v.id left join r{k - 1} r on r.id = a.src group by v.id),
y{k} as (select v.id, coalesce(sum(r.x * a.c), 0) as y from v left join a on a.src = v.id left join r{k - 1} r on r.id = a.dst group by v.id),
r{k} as (select id, x / (select sqrt(sum(x * x)) from x{k}) as x, y / (select sqrt(sum(y * y)) from y{k}) as y from x{k} join y{k} using (id))""" for k in range(1, 5))


@query(f"with {_HITS} select id, round(x, 8) as authority, round(y, 8) as hub from r4")
def hits4(s, d):
    return rounded(centrality.hits(users(s, d), None, 0, 4)[1], "authority", "hub", places=8)


_TRUST = _PAIR + ", o as (select src, sum(w) as k from a group by 1), q as (select a.src, a.dst, a.w / o.k as p from a join o using (src)), r0 as (select id, 1 / n.n as x from v, n), " + _steps(8, lambda k: f"select v.id, coalesce(sum(r.x * q.p), 0) as x from v left join q on q.dst = v.id left join r{k - 1} r on r.id = q.src group by v.id")


@query(f"with {_TRUST} select id, round(x, 8) as trust from r8")
def eigentrust8(s, d):
    return rounded(centrality.eigentrust(users(s, d), "w", False, 0, 8), "trust", places=8)


_AVOID = VISITS + """, m as (select min(id) as id from v), c as (select src, dst, 1 / (1 + min(w)) as c from t where src <> dst group by 1, 2),
r0 as (select v.id as d, m.id as id, 1.0::double as x from v, m where v.id <> m.id and v.id // 1000000000 = m.id // 1000000000), """ + _steps(16, lambda k: f"select d, id, max(x) as x from (select d, id, x from r{k - 1} union all select r.d, c.dst, r.x * c.c from r{k - 1} r join c on c.src = r.id where c.dst <> r.d) group by d, id")


@query(f"with {_AVOID}, z as (select t.dst as id, sum(r.x * r.x / (1 + t.w)) / sum(r.x) as z from t join r16 r on r.d = t.dst and r.id = t.src where t.src <> t.dst group by 1) select v.id, round(case when v.id = m.id then 1 else coalesce(z.z, 0) end, 6) as trust from v cross join m left join z on z.id = v.id")
def trust_transitivity(s, d):
    g = visits(s, d)
    g = g.with_edges(g.edges.withColumn("t", 1 / (1 + F.col("w"))))
    return rounded(centrality.trust_transitivity(g, "t", g.vertices.agg(F.min("id")).first()[0]), "trust")


# Paths. The graph is sparse so that distances vary; SQL recursion is bounded by what has been reached.

_BFS = VISITS + ", m as (select min(src) as id from p)"
_REC = "bfs(id, dist) as (select id, 0 from m union select b.dst, bfs.dist + 1 from bfs join {a} b on b.src = bfs.id where bfs.dist < {n})"


def _first(g: Graph) -> int:
    return g.edges.where("src <> dst").agg(F.min("src")).first()[0]


@query("with recursive " + _BFS + ", " + _REC.format(a="p", n=24) + ", f as (select id, min(dist)::double as dist from bfs group by id) select v.id, f.dist from v left join f using (id)")
def bfs_distance(s, d):
    g = visits(s, d)
    return paths.shortest_distance(g, _first(g))


_ALL = VISITS + ", d(root, id, dist) as (select id, id, 0 from v union select d.root, b.dst, d.dist + 1 from d join b on b.src = d.id where d.dist < 16), dd as (select root, id, min(dist)::double as dist from d group by 1, 2)"


@query("with recursive " + _ALL + " select root, id, dist from dd")
def all_distances(s, d):
    return paths.all_distances(visits(s, d).as_undirected())


@query("with recursive " + _ALL + ", h as (select floor(dist)::bigint as b, count(*) as n from dd where root <> id group by 1), r as (select unnest(generate_series(0, (select max(b) from h))) as b) select r.b::double as bin_left, coalesce(h.n, 0) as count from r left join h using (b)")
def distance_histogram(s, d):
    return paths.distance_histogram(visits(s, d).as_undirected(), [0.0, 1.0])


@query("with recursive " + _ALL + " select root as id, round(sum(case when id <> root then 1 else 0 end) / sum(case when id <> root then dist end), 6) as closeness from dd group by root")
def closeness(s, d):
    return rounded(paths.closeness(visits(s, d).as_undirected()), "closeness")


@query("with recursive " + _ALL + " select root as id, round(coalesce(sum(case when id <> root then 1 / dist end), 0) / ((select count(*) from v) - 1), 6) as closeness from dd group by root")
def closeness_harmonic(s, d):
    return rounded(paths.closeness(visits(s, d).as_undirected(), harmonic=True), "closeness")


_W = USERS + ", q as (select src, dst, min(w) as w from (select src, dst, round(w, 2) + 1 as w from e union all select dst, src, round(w, 2) + 1 from e) where src <> dst group by 1, 2), m as (select min(id) as id from v), r0 as (select id, 0.0::double as x from m), " + _steps(12, lambda k: f"select id, min(x) as x from (select id, x from r{k - 1} union all select q.dst, r.x + q.w from r{k - 1} r join q on q.src = r.id) group by id")


def _weighted(s, d) -> tuple[Graph, int]:
    g = users(s, d)
    g = g.with_edges(g.edges.withColumn("c", F.round("w", 2) + 1)).as_undirected()
    return g, g.vertices.agg(F.min("id")).first()[0]


@query(f"with {_W} select v.id, round(r12.x, 6) as dist from v left join r12 using (id)")
def weighted_distance(s, d):
    g, first = _weighted(s, d)
    return rounded(paths.shortest_distance(g, first, "c"), "dist")


@query(f"with {_W} select v.id, round(r12.x, 6) as dist from v left join r12 using (id)")
def bellman_ford(s, d):
    g, first = _weighted(s, d)
    return rounded(paths.bellman_ford(g, first, "c")[1], "dist")


@query(f"with {_W}, f as (select id, x from r12 where id = (select max(id) from v)) select round(x, 6) as length from f")
def shortest_path_length(s, d):
    g, first = _weighted(s, d)
    path = paths.shortest_path(g, first, g.vertices.agg(F.max("id")).first()[0], "c")
    return rounded(path.join(g.edges.select("eid", "c"), "eid").agg(F.sum("c").alias("length")), "length")


_SWEEP = _ALL + ", m as (select min(src) as id from p), k as (select id, count(*) as k from (select src as id from t union all select dst from t) group by id), o as (select root, id, dist, row_number() over (partition by root order by dist desc, k, id) as n from dd join k using (id)), f0 as (select m.id as spot, -1.0::double as best from m), " + ", ".join(
    f"f{n} as (select case when o.dist > best then o.id else spot end as spot, greatest(best, o.dist) as best from f{n - 1} join o on o.root = spot and o.n = 1)" for n in range(1, 9)
)


@query(f"with recursive {_W}, f as (select min(q.src) as pred, q.dst as id from q join r12 a on a.id = q.src join r12 z on z.id = q.dst where abs(a.x + q.w - z.x) < 1e-9 group by q.dst), go(id, n) as (select max(id), 0 from v union all select f.pred, n + 1 from go join f using (id)) select id, (select max(n) from go) - n as step from go")
def shortest_path(s, d):
    g, first = _weighted(s, d)
    return paths.shortest_path(g, first, g.vertices.agg(F.max("id")).first()[0], "c").select("step", "id")


@query("with recursive " + _SWEEP + " select best as length from f8")
def pseudo_diameter(s, d):
    g = visits(s, d).as_undirected()
    length, a, b = paths.pseudo_diameter(g, _first(g))
    return s.createDataFrame([(length,)], "length double")


_DEPTH = 16
_SIGMA = _ALL + """, m as (select src, dst, count(*) as c from (select src, dst from t union all select dst, src from t) where src <> dst group by 1, 2),
g0 as (select id as root, id, 1.0::double as s from v), """ + ", ".join(f"g{k} as (select g.root, m.dst as id, sum(g.s * m.c) as s from g{k - 1} g join m on m.src = g.id join dd on dd.root = g.root and dd.id = m.dst and dd.dist = {k} group by 1, 2)" for k in range(1, _DEPTH)) + ", g as (select g.root, g.id, g.s, dd.dist from (" + " union all ".join(f"select * from g{k}" for k in range(_DEPTH)) + ") g join dd using (root, id))"
#: Over all pairs: the paths of least length through a vertex, over all of them.
_BETWEEN = _SIGMA + ", w as (select a.id, sum(a.s * c.s / z.s) as b from g a join g c on c.root = a.id join g z on z.root = a.root and z.id = c.id and z.dist = a.dist + c.dist where a.dist > 0 and c.dist > 0 group by a.id), n as (select count(*)::double as n from v), bt as (select v.id, coalesce(b, 0) / ((n - 1) * (n - 2)) as betweenness from v cross join n left join w using (id))"
_EDGES_BETWEEN = _SIGMA + ", w as (select y.src, y.dst, sum(a.s * c.s / z.s) as b from g a join m y on y.src = a.id join g h on h.root = a.root and h.id = y.dst and h.dist = a.dist + 1 join g c on c.root = y.dst join g z on z.root = a.root and z.id = c.id and z.dist = h.dist + c.dist group by 1, 2), n as (select count(*)::double as n from v)"


@query("with recursive " + _BETWEEN + " select id, round(betweenness, 6) as betweenness from bt")
def betweenness(s, d):
    return rounded(paths.betweenness(visits(s, d).as_undirected())[0], "betweenness")


@query("with recursive " + _EDGES_BETWEEN + " select t.eid, round((coalesce(x.b, 0) + coalesce(y.b, 0)) / (n * (n - 1)), 6) as betweenness from t cross join n left join w x on x.src = t.src and x.dst = t.dst left join w y on y.src = t.dst and y.dst = t.src")
def edge_betweenness(s, d):
    return rounded(paths.betweenness(visits(s, d).as_undirected())[1], "betweenness")


@query("with recursive " + _BETWEEN + " select round((max(betweenness) * count(*) - sum(betweenness)) / (count(*) - 1), 6) as dominance from bt")
def central_point_dominance(s, d):
    return rounded(centrality.central_point_dominance(paths.betweenness(visits(s, d).as_undirected())[0]), "dominance")


@query("with recursive " + _BFS + ", " + _REC.format(a="p", n=24) + ", f as (select id, min(dist)::double as dist from bfs group by id), q as (select f.id, f.dist, coalesce(min(h.id), f.id) as pred from f left join p on p.dst = f.id left join f h on h.id = p.src and h.dist + 1 = f.dist group by 1, 2) select id, dist, pred, row_number() over (order by dist, pred, id) - 1 as \"order\" from q")
def bfs_search(s, d):
    g = visits(s, d)
    return paths.bfs_order(g, _first(g))


# Components, cores, trees

_CC = VISITS + ", c(root, id) as (select id, id from v union select c.root, b.dst from c join b on b.src = c.id)"


@query("with recursive " + _CC + " select id, min(root) as label from c group by id")
def weak_components(s, d):
    return components.weak_components(visits(s, d))


_SCC = VISITS + ", c(root, id) as (select id, id from v union select c.root, p.dst from c join p on p.src = c.id)"


@query("with recursive " + _SCC + " select x.id, min(x.root) as label from c x join c y on y.root = x.id and y.id = x.root group by x.id")
def strong_components(s, d):
    return components.strong_components(visits(s, d))


@query("with recursive " + _SCC + " select x.id, min(x.root) as label from c x join c y on y.root = x.id and y.id = x.root group by x.id")
def strong_components_rounds(s, d):
    """As large graphs are labelled, in rounds over DataFrames."""
    return components.strong_components(visits(s, d), at_most=0)


@query("with recursive " + _SCC + ", l as (select x.id, min(x.root) as label from c x join c y on y.root = x.id and y.id = x.root group by x.id) select label, not exists (select 1 from p join l a on a.id = p.src join l b on b.id = p.dst where a.label = o.label and b.label <> o.label) as is_attractor from (select distinct label from l) o")
def attractors(s, d):
    g = visits(s, d)
    return components.attractors(g, components.strong_components(g))


@query("with recursive " + _CC + ", l as (select id, min(root) as label from c group by id), z as (select label, count(*) as n from l group by label order by n desc, label limit 1) select l.id, l.label = z.label as in_largest from l, z")
def largest_component(s, d):
    return components.largest_component(visits(s, d), False)


@query("with recursive " + _BFS + ", o(id) as (select id from m union select p.dst from o join p on p.src = o.id) select v.id, v.id in (select id from o) as reachable from v")
def out_component(s, d):
    g = visits(s, d)
    return components.out_component(g, _first(g))


#: Core numbers are what is left of the degrees when each becomes the H-index of its neighbours', again and again.
_CORE = SIMPLE + ", c0 as (select v.id, count(u.src) as h from v left join u on u.src = v.id group by v.id), " + ", ".join(
    f"c{n} as (select v.id, coalesce(max(least(r, h)), 0) as h from v left join (select u.src as id, c.h, row_number() over (partition by u.src order by c.h desc) as r from u join c{n - 1} c on c.id = u.dst) x using (id) group by v.id)" for n in range(1, 31)
)


@query(f"with {_CORE} select id, h::bigint as core from c30")
def kcore(s, d):
    return components.kcore(simple_users(s, d))


@query("with recursive " + _SCC.replace("select id, id from v union select c.root, p.dst", "select src, dst from p union select c.root, p.dst") + " select root as src, id as dst from c")
def transitive_closure(s, d):
    return components.transitive_closure(stats.remove_self_loops(visits(s, d)))


@query(f"with recursive {VISITS}, a as (select distinct least(src, dst) as src, greatest(src, dst) as dst from p), lv(id, level) as (select id, 0 from v where id not in (select dst from a) union select a.dst, level + 1 from lv join a on a.src = lv.id) select id, max(level) as level from lv group by id")
def topological_sort(s, d):
    """Levels once every edge leads to the larger number."""
    g = stats.remove_self_loops(visits(s, d))
    return components.topological_levels(g.with_edges(g.edges.select("eid", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))))


@query(f"with {USERS} select true as tree_is_dag, not exists (select 1 from e where src = dst) as users_is_dag")
def is_dag(s, d):
    return s.createDataFrame([(components.is_dag(tree(s, d)), components.is_dag(users(s, d)))], "tree_is_dag boolean, users_is_dag boolean")


@query(f"with {SUPPLY} select id, case when id < 1000000000 then 0 else 1 end as side from v")
def bipartite(s, d):
    g = supply(s, d)
    ok, sides = components.bipartite(g)
    low = sides.where("id < 1000000000").agg(F.min("side")).first()[0]
    return sides.select("id", F.abs(F.col("side") - low).cast("int").alias("side")) if ok else sides.limit(0)


@query(f"with {TREE} select count(*) as edges from e")
def spanning_forest_tree(s, d):
    return components.min_spanning_forest(tree(s, d)).agg(F.count(F.lit(1)).alias("edges"))


#: An edge is in the tree if no path joins its ends by lighter ones: paths by their heaviest edge, doubled in length.
_HEAVIEST = SIMPLE + ", z as (select *, row_number() over (order by w, eid) as r from s), h0 as (select src as i, dst as j, r from z union all select dst, src, r from z union all select id, id, 0 from v), " + ", ".join(
    f"h{n} as (select a.i, c.j, min(greatest(a.r, c.r)) as r from h{n - 1} a join h{n - 1} c on c.i = a.j group by 1, 2)" for n in range(1, 9)
)


@query(f"with {_HEAVIEST} select z.eid, z.src, z.dst, round(z.w, 6) as w from z join h8 on h8.i = z.src and h8.j = z.dst and h8.r = z.r")
def min_spanning_tree(s, d):
    g = simple_users(s, d)
    return rounded(components.min_spanning_forest(g, "w").join(g.edges, "eid").select("eid", "src", "dst", "w"), "w")


@query(f"with {USERS} select round(sum(case when exists (select 1 from e f where f.src = e.dst and f.dst = e.src) then 1 else 0 end) / count(*), 6) as reciprocity from e")
def reciprocity(s, d):
    return rounded(components.reciprocity(users(s, d)), "reciprocity")


@query(f"with {USERS}, a as (select src, dst, count(*) as n from e where label <> 'view' group by 1, 2), b as (select src, dst, count(*) as n from e where label <> 'click' group by 1, 2) select round((select sum(least(a.n, b.n)) from a join b using (src, dst)) / greatest((select sum(n) from a), (select sum(n) from b)), 6) as similarity")
def similarity(s, d):
    g = users(s, d)
    return rounded(components.similarity(g.view(edge=F.col("label") != "view"), g.view(edge=F.col("label") != "click")), "similarity")


@query(f"with {VISITS} select id, true as in_or_beside, false as both from v")
def max_independent_set(s, d):
    """Of each vertex whether it is in the set or beside one that is, and whether both."""
    g = visits(s, d).as_undirected().simple()
    chosen = components.cut(components.independent_set(g))
    beside = g.adjacency.join(chosen.toDF("src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct().withColumn("beside", F.lit(True))
    known = g.vertices.select("id").join(chosen.withColumn("inside", F.lit(True)), "id", "left").join(beside, "id", "left").na.fill(False)
    return known.select("id", (F.col("inside") | F.col("beside")).alias("in_or_beside"), (F.col("inside") & F.col("beside")).alias("both"))


@query(f"with {VISITS} select v.id, count(b.dst) as unlike, true as no_gap from v left join b on b.src = v.id group by v.id")
def vertex_coloring(s, d):
    """Of each vertex the number of neighbours in another colour, and whether every smaller colour is among theirs."""
    g = visits(s, d).as_undirected().simple()
    c = components.cut(components.colouring(g))
    near = g.adjacency.join(c.toDF("src", "own"), "src").join(c.toDF("dst", "other"), "dst")
    seen = near.groupBy(F.col("src").alias("id")).agg(F.count(F.when(F.col("own") != F.col("other"), 1)).alias("unlike"), F.count_distinct(F.when(F.col("other") < F.col("own"), F.col("other"))).alias("less"))
    return c.join(seen, "id", "left").na.fill(0).select("id", "unlike", (F.col("less") == F.col("color")).alias("no_gap"))


@query(f"with recursive {VISITS}, o as (select eid, src, dst, row_number() over (order by w - eid * 1e-7 desc) as r from t where src <> dst), n as (select max(r) as n from o), "
    "go(r, ends, eids) as (select 0::bigint, []::bigint[], []::bigint[] union all select o.r, case when list_contains(ends, src) or list_contains(ends, dst) then ends else list_concat(ends, [src, dst]) end, "
    "case when list_contains(ends, src) or list_contains(ends, dst) then eids else list_append(eids, eid) end from go join o on o.r = go.r + 1) select unnest(eids) as eid from go where r = (select n from n)")
def greedy_matching(s, d):
    """Edges by falling weight, each taken if its ends are free; rounds over DataFrames come to the same set."""
    g = visits(s, d)
    return components.greedy_matching(g.with_edges(g.edges.withColumn("u", F.col("w") - F.col("eid") * 1e-7)), "u")  # no ties


# Transforms and generators


@query(f"with {VISITS} select a.eid as src, b.eid as dst from t a join t b on b.src = a.dst")
def line_graph(s, d):
    return transform.line_graph(visits(s, d)).edges.select("src", "dst")


@query(f"with {USERS}, m as (select max(id) + 1 as o from v), x as (select max(eid) + 1 as o from e) select eid, src, dst from e union all select e.eid + x.o, e.src + m.o, e.dst + m.o from e, m, x")
def graph_union(s, d):
    g = users(s, d)
    return transform.union(g, g).edges.select("eid", "src", "dst")


@query(f"with {USERS} select a.block as src, b.block as dst, count(*)::double as count, round(avg(e.w), 6) as w from e join v a on a.id = e.src join v b on b.id = e.dst group by 1, 2")
def condensation_edges(s, d):
    return rounded(transform.condensation(users(s, d), "block", edge_averages=["w"]).edges.select("src", "dst", "count", "w"), "w")


@query(f"with {USERS} select block as id, count(*)::double as count, round(avg(score), 6) as score from v group by block")
def condensation_vertices(s, d):
    return rounded(transform.condensation(users(s, d), "block", averages=["score"]).vertices.select("id", "count", "score"), "score")


@query(f"with {TREE} select src, dst from e")
def predecessor_tree(s, d):
    pred = tree(s, d).edges.select(F.col("dst").alias("id"), F.col("src").alias("pred"))
    return transform.predecessor_tree(pred).edges.select("src", "dst")


@query(f"with {USERS}, n as (select id, row_number() over (order by id) - 1 as k from v) select e.eid, a.k as src, b.k as dst from e join n a on a.id = e.src join n b on b.id = e.dst")
def graph_copy_ordered(s, d):
    return transform.copy(users(s, d), order="id").edges.select("eid", "src", "dst")


@query(f"with {VISITS} select 2 * eid as id, src as node from t union all select 2 * eid + 1, dst from t")
def half_edge_graph(s, d):
    return transform.half_edges(visits(s, d)).vertices


@query("select i as src, i + 1 as dst from range(600) t(i) where i % 10 < 9 union all select i, i + 10 from range(600) t(i) where (i // 10) % 10 < 9 union all select i, i + 100 from range(600) t(i) where i < 500")
def lattice(s, d):
    return transform.lattice(s, [10, 10, 6]).edges.select("src", "dst")


@query("select i as src, case when i % 10 < 9 then i + 1 else i - 9 end as dst from range(200) t(i) union all select i, (i + 10) % 200 from range(200) t(i)")
def lattice_periodic(s, d):
    return transform.lattice(s, [10, 20], True).edges.select("src", "dst")


@query("select a as src, b as dst from range(30) x(a), range(30) y(b) where a < b")
def complete_graph(s, d):
    return transform.complete_graph(s, 30).edges.select("src", "dst")


@query("select a as src, (a + k) % 30 as dst from range(30) x(a), (values (1), (2), (3)) y(k)")
def circular_graph(s, d):
    return transform.circular_graph(s, 30, 3).edges.select("src", "dst")


@query(f"with {POINTS} select a.id as src, b.id as dst from pt a join pt b on a.id < b.id and sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.02")
def geometric_graph(s, d):
    return transform.geometric_graph(points(s, d), 0.02, ["x", "y"]).edges.select("src", "dst")


@query(f"with {_DEG} select id, ko.k as k_out, ki.k as k_in from ko join ki using (id)")
def random_graph_degrees(s, d):
    g = users(s, d)
    wanted = degree.degree(g, "out", name="k_out").join(degree.degree(g, "in", name="k_in"), "id")
    made = transform.random_graph(s, wanted, seed=3)
    return degree.degree(made, "out", name="k_out").join(degree.degree(made, "in", name="k_in"), "id")


def _rewired(g: Graph, made: Graph) -> DataFrame:
    """Degrees after rewiring, and whether most edges lead elsewhere."""
    pairs = made.edges.select("eid", "src", F.col("dst").alias("to")).join(g.edges.select("eid", F.col("src").alias("from"), "dst"), "eid")
    moved = pairs.agg((F.avg(((F.col("to") != F.col("dst")) | (F.col("src") != F.col("from"))).cast("double")) > 0.5).alias("moved"))
    return degree.degree(made, "out", name="k_out").join(degree.degree(made, "in", name="k_in"), "id").join(F.broadcast(moved))


@query(f"with {_DEG} select id, ko.k as k_out, ki.k as k_in, true as moved from ko join ki using (id)")
def random_rewire_degrees(s, d):
    g = users(s, d)
    return _rewired(g, transform.random_rewire(g, rounds=2, parallel_edges=True, self_loops=True, seed=3))


@query(f"with {VISITS}, o as (select src as id, count(*) as k from p group by 1), i as (select dst as id, count(*) as k from p group by 1) select v.id, coalesce(o.k, 0) as k_out, coalesce(i.k, 0) as k_in, true as moved, true as simple from v left join o using (id) left join i using (id)")
def rewire_simple(s, d):
    """No loop or parallel edge comes out of a graph that has none."""
    g = stats.remove_self_loops(visits(s, d))
    g = stats.remove_parallel_edges(g)
    g = g.with_edges(components.cut(g.edges))
    made = transform.random_rewire(g, rounds=2, seed=3)
    simple = made.edges.agg(((F.count_distinct("src", "dst") == F.count(F.lit(1))) & F.bool_and(F.col("src") != F.col("dst"))).alias("simple"))
    return _rewired(g, made).join(F.broadcast(simple))


# Communities


@query(f"with {USERS}, x as (select a.block as r, b.block as s, e.w from e join v a on a.id = e.src join v b on b.id = e.dst), er as (select r, sum(w) as er, sum(o) as err from (select r, w, case when r = s then w else 0 end as o from x union all select s, w, case when r = s then w else 0 end from x) group by r), t as (select sum(er) as t from er) select round(sum(err - er * er / t) / any_value(t), 6) as modularity from er, t")
def modularity(s, d):
    return rounded(community.modularity(users(s, d), "block", "w"), "modularity")


def _state(s, d) -> community.BlockState:
    g = users(s, d)
    return community.BlockState(g, g.vertices.select("id", "block"))


@query(f"with {USERS} select a.block as r, b.block as s, count(*) as e_rs from e join v a on a.id = e.src join v b on b.id = e.dst group by 1, 2")
def block_matrix(s, d):
    return _state(s, d).matrix


@query(f"with {USERS}, m as (select a.block as r, b.block as s, count(*)::double as x from e join v a on a.id = e.src join v b on b.id = e.dst group by 1, 2), o as (select r, sum(x) as x from m group by r), i as (select s, sum(x) as x from m group by s) select round((select -sum(x * ln(x)) from m) + (select sum(x * ln(x)) from o) + (select sum(x * ln(x)) from i) - (select sum(x) from m), 4) as entropy")
def block_entropy(s, d):
    return rounded(s.createDataFrame([(_state(s, d).entropy(),)], "entropy double"), "entropy", places=4)


@query(f"with {USERS}, m as (select src as id, dst % 3 as block, count(*)::double as n from e group by 1, 2), t as (select id, sum(n) as t from m group by id) select round(-sum(n / t * ln(n / t)), 6) as entropy from m join t using (id)")
def mf_entropy(s, d):
    m = users(s, d).edges.groupBy(F.col("src").alias("id"), (F.col("dst") % 3).alias("block")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(community.mf_entropy(m), "entropy")


@query(f"with {USERS}, n as (select src as node, dst % 3 as block, count(*) as n from e group by 1, 2) select node, block from (select *, row_number() over (partition by node order by n desc, block) as k from n) where k = 1")
def majority_blocks(s, d):
    return community.majority_blocks(users(s, d).edges.select(F.col("src").alias("node"), (F.col("dst") % 3).alias("block")))


@query()
def label_propagation(s, d):
    return community.label_propagation(visits(s, d), 6)


# Samples, coarse graphs, block rewiring and the local kernels


@query()
def motif_significance(s, d):
    return rounded(clustering.motif_significance(stats.remove_self_loops(visits(s, d)), 3, 2), "mean", "std_dev", "z")


def _block_weights(g: Graph) -> DataFrame:
    e = g.edges.join(g.vertices.select(F.col("id").alias("src"), F.col("block").alias("r")), "src").join(g.vertices.select(F.col("id").alias("dst"), F.col("block").alias("s")), "dst")
    return e.groupBy("r", "s").agg(F.count(F.lit(1)).cast("double").alias("p"))


@query(f"with {_DEG} select id, ko.k as k_out, ki.k as k_in, true as moved from ko join ki using (id)")
def rewire_probabilistic_degrees(s, d):
    g = users(s, d)
    return _rewired(g, transform.random_rewire(g, "probabilistic", 2, True, True, "block", 3, _block_weights(g)))


@query(f"with {USERS} select count(*) as edges, sum(eid)::bigint as eids from e")
def rewire_blocks(s, d):
    g = users(s, d)
    made = transform.random_rewire(g, "blockmodel-traditional", block="block", seed=3, probability=_block_weights(g))
    return made.edges.agg(F.count(F.lit(1)).alias("edges"), F.sum("eid").alias("eids"))


@query(f"with {VISITS} select count(*)::double as merged from v")
def coarse_graph(s, d):
    return transform.coarse(visits(s, d), "independent")[0].vertices.agg(F.sum("count").alias("merged"))


@query(f"with {VISITS} select count(*)::double as merged from v")
def coarse_stack(s, d):
    return transform.coarse_stack(visits(s, d))[-1][0].vertices.agg(F.sum("count").alias("merged"))


@query("select true as balanced")
def max_flow(s, d):
    """The flow's value is the capacity of the cut that it leaves."""
    g = stats.remove_self_loops(visits(s, d))
    source = _first(g)
    target = paths.shortest_distance(g, source).where("dist > 0").orderBy(F.desc("dist"), "id").first()["id"]
    value, residual = flow.max_flow(g, source, target, "w")
    side = flow.min_st_cut(g, source, "w", residual)
    out = g.edges.join(side.where("on_source_side").select(F.col("id").alias("src")), "src", "left_semi").join(side.where("not on_source_side").select(F.col("id").alias("dst")), "dst", "left_semi")
    return out.agg((F.abs(F.sum("w") - value) < 1e-6).alias("balanced"))


#: A vertex dominates what can't be reached without it; the nearest one has the most that dominate it.
_DOMINATE = _BFS + """, o(id) as (select id from m union select p.dst from o join p on p.src = o.id),
go(d, id) as (select o.id, m.id from o, m where o.id <> m.id union select go.d, p.dst from go join p on p.src = go.id where p.dst <> go.d),
dm as (select x.id as d, y.id as x from o x cross join o y where x.id <> y.id and not exists (select 1 from go where go.d = x.id and go.id = y.id)),
rank as (select o.id, count(dm.d) as n from o left join dm on dm.x = o.id group by o.id)"""


@query("with recursive " + _DOMINATE + " select o.id, coalesce(arg_max(dm.d, rank.n), o.id) as idom from o left join dm on dm.x = o.id left join rank on rank.id = dm.d group by o.id")
def dominator_tree(s, d):
    g = visits(s, d)
    return flow.dominator_tree(g, _first(g))


_WITHOUT = VISITS + """, go(v, id) as (select src, min(dst) from b group by src union select go.v, b.dst from go join b on b.src = go.id where b.dst <> go.v),
far as (select distinct b.src as id from b left join go on go.v = b.src and go.id = b.dst where go.id is null)"""


@query("with recursive " + _WITHOUT + " select id, id in (select id from far) as articulation from v")
def articulation_points(s, d):
    return flow.biconnected_components(visits(s, d))[1]


@query(f"with {SIMPLE}, k as (select src as id, sum(w) as w from u group by src) select round(min(w), 6) as value from k")
def min_cut(s, d):
    """On a graph so dense that the lightest cut takes off one vertex."""
    return rounded(s.createDataFrame([(flow.min_cut(simple_users(s, d), "w")[0],)], "value double"), "value")


@query(f"with {TREE} select eid, true as kept from e")
def isomorphism(s, d):
    """Of each edge of a tree whether the map found to a renumbered copy leads it to an edge there."""
    g = tree(s, d)
    other = Graph(g.vertices.select((-1 - F.col("id")).alias("id")), g.edges.select("eid", (-1 - F.col("src")).alias("src"), (-1 - F.col("dst")).alias("dst")), True)
    image = components.cut(flow.isomorphism(g, other))
    there = other.edges.select("src", "dst", F.lit(True).alias("there"))
    moved = g.edges.join(image.toDF("src", "a"), "src").join(image.toDF("dst", "b"), "dst").select("eid", F.col("a").alias("src"), F.col("b").alias("dst"))
    return moved.join(there, ["src", "dst"], "left").select("eid", F.coalesce("there", F.lit(False)).alias("kept"))


@query("select true as planar")
def planar_lattice(s, d):
    return s.createDataFrame([(flow.is_planar(transform.lattice(s, [12, 12])),)], "planar boolean")


@query("select 72::bigint as pairs")
def lattice_matching(s, d):
    return flow.max_cardinality_matching(transform.lattice(s, [12, 12])).agg(F.count(F.lit(1)).alias("pairs"))


@query()
def arf_layout(s, d):
    return rounded(layout.arf_layout(visits(s, d), 3), "x", "y", places=3)


@query()
def multilevel_layout(s, d):
    return rounded(layout.multilevel_layout(visits(s, d), 2), "x", "y", places=3)


@query(f"with {USERS} select id, block, count(*) as n from (select src as id, (2 * eid) % 3 as block from e union all select dst, (2 * eid + 1) % 3 from e) group by id, block")
def overlap_memberships(s, d):
    """Each vertex's half-edges over the blocks that they lie in."""
    g = users(s, d)
    h = transform.half_edges(g).vertices.select("node", (F.col("id") % 3).alias("block"))
    return community.overlap_sets(h).select(F.col("node").alias("id"), F.explode("blocks").alias("b")).select("id", "b.block", "b.n")


# Closed forms, against the values that are documented for them


@query("select 1572::bigint as most_blocks, round(2.414413, 5)::double as degree, 200.0::double as degree_of_many")
def closed_forms(s, d):
    return s.createDataFrame([(special.max_blocks(1e6, 5e6), round(special.average_degree_limit(10, math.log(10) / 100, 100), 5), special.average_degree_limit(10, math.log(10) / 100))], "most_blocks long, degree double, degree_of_many double")


# Files: what comes back from each format after all users' edges were written in it


def _back(s, d, kind: str) -> DataFrame:
    g = users(s, d)
    g = Graph(g.vertices.select("id", F.col("id").alias("name"), "score"), g.edges.select("eid", "src", "dst", "w"), True)
    path = f"{iterate.shared_dir(s).rstrip('/')}/graph-{uuid.uuid4().hex}.{kind}"
    formats.save_graph(g, path, kind)
    h = formats.load_graph(s, path)
    name = h.vertices.select("id", F.col("name").cast("double").cast("long").alias("name"))
    return rounded(h.edges.join(name.toDF("src", "a"), "src").join(name.toDF("dst", "b"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), "w"), "w")


for _kind in ("gt", "graphml", "gml", "dot"):
    query(f"with {USERS} select src, dst, round(w, 6) as w from e", f"file_{_kind}")(lambda s, d, k=_kind: _back(s, d, k))


# Look-ups, copies and marks


@query(f"with {USERS}, m as (select src, dst from e order by src, dst limit 1) select e.eid, e.label from e join m using (src, dst)")
def edges_between(s, d):
    g = users(s, d)
    first = g.edges.orderBy("src", "dst").select("src", "dst").first()
    return degree.edges_between(g, first["src"], first["dst"]).select("eid", "label")


@query(f"with {USERS} select id, events::double as copy from v")
def copy_property(s, d):
    return degree.copied(users(s, d).vertices, "events", "copy", "double").select("id", "copy")


@query(f"with {USERS} select eid, upper(label) as name from e")
def property_map(s, d):
    e = users(s, d).edges
    names = e.select(F.col("label").alias("key"), F.upper("label").alias("value")).distinct()
    return degree.mapped(e, "label", names, "name").select("eid", "name")


@query(f"with {USERS} select events as value, min(id) as id from v group by events")
def reverse_map(s, d):
    return degree.reversed_map(users(s, d).vertices, "events")


@query(f"with {VISITS}, f as (select src, dst from t where label = 'click'), i as (select src as id from f union select dst from f) select id, id in (select id from i) as marked from v")
def mark_subgraph(s, d):
    g = visits(s, d)
    part = g.edges.where("label = 'click'")
    return degree.marked(g, part.select(F.explode(F.array("src", "dst")).alias("id")), part)[0]


@query(f"with {VISITS} select a.src as v0, a.dst as v1, c.dst as v2 from (select distinct src, dst from t where label = 'click') a join p c on c.src = a.dst where a.src <> a.dst and a.src <> c.dst")
def subgraph_edge_label(s, d):
    return clustering.pattern_matches(stats.remove_self_loops(visits(s, d)), [(0, 1), (1, 2)], edge_labels={(0, 1): "click"}, edge_label="label")


@query(f"with {_MOTIFS4} select case when e = 4 then 30 else 63 end::bigint as motif, count(*) as count from f4 where (e = 4 and k = 2) or e = 6 group by 1")
def motif_list(s, d):
    """Cycles and complete graphs of four."""
    wanted = [[(0, 1), (1, 2), (2, 3), (3, 0)], [(i, j) for i in range(4) for j in range(i)]]
    return clustering.motifs(visits(s, d).as_undirected(), 4, motif_list=wanted)


@query(f"with {VISITS} select count(*) as edges, true as simple, true as kept from t")
def random_simple_graph(s, d):
    """A graph without loops and parallel edges that has the degrees of the visits."""
    g = visits(s, d)
    wanted = components.cut(degree.degree(g, "total", name="k_out").where("k_out > 0"))
    made = transform.random_graph(s, wanted, False, 3, False, False)
    got = degree.degree(made, "total", name="k").join(wanted, "id").agg(F.bool_and(F.col("k") == F.col("k_out")).alias("kept"))
    pairs = made.edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return pairs.agg(F.count(F.lit(1)).alias("edges"), ((F.count_distinct("a", "b") == F.count(F.lit(1))) & F.bool_and(F.col("a") < F.col("b"))).alias("simple")).join(F.broadcast(got))


# Marginals of sampled partitions

_SAMPLES = USERS + ", sm as (select k as sample, id, (id * (k + 1) + k * k) % 3 as block from v, range(6) r(k)), vm as (select id, block, count(*) as n from sm group by 1, 2), em as (select e.eid, a.block as r, b.block as s, count(*) as n from e join sm a on a.id = e.src join sm b on b.sample = a.sample and b.id = e.dst group by 1, 2, 3)"


def _samples(s, d) -> tuple[Graph, DataFrame]:
    g = users(s, d)
    k = F.col("sample")
    return g, g.vertices.select("id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("sample")).select("sample", "id", ((F.col("id") * (k + 1) + k * k) % 3).alias("block"))


@query(f"with {_SAMPLES} select * from vm")
def vertex_marginals(s, d):
    return community.vertex_marginals(_samples(s, d)[1])


@query(f"with {_SAMPLES} select * from em")
def edge_marginals(s, d):
    return community.edge_marginals(*_samples(s, d))


@query(f"with {_SAMPLES}, k as (select id, count(*) as k from (select src as id from e union all select dst from e) group by id), ve as (select sum(-(k - 1) * n / 6.0::double * ln(n / 6.0::double)) as h from vm join k using (id)), ee as (select sum(-n / 6.0::double * ln(n / 6.0::double)) as h from em) select round(ee.h - ve.h, 4) as entropy from ee, ve")
def bethe_entropy(s, d):
    return rounded(community.bethe_entropy(*_samples(s, d)), "entropy", places=4)


@query(f"with {USERS}, h as (select distinct src as node, dst % 3 as block from e), k as (select node, list_sort(list(block)) as k from h group by node) select node, dense_rank() over (order by k) - 1 as block from k")
def nonoverlap_blocks(s, d):
    return community.nonoverlap_blocks(users(s, d).edges.select(F.col("src").alias("node"), (F.col("dst") % 3).alias("block")))
