"""Graphs over the supplied tables, and the same as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.functions.ordering import following
from vertexloom.graph import Graph


#: Vertex numbers of a day lie above those of the days before it.
DAY = 1_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def users(spark: SparkSession, sf_dir: str) -> Graph:
    """Directed multigraph with loops: an edge from each event's user to that of the next event."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", "event_type")
    led = following(ev, ["ts", "event_id"], "user_id", "dst").where("dst is not null")
    edges = led.select(F.col("event_id").alias("eid"), F.col("user_id").alias("src"), "dst", F.col("value").alias("w"), F.col("event_type").alias("label"))
    n = F.count(F.lit(1))
    vertices = ev.groupBy(F.col("user_id").alias("id")).agg(F.sum("value").alias("score"), n.alias("events"), (F.col("user_id") % 5).alias("block"))
    return Graph(vertices.select("id", "score", "events", "block"), edges, True)


USERS = """ev as (select event_id as eid, user_id as src, lead(user_id) over (order by ts, event_id) as dst, value as w, event_type as label from events),
e as (select * from ev where dst is not null),
v as (select user_id as id, sum(value) as score, count(*) as events, user_id % 5 as block from events group by user_id)"""


def simple_users(spark: SparkSession, sf_dir: str) -> Graph:
    """Undirected, without loops and parallel edges."""
    return users(spark, sf_dir).simple("w")


SIMPLE = USERS + """,
s as (select least(src, dst) as src, greatest(src, dst) as dst, min(eid) as eid, sum(w) as w from e where src <> dst group by 1, 2),
u as (select src, dst, eid, w from s union all select dst, src, eid, w from s)"""


def visits(spark: SparkSession, sf_dir: str) -> Graph:
    """Directed, sparse, a component for each day or more: a user's visits of a day are one vertex, and each event's visit
    leads to that of the day's next event."""
    ev = table(spark, sf_dir, "events").withColumn("visit", F.datediff(F.to_date("ts"), F.lit("2024-01-01")).cast("long") * DAY + F.col("user_id"))
    led = following(ev.select("event_id", "visit", "ts", "value", "event_type"), ["ts", "event_id"], "visit", "dst")
    same_day = F.floor(F.col("visit") / DAY) == F.floor(F.col("dst") / DAY)
    edges = led.where(same_day).select(F.col("event_id").alias("eid"), F.col("visit").alias("src"), "dst", F.col("value").alias("w"), F.col("event_type").alias("label"))
    vertices = ev.groupBy(F.col("visit").alias("id"), (F.col("user_id") % 5).alias("block")).agg(F.sum("value").alias("score"), F.count(F.lit(1)).alias("events"))
    return Graph(vertices.select("id", "score", "events", "block"), edges, True)


VISITS = f"""seen as (select *, datediff('day', date '2024-01-01', ts::date) * {DAY} + user_id as visit from events),
ev as (select event_id as eid, visit as src, lead(visit) over (partition by ts::date order by ts, event_id) as dst, value as w, event_type as label from seen),
t as (select * from ev where dst is not null),
v as (select visit as id, sum(value) as score, count(*) as events, user_id % 5 as block from seen group by visit, user_id),
p as (select distinct src, dst from t where src <> dst),
b as (select src, dst from p union select dst, src from p)"""


def supply(spark: SparkSession, sf_dir: str) -> Graph:
    """Directed bipartite, weighted: suppliers to the parts they sold."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("w"))
    edges = li.select((F.col("l_suppkey") * 10_000_000 + F.col("l_partkey")).alias("eid"), F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1_000_000_000).alias("dst"), "w")
    return Graph.from_edges(edges)


SUPPLY = """e as (select l_suppkey * 10000000 + l_partkey as eid, l_suppkey as src, l_partkey + 1000000000 as dst, sum(l_quantity) as w from lineitem group by l_suppkey, l_partkey),
v as (select src as id from e union select dst from e)"""


def tree(spark: SparkSession, sf_dir: str) -> Graph:
    """Directed tree: region, nation, customer."""
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("src"), (F.col("n_nationkey") + 1000).cast("long").alias("dst"))
    c = table(spark, sf_dir, "customer").select((F.col("c_nationkey") + 1000).cast("long").alias("src"), (F.col("c_custkey") + 1_000_000).alias("dst"))
    edges = n.union(c).withColumn("eid", F.col("dst"))
    v = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id")).union(edges.select("dst"))
    return Graph(v, edges, True)


TREE = """e as (select n_nationkey::bigint + 1000 as eid, n_regionkey::bigint as src, n_nationkey::bigint + 1000 as dst from nation
union all select c_custkey + 1000000, c_nationkey::bigint + 1000, c_custkey + 1000000 from customer),
v as (select r_regionkey::bigint as id from region union all select dst from e)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


POINTS = "pt as (select vec_id as id, embedding[1]::double as x, embedding[2]::double as y from embeddings)"
