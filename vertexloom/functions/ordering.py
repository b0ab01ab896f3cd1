"""Order over a whole table without one task for all of it.

Range partitions come from a sample and may differ when planned or run again, so they are written once and read twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.plans.iterate import cut


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` in range partitions, with the number of each as _part."""
    return cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def following(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the next row's ``value`` in the total order; rows are range-partitioned and only each part's first row travels."""
    parts = _ranged(df, order)
    inner = Window.partitionBy("_part").orderBy(*order)
    led = parts.withColumn(name, F.lead(value).over(inner)).withColumn("_last", F.lead(F.lit(True)).over(inner).isNull())
    heads = parts.groupBy("_part").agg(F.min_by(F.col(value), F.struct(*order)).alias("_head"))
    tops = heads.select((F.col("_part")).alias("_p"), "_head").withColumn("_prev", F.lag("_p").over(Window.orderBy("_p")))
    out = led.join(F.broadcast(tops.select(F.col("_prev").alias("_part"), "_head")), "_part", "left")
    return out.withColumn(name, F.when(F.col("_last"), F.col("_head")).otherwise(F.col(name))).drop("_part", "_last", "_head")


def numbered(df: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """Dense numbers from 0 in a total order, by range partitions and the sizes of those before."""
    parts = _ranged(df, order)
    sizes = parts.groupBy("_part").count()
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")).alias("_before"))
    row = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn(name, row).join(F.broadcast(before), "_part").withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_part", "_before")


def numbered_within(df: DataFrame, keys: list[str], order: list[str], name: str = "n") -> DataFrame:
    """Dense numbers from 0 within each group of ``keys``. A group that many rows share lies in several range partitions; of
    each partition only the groups that it shares with others, two at most, take part in the second sum."""
    parts = _ranged(df, [*keys, *order])
    sizes = parts.groupBy("_part", *keys).count()
    group = Window.partitionBy(*keys)
    shared = sizes.withColumn("_spans", F.count(F.lit(1)).over(group)).where("_spans > 1")
    before = shared.withColumn("_before", F.sum("count").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count"))
    heads = before.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], "_before")
    on = F.col("_part") == F.col("_p")
    for n, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{n}"))
    row = F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order)) - 1
    out = parts.withColumn(name, row).join(F.broadcast(heads), on, "left")
    return out.withColumn(name, (F.col(name) + F.coalesce("_before", F.lit(0))).cast("long")).select(*df.columns, name)


def ranks(df: DataFrame, key: Column, name: str) -> DataFrame:
    """(key, name): the distinct keys with dense numbers from 0 in their order."""
    return numbered(df.select(key.alias("key")).distinct(), ["key"], name)
