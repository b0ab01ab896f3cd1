"""Mixing sources to target weights, in DataFrame operations only.

Each row gets a hash-random key from its id. Keys are range-sorted within each source: the leading bits deal a source
over ranges of about ``RANGE`` rows (so a hot source takes many tasks), a window sums sizes within a range, a second
one sums the ranges, and their total is the row's prefix sum. The source is cut at its exact budget; whole epochs come
before the cut. Everything but the sums by source and range is computed where the rows lie.

Targets fill like water: the share of every source is proportional to its weight until it meets its limit, and one level
holds for all sources below theirs, which is what repeated resharing of the excess ends in.

Rows: one for each document. Null texts have size 0; a null source is a source, the last one. Sources of size 0 get 0.
Rows with equal ids and sizes are interchangeable, so that reruns agree. Rows that share a key (those of one id, or
without any) fall into one range however many they are; ranges that they fill are dealt again by order, ties included.
Other columns pass through ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.llm._shared import WORD, cut, fresh, quoted

RANGE, KEY_BITS = 2048, 60
#: Between words and the white space after them.
_AFTER_WORD = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, limit: float) -> DataFrame:
    """source, source_size and target from (source, source_size): a row for each source, however many documents."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    own = sizes.withColumn("weight", weight).withColumn("cap", F.lit(float(limit)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_ = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.lit(float(share)) * F.sum("source_size").over(every) - full) / open_
    best = own.withColumn("level", level).withColumn("level", F.max("level").over(every))
    return best.select("source", "source_size", F.least("cap", F.col("weight") * F.col("level")).alias("target"))


def random_key(doc_id: Column, seed: int) -> Column:
    """The first ``KEY_BITS`` bits of an MD5 of the id; null ids share one."""
    text = F.concat_ws(":", doc_id.cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def taken(rows: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2, seed: int = 17, crowd: int = 16 * RANGE) -> DataFrame:
    """doc_id, source, size, digest, source_size, target and taken from (doc_id, source, size, digest)."""
    rows = cut(rows.withColumn("key", random_key(F.col("doc_id"), seed)).withColumn("tie", F.monotonically_increasing_id()))
    bits = max(0, (rows.count() // RANGE).bit_length())
    rows = rows.withColumn("range", F.shiftrightunsigned("key", KEY_BITS - bits) if bits else F.lit(0).cast("long"))
    rows = _dealt(rows.withColumn("part", F.lit(0)), crowd)
    ranges = cut(rows.groupBy("source", "range", "part").agg(F.sum("size").alias("size")))
    before = F.sum("size").over(Window.partitionBy("source").orderBy("range", "part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    whole = targets(ranges.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, limit)
    heads = ranges.select(F.col("source").alias("s"), F.col("range").alias("r"), F.col("part").alias("p"), before.alias("before"))
    plan = cut(heads.join(whole, heads.s.eqNullSafe(whole.source)).drop("source"))
    inner = Window.partitionBy("source", "range", "part").orderBy("key", "doc_id", "size", "digest", "tie").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("prior", F.sum("size").over(inner) - F.col("size"))
    placed = placed.join(plan, placed.source.eqNullSafe(plan.s) & (placed.range == plan.r) & (placed.part == plan.p))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    part = F.greatest(F.lit(0), F.least(F.col("size"), budget - epochs * F.col("source_size") - F.col("before") - F.col("prior")))
    return placed.select("doc_id", placed.source, "digest", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"))


def _dealt(rows: DataFrame, crowd: int) -> DataFrame:
    """Ranges of more than ``crowd`` rows in parts, by the order within them."""
    full = cut(rows.groupBy(F.col("source").alias("s"), F.col("range").alias("r")).count().where(F.col("count") > crowd).select("s", "r"))
    if not full.take(1):
        return rows
    there = rows.source.eqNullSafe(full.s) & (rows.range == full.r)
    order = ["source", "range", "key", "doc_id", "size", "digest", "tie"]
    return rows.join(full, there, "left_anti").unionByName(cut(rows.join(full, there, "left_semi").repartitionByRange(*order).withColumn("part", F.spark_partition_id() + 1)))


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row."""
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.lit(0).cast("long").alias("digest"))
    return taken(rows, **options).drop("digest", "source")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row as often as it is taken whole, and once more with its first words where the cut falls in
    it (``text`` up to the cut, ``n_chars`` its length). Columns are those of ``docs``; no row of no words is given."""
    own = docs.columns
    key, nth, size, copy, got, take = fresh(own, "digest", "nth", "size", "copy", "got", "take")
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("digest"))
    plan = taken(rows, **options).where("taken > 0")
    plan = plan.withColumn(nth, F.row_number().over(Window.partitionBy("doc_id", "source", "digest").orderBy(F.desc("taken"))))
    plan = plan.select(F.col("doc_id").alias("_p_id"), F.col("source").alias("_p_source"), F.col("digest").alias(key), F.col(nth), F.col("size").alias(size), F.col("taken").alias(take))
    named = docs.withColumn(key, F.xxhash64("text"))
    named = named.withColumn(nth, F.row_number().over(Window.partitionBy("doc_id", "source", key).orderBy("source")))
    joined = named.join(plan, named.doc_id.eqNullSafe(plan["_p_id"]) & named.source.eqNullSafe(plan["_p_source"]) & (named[key] == plan[key]) & (named[nth] == plan[nth])).select(*[named[q] for q in quoted(own)], plan[size], plan[take])
    copies = joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.ceil(F.col(take) / F.col(size)).cast("int"))))
    copies = copies.withColumn(got, F.least(F.col(size), F.col(take) - (F.col(copy) - 1) * F.col(size)))
    text = F.when(F.col(got) < F.col(size), F.array_join(F.slice(F.split("text", _AFTER_WORD), F.lit(1), F.col(got).cast("int")), "")).otherwise(F.col("text"))
    out = copies.withColumn("text", text)
    if "n_chars" in own:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*quoted(own))
