"""Nearest neighbours by cross-polytope hashing.

A hash is the nearest signed axis of a pseudo-rotated unit vector: three rounds of random signs and a fast Hadamard
transform (padded to a power of two). Some hashes together make a table's bucket. Their number and that of the tables
grow with the vectors, so that buckets stay small. A query looks into those buckets of each table that lose least, by
how far other axes fall behind. How many is measured: at most ``JUDGES`` queries (those of smallest id hash) are compared
with all vectors, and the least number of probes that finds ``TARGET`` of their neighbours serves every query.

Vectors are dealt by their own hash over shards of about ``SHARD``, once, and each shard indexes what it holds; a query
goes to every shard with its vector, scores the vectors in its buckets there (those near its best again, in double
precision), and sends on its ``k`` best only. So no bucket, group of near copies or query fills a task, no candidate pair is shuffled and none is capped.
Equal vectors meet in one shard, where they are one entry with its k + 1 smallest ids, all that a result can hold; tasks
drop the others of frequent ones before the shuffle. A query that finds fewer than k candidates while there are more is
searched against all, in blocks.

Where norms differ, the largest inner product is the least angle once vectors are shrunk by the largest norm and filled
up to length one by a coordinate that queries don't have.

Rows: for each query its k nearest, by score and then smaller id. Vectors that are null, zero, of another length than
most of the table (its mode, the larger of equals), or hold null or non-finite components take no part, and neither
do null ids. Of several vectors under one id each takes part; a query is never answered by its own id.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from vertexloom.llm._shared import Lookup, arrow_map, cut, shared_dir, ship

SHARD, FEWEST, CHUNK = 1 << 18, 4096, 64
TARGET, JUDGES, BUCKET = 0.95, 128, 64
FOUND = "query_id long, vec_id long, score double"


@cache
def _pairs(many: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The places in two sorted lists whose sums can be among the ``many`` least: before (i, j) come (i + 1) (j + 1) - 1."""
    i = np.concatenate([np.full(min(m, many // (a + 1)), a) for a in range(many)])
    j = np.concatenate([np.arange(min(m, many // (a + 1))) for a in range(many)])
    return i, j


@dataclass(frozen=True)
class Hash:
    """``tables`` x ``hashes`` pseudo-rotations of vectors of ``width``, from a seed.

    ``longest`` is the largest norm if norms differ, else None.
    """

    width: int
    tables: int
    hashes: int
    longest: float | None = None
    seed: int = 5

    @staticmethod
    def fitting(width: int, rows: int, longest: float | None = None, seed: int = 5) -> Hash:
        """With about ``BUCKET`` or fewer vectors in a bucket, and more tables for more vectors."""
        axes = 2 * Hash(width, 1, 1, longest).padded
        return Hash(width, 8 if rows < 1 << 15 else 16, max(1, math.ceil(math.log(max(1, rows) / BUCKET, axes))), longest, seed)

    @property
    def padded(self) -> int:
        return 1 << max(1, (self.width + (self.longest is not None) - 1).bit_length())

    @property
    def axes(self) -> int:
        return 2 * self.padded

    @property
    def buckets(self) -> int:
        return self.axes**self.hashes

    def _units(self, x: np.ndarray, queries: bool) -> np.ndarray:
        out = np.zeros((len(x), self.padded), np.float32)
        big = np.abs(x).max(axis=1, keepdims=True)
        unit = x / big
        norm = np.linalg.norm(unit, axis=1, keepdims=True)
        unit = unit / norm
        if self.longest is not None and not queries:
            part = np.minimum(big * norm / self.longest, 1.0)
            out[:, self.width] = np.sqrt(1 - part * part)[:, 0]
            unit = unit * part
        out[:, : self.width] = unit
        return out

    def rotated(self, x: np.ndarray, queries: bool = False) -> np.ndarray:
        """Of each row all rotations: (rows, tables, hashes, padded)."""
        many = self.tables * self.hashes
        signs = np.random.default_rng(self.seed).choice(np.array([-1, 1], np.float32), (3, many, self.padded))
        y = np.repeat(self._units(x.astype(np.float64), queries)[:, None, :], many, axis=1)
        for round_ in range(3):
            y = y * signs[round_]
            step = 1
            while step < self.padded:
                z = y.reshape(-1, 2, step)
                y = np.stack([z[:, 0] + z[:, 1], z[:, 0] - z[:, 1]], 1)
                step *= 2
            y = y.reshape(len(x), many, self.padded) / np.float32(math.sqrt(self.padded))
        return y.reshape(len(x), self.tables, self.hashes, self.padded)

    def own(self, x: np.ndarray) -> np.ndarray:
        """The bucket of each row in each table; tables have buckets of their own."""
        out = np.zeros((len(x), self.tables), np.int64)
        for a in range(0, len(x), CHUNK):
            y = self.rotated(x[a : a + CHUNK])
            best = np.abs(y).argmax(-1)
            signed = best + self.padded * (np.take_along_axis(y, best[..., None], -1)[..., 0] < 0)
            for nth in range(self.hashes):
                out[a : a + CHUNK] = out[a : a + CHUNK] * self.axes + signed[:, :, nth]
        return out + np.arange(self.tables) * self.buckets

    def probes(self, x: np.ndarray, many: int) -> np.ndarray:
        """The best ``many`` buckets of each query in each table, best first: (rows, tables, many or fewer)."""
        y = self.rotated(x, True)
        both = np.concatenate([y, -y], -1)
        m = min(many, self.axes)
        order = np.argsort(-both, axis=-1, kind="stable")[..., :m]
        fall = np.take_along_axis(both, order, -1)
        fall = fall[..., :1] - fall
        keys, lost = order[:, :, 0].astype(np.int64), fall[:, :, 0]
        for nth in range(1, self.hashes):
            i, j = _pairs(many, m)
            ok = i < keys.shape[-1]
            i, j = i[ok], j[ok]
            sums = lost[..., i] + fall[:, :, nth][..., j]
            pick = np.argpartition(sums, min(many, len(i)) - 1, axis=-1)[..., :many]
            pick = np.take_along_axis(pick, np.argsort(np.take_along_axis(sums, pick, -1), axis=-1, kind="stable"), -1)
            lost = np.take_along_axis(sums, pick, -1)
            keys = np.take_along_axis(keys[..., i] * self.axes + order[:, :, nth][..., j], pick, -1)
        return keys + (np.arange(self.tables) * self.buckets)[None, :, None]


def usable(rows: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int, int, float | None]:
    """(vec_id, v) of the vectors that take part; their length, number and, if norms differ, the largest norm."""
    v = F.col(vector) if isinstance(rows.schema[vector].dataType.elementType, FloatType) else F.col(vector).cast("array<double>")
    sound = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    )
    norm = F.sqrt(F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x))
    sizes = sound.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("count"), F.max(norm).alias("most"), F.min(norm).alias("least")).orderBy(F.desc("count"), F.desc("n")).take(1)
    if not sizes:
        return sound, 1, 0, None
    n, count, most, least = sizes[0]
    return sound.where(F.size("v") == n), n, count, most if least < 0.999 * most < float("inf") else None


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _exact(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in double precision whose value does not depend on what else is in the block."""
    return np.cumsum(vectors.astype(np.float64) * query.astype(np.float64), axis=1)[:, -1] if len(vectors) else np.zeros(0)


class Held:
    """Distinct vectors with their k + 1 smallest ids, from rows that come sorted by the vectors' hashes and then ids."""

    def __init__(self, k: int):
        self.k, self.count, self.open, self.last = k, 0, 0, None
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, hashes: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        now = hashes, ids, vectors
        last_hashes, last_ids, last_vectors = (np.concatenate([x[:1] if self.last is None else self.last[c], x[:-1]]) for c, x in enumerate(now))
        new = (hashes != last_hashes).any(1) | (vectors != last_vectors).any(1)
        if self.last is None:
            new[0] = True
        again = ~new & (ids == last_ids)
        number = np.cumsum(~again) + self.open  # the vector that the last rows left open counts on
        place = number - np.maximum(np.maximum.accumulate(np.where(new, number, 0)), 1)
        keep = ~again & (place <= self.k)
        self.parts.append((ids[keep], (np.cumsum(new) - 1 + self.count)[keep], vectors[new]))
        self.count += int(new.sum())
        self.open, self.last = int(place[-1]) + 1, tuple(x[-1:].copy() for x in now)

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate(x) for x in zip(*self.parts, strict=True))


class Shard:
    """An index over ``vectors``; the ids of the k-th are ``ids[first[k] : first[k + 1]]``. Without a hash, a plain list."""

    def __init__(self, ids: np.ndarray, owner: np.ndarray, vectors: np.ndarray, shape: Hash | None = None):
        self.ids, self.vectors, self.shape = ids, vectors, shape
        self.first = np.searchsorted(owner, np.arange(len(vectors) + 1))
        self.sorted_ids = np.sort(ids)
        self.reach = float(np.linalg.norm(vectors.astype(np.float64), axis=1).max())
        if shape is not None:
            keys = shape.own(vectors).ravel()
            order = np.argsort(keys, kind="stable")
            self.entry = (order // shape.tables).astype(np.int32)
            keys, starts = np.unique(keys[order], return_index=True)
            self.starts, self.place = np.append(starts, len(order)), Lookup(keys)

    def candidates(self, queries: np.ndarray, many: int):
        """Of each query the places of the vectors in its buckets."""
        at = self.place.find(self.shape.probes(queries, many).astype(np.uint64).ravel()).reshape(len(queries), -1)
        met = np.zeros(len(self.vectors), bool)
        for row in at:
            row = row[row >= 0]
            begin, sizes = self.starts[row], self.starts[row + 1] - self.starts[row]
            places = np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            met[:] = False
            met[self.entry[places]] = True
            yield np.flatnonzero(met)

    def best(self, query_id: int, query: np.ndarray, near: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, scores and places of the k best other ids among ``near``, whose rough scores are given."""
        own = int(np.searchsorted(self.sorted_ids, query_id, "right") - np.searchsorted(self.sorted_ids, query_id))
        if len(near) > k + own:  # so many entries hold k other ids; near ties stay in
            edge = np.partition(scores, len(near) - k - own)[len(near) - k - own]
            off = np.finfo(self.vectors.dtype).eps * len(query) * self.reach * float(np.linalg.norm(query.astype(np.float64)))
            near = near[~(scores < edge - off)]
        sizes = self.first[near + 1] - self.first[near]
        ids = self.ids[np.repeat(self.first[near] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
        places = np.repeat(near, sizes)
        places, ids = places[ids != query_id], ids[ids != query_id]
        exact = _exact(query, self.vectors[places])
        order = np.lexsort((ids, -exact))[:k]
        return ids[order], exact[order], places[order]


def _given(query_ids, results) -> pa.RecordBatch:
    ids, scores, _ = (np.concatenate(x) for x in zip(*results, strict=True))
    return pa.record_batch([pa.array(np.repeat(query_ids, [len(r[0]) for r in results])), pa.array(ids), pa.array(scores)], ["query_id", "vec_id", "score"])


def _thinned(k: int):
    """Drops rows of a vector of which the task gave out k + 1 smaller ids. Only vectors that are frequent in some batch
    are remembered."""

    def thin(batches):
        full: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            h, more, ids = (batch.column(c).to_numpy() for c in range(3))
            order = np.lexsort((ids, more, h))
            new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (more[order][1:] != more[order][:-1])])[: len(order)]
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(order)))
            keep = np.ones(len(order), bool)
            known = {(int(h[order[s]]), int(more[order[s]])): (s, n) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True) if n > k + 1 or (full and (int(h[order[s]]), int(more[order[s]])) in full)}
            for key, (s, n) in known.items():
                own = ids[order[s : s + n]]
                least = np.unique(np.concatenate([own, full.get(key, own[:0])]))[: k + 1]
                keep[s : s + n] = own <= least[-1]
                first = np.concatenate([[True], own[1:] != own[:-1]])
                keep[s : s + n] &= first
                if len(least) == k + 1:
                    full[key] = least
            yield batch.take(pa.array(order[keep]))

    return thin


def nearest(rows: DataFrame, is_query: Column, k: int = 20, seed: int = 5, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id and score; ``is_query`` is a condition on ``vec_id``."""
    spark = rows.sparkSession
    kind = "float" if isinstance(rows.schema["embedding"].dataType.elementType, FloatType) else "double"
    rows, width, total, longest = usable(rows)
    shape = Hash.fitting(width, total, longest, seed)
    queries = rows.where(is_query)
    many = probes_for(rows, queries, shape, k, kind) if total > 8 * k else shape.buckets  # so few are all candidates
    shards = max(1, -(-total // shard), min(spark.sparkContext.defaultParallelism, total // FEWEST))
    named = rows.select(F.xxhash64("v").alias("h"), F.xxhash64("v", F.lit(1)).alias("more"), "vec_id", "v")
    columns = f"h long, more long, vec_id long, v array<{kind}>"
    held = arrow_map(named, _thinned(k), columns).select(F.pmod("h", F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), "h", "more", "vec_id", "v")
    none = F.lit(0).cast("long")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), none.alias("h"), none.alias("more"), "vec_id", "v")
    both = held.union(asked).repartitionById(shards, "shard").sortWithinPartitions("shard", "asks", "h", "more", "vec_id")

    def met(batches):
        """Rows come sorted by shard, its entries before queries; entries are held, queries stream."""
        at, held, index = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, own, h = _matrix(batch.column(5), width), batch.column(4).to_numpy(), np.stack([batch.column(c).to_numpy() for c in (2, 3)], 1)
            state = batch.column(0).to_numpy().astype(np.int64) * 2 + batch.column(1).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate([[True], state[1:] != state[:-1]]))
            for a, b in zip(starts, np.append(starts[1:], len(own)), strict=True):
                if state[a] // 2 != at:
                    at, held, index = state[a] // 2, Held(k), None
                if state[a] % 2 == 0:
                    held.add(h[a:b], own[a:b], x[a:b])
                elif held.count:
                    if index is None:
                        index = Shard(*held.arrays(), shape)
                    for c in range(a, b, 64):
                        part = slice(c, min(b, c + 64))
                        yield _given(own[part], [index.best(i, q, near, index.vectors[near] @ q, k) for i, q, near in zip(own[part], x[part], index.candidates(x[part], many), strict=True)])

    found = arrow_map(both, met, FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = cut(found.repartition("query_id").distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
    whole = rows.select("vec_id").distinct().count() - 1
    full = found.groupBy("query_id").count().where(F.col("count") >= min(k, whole)).select(F.col("query_id").alias("vec_id"))
    short = cut(queries.join(full, "vec_id", "left_anti"))
    if short.take(1):
        found = found.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").select(found.columns).union(_searched(short, rows, k, width))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _against(rows: DataFrame, asked: list, k: int, width: int, vectors: str = "") -> DataFrame:
    """Each task's k best rows for each of ``asked`` (vec_id, v), which is broadcast; with the vectors if their type is named."""
    sc = rows.sparkSession.sparkContext
    shared_dir(rows.sparkSession)
    ship(rows.sparkSession)
    given = sc.broadcast((np.array([r["vec_id"] for r in asked], np.int64), np.array([r["v"] for r in asked])))

    def met(batches):
        query_ids, queries = given.value
        held = [(np.zeros(0, np.int64), np.zeros((0, width)))] * len(queries)
        for batch in batches:
            for a in range(0, batch.num_rows, 1 << 12):
                part = batch.slice(a, 1 << 12)
                v, n = _matrix(part.column(1), width), part.num_rows
                index = Shard(part.column(0).to_numpy(), np.arange(n), v)
                scores = queries.astype(v.dtype) @ v.T
                for q, (ids, own) in enumerate(held):
                    new, _, places = index.best(query_ids[q], queries[q], np.arange(n), scores[q], k)
                    ids, own = np.concatenate([ids, new]), np.concatenate([own, v[places]])
                    order = np.lexsort((ids, -_exact(queries[q], own)))[:k]
                    held[q] = ids[order], own[order]
        if len(held) and any(len(ids) for ids, _ in held):
            results = [(ids, _exact(q, own), None) for q, (ids, own) in zip(queries, held, strict=True)]
            out = pa.record_batch([pa.array(np.repeat(query_ids, [len(r[0]) for r in results])), *(pa.array(np.concatenate([r[c] for r in results])) for c in (0, 1))], ["query_id", "vec_id", "score"])
            if vectors:
                flat = np.concatenate([own for _, own in held]).astype(np.float32 if vectors == "float" else np.float64)
                out = out.append_column("v", pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, width), pa.int32()), pa.array(flat.ravel())))
            yield out

    return arrow_map(rows.select("vec_id", "v"), met, FOUND + (f", v array<{vectors}>" if vectors else ""))


def probes_for(rows: DataFrame, queries: DataFrame, shape: Hash, k: int, kind: str, judges: int = JUDGES, target: float = TARGET) -> int:
    """How many buckets of a table must be probed so that ``target`` of the k nearest of ``judges`` queries are candidates."""
    asked = queries.orderBy(F.xxhash64("vec_id"), "vec_id", F.xxhash64("v")).limit(judges).collect()
    if not asked:
        return 1
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    truth = _against(rows, asked, k, shape.width, kind).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "v").collect()
    if not truth:
        return 1
    row_of = {r["vec_id"]: n for n, r in enumerate(asked)}
    x = np.array([r["v"] for r in asked])
    own, of = shape.own(np.array([r["v"] for r in truth])), np.array([row_of[r["query_id"]] for r in truth])
    many = min(256, shape.buckets)
    while True:
        ranks = np.full(len(truth), many)
        probed = shape.probes(x, many)
        for n in range(len(truth)):
            hit = (probed[of[n]] == own[n][:, None]).any(0)
            if hit.any():
                ranks[n] = hit.argmax()
        if (ranks < many).mean() >= target or many >= min(shape.buckets, 1 << 16):
            return int(np.sort(ranks)[min(len(ranks) - 1, math.ceil(target * len(ranks)) - 1)]) + 1
        many = min(4 * many, shape.buckets)


def _searched(queries: DataFrame, rows: DataFrame, k: int, width: int, block: int = 4096) -> DataFrame:
    """Against all rows, in blocks of queries that are broadcast one after the other; an id's vectors may lie in several."""
    out, after = None, None
    queries = cut(queries.withColumn("row", F.monotonically_increasing_id())).orderBy("row")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    while True:
        got = (queries if after is None else queries.where(F.col("row") > after)).limit(block).collect()
        if not got:
            return out.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        after = got[-1]["row"]
        found = _against(rows, got, k, width)
        out = found if out is None else out.union(found)
