"""SimHash near-duplicates: fingerprints, pigeonring candidates, components.

Fingerprint bits are majority votes of XXH64 (seed 42) over word shingles. Two fingerprints that differ in at most
``TAU`` = 4 bits are found by the pigeonring: split 64 bits into five segments on a ring; then some start exists from
which every run of l segments holds at most floor(4 l / 5) differences, that is 0, 1, 2, 3, 4 for l = 1..5. An index
key is a start, its segment and the next one (26 bits); a fingerprint probes the keys whose second segment differs from
its own in one bit or none. The rest of the ring is checked before the full distance. Keys under which more than
``HOT`` fingerprints lie, and those that these probe, are split by the third segment of the chain, with its budget, and
if that leaves as many by the fourth, under which at most 8,192 different fingerprints can lie. All stay exact.

Only distinct fingerprints are linked, so groups of copies cost one row; from a key's group comes a spanning forest of
its links and never all pairs. Components are found by alternating large and small stars over DataFrames.

Rows: one for each document, in any number of copies. A null or empty text has fingerprint zero and is linked like any
other. A null id takes part and gets the component's smallest id, null if it has none. Other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm._shared import arrow_map, cut, fresh, slices

TAU, WIDTHS, HOT = 4, (13, 13, 13, 13, 12), 20_000
#: Rows of one key that a join leaves together.
CROWD = 1024
BUDGET = [TAU * n // len(WIDTHS) for n in range(1, len(WIDTHS) + 1)]
_SHIFT = [64 - sum(WIDTHS[: i + 1]) for i in range(len(WIDTHS))]
_CHUNK = 1 << 15


def fingerprint(text: bytes, width: int = 4) -> int:
    """Of lower-cased (A-Z) words; unsigned."""
    words = text.lower().split()
    if not words:
        return 0
    stream = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    tails = ends[width - 1 :] if len(words) >= width else ends[-1:]
    ones = np.zeros(64, np.int64)
    for k in range(0, n, _CHUNK):
        hashes = np.array([xxhash.xxh64_intdigest(stream[a:b], 42) for a, b in zip(starts[k : min(n, k + _CHUNK)].tolist(), tails[k : k + _CHUNK].tolist(), strict=True)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row."""

    def made(batches):
        for batch, texts in slices(batches):
            yield pa.record_batch([batch.column(0), pa.array(np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64))], ["doc_id", "fp"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), made, "doc_id long, fp long")


def segment(fp: np.ndarray, i: int) -> np.ndarray:
    i %= len(WIDTHS)
    return (fp >> np.uint64(_SHIFT[i])) & np.uint64((1 << WIDTHS[i]) - 1)


def within(width: int, most: int) -> np.ndarray:
    """All masks of a segment with at most so many bits, by their number of bits."""
    return np.array([sum(1 << b for b in bits) for n in range(most + 1) for bits in combinations(range(width), n)], np.uint64)


def _rows(key, fp, indexed):
    return pa.record_batch([pa.array(key.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(indexed)], ["key", "fp", "indexed"])


ROWS = "key long, fp long, indexed boolean"


def _unsigned(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _probes(batches):
    """For each start the index key (``indexed``) and the other keys that its budget admits."""
    for batch in batches:
        fp = _unsigned(batch.column(0))
        for i in range(len(WIDTHS)):
            masks = within(WIDTHS[(i + 1) % len(WIDTHS)], BUDGET[1])
            head = (np.uint64(i) << np.uint64(26)) | (segment(fp, i) << np.uint64(13))
            keys = head[:, None] | (segment(fp, i + 1)[:, None] ^ masks[None, :])
            yield _rows(keys.ravel(), np.repeat(fp, len(masks)), np.tile(masks == 0, len(fp)))


_DEEP = {2: 0, 3: 1 << 62, 4: 1 << 61}  # marks keys by their number of segments
_START = {n: len(WIDTHS[:n]) * 13 for n in _DEEP}


def _spent(key: np.ndarray, fp: np.ndarray, start: int, depth: int) -> np.ndarray:
    """In how many bits the segments of a key of ``depth`` differ from the fingerprint's; -1 if it has another start."""
    bare = key & np.uint64((1 << 61) - 1)
    out = np.full(len(key), -1)
    here = (bare >> np.uint64(_START[depth])).astype(int) == start
    parts = [((bare[here] >> np.uint64(13 * (depth - 1 - j))) & np.uint64(8191)) ^ segment(fp[here], start + j) for j in range(depth)]
    out[here] = sum(np.bitwise_count(p).astype(int) for p in parts)
    return out


def _deeper(depth: int):
    """Rows of crowded keys of ``depth`` segments, by one more segment of their chain."""

    def split(batches):
        for batch in batches:
            key, fp, indexed = _unsigned(batch.column(0)), _unsigned(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)
            for i in range(len(WIDTHS)):
                spent_all = _spent(key, fp, i, depth)
                for spent in range(BUDGET[depth - 1] + 1):
                    here = spent_all == spent
                    masks = within(WIDTHS[(i + depth) % len(WIDTHS)], BUDGET[depth] - spent)
                    keys = ((key[here] & np.uint64((1 << 61) - 1)) << np.uint64(13))[:, None] | (segment(fp[here], i + depth)[:, None] ^ masks[None, :]) | np.uint64(_DEEP[depth + 1])
                    yield _rows(keys.ravel(), np.repeat(fp[here], len(masks)), (indexed[here][:, None] & (masks == 0)[None, :]).ravel())

    return split


def _beside(depth: int):
    """Keys of ``depth`` segments that fingerprints under the given ones probe, themselves included."""

    def near(batches):
        for batch in batches:
            key = _unsigned(batch.column(0))
            for i in range(len(WIDTHS)):
                own = key[((key & np.uint64((1 << 61) - 1)) >> np.uint64(_START[depth])).astype(int) == i]
                masks = [(0, 0)]
                for j in range(1, depth):
                    masks = [(m << 13 | int(x), n + int(x).bit_count()) for m, n in masks for x in within(WIDTHS[(i + j) % len(WIDTHS)], BUDGET[j] - n)]
                yield pa.record_batch([pa.array((own[:, None] ^ np.array([m for m, _ in masks], np.uint64)[None, :]).ravel().view(np.int64))], ["key"])

    return near


def chained(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the ring's budgets hold for every length from the key's start, and so the full distance does."""
    bare = key & np.uint64((1 << 61) - 1)
    start = np.select([key & np.uint64(_DEEP[3]) != 0, key & np.uint64(_DEEP[4]) != 0], [bare >> np.uint64(_START[3]), bare >> np.uint64(_START[4])], bare >> np.uint64(_START[2])).astype(np.int64)
    x = a ^ b
    parts = np.stack([np.bitwise_count(segment(x, i)) for i in range(len(WIDTHS))], 1).astype(np.int64)
    ok, spent = np.ones(len(x), bool), np.zeros(len(x), np.int64)
    for n, most in enumerate(BUDGET):
        spent = spent + parts[np.arange(len(x)), (start + n) % len(WIDTHS)]
        ok &= spent <= most
    return ok


def forest(fp: np.ndarray, indexed: np.ndarray, key: np.uint64 | None = None) -> list[tuple[int, int]]:
    """Links that connect what links within ``TAU`` to indexed members connect; one fewer than members at most. With a ``key``
    those links only whose chain from its start keeps the budgets: the others have another start."""
    group, out = np.arange(len(fp)), []
    for p in np.flatnonzero(indexed):
        other = np.flatnonzero(group != group[p])
        if not len(other):
            break
        near = other[np.bitwise_count(fp[other] ^ fp[p]) <= TAU] if key is None else other[chained(np.full(len(other), key), np.full(len(other), fp[p]), fp[other])]
        if len(near):
            joined, first = np.unique(group[near], return_index=True)
            out += [(int(fp[p]), int(fp[near[k]])) for k in first]
            group[np.isin(group, joined)] = group[p]
    return out


def _linked(batches):
    """Links of each key's group, from rows sorted by key."""

    def of(key, fp, indexed):
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(key)]]))
        good = (sizes > 1) & (np.add.reduceat(indexed.astype(np.int64), starts) > 0)
        found = []
        for s, n in zip(starts[good & (sizes > 48)], sizes[good & (sizes > 48)], strict=True):
            found += forest(*_distinct(fp[s : s + n], indexed[s : s + n]), key[s])
        group = np.repeat(np.arange(len(starts)), sizes)
        left = np.flatnonzero(indexed & (good & (sizes <= 48))[group])
        reps = sizes[group[left]]
        a = np.repeat(left, reps)
        b = np.arange(len(a)) - np.repeat(np.cumsum(reps) - reps, reps) + starts[group[a]] if len(a) else a
        ok = fp[a] != fp[b]
        a, b = a[ok], b[ok]
        ok = chained(key[a], fp[a], fp[b])
        pairs = np.concatenate([np.stack([fp[a[ok]], fp[b[ok]]], 1), np.array(found, np.uint64).reshape(-1, 2)]).view(np.int64)
        pairs = np.unique(np.sort(pairs, axis=1), axis=0)
        return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    held: list[tuple] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _unsigned(batch.column(0)), _unsigned(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(rows[0].view(np.int64), rows[0].view(np.int64)[-1]))
        if last == 0 and held and held[-1][0][-1] == rows[0][0]:
            held.append(rows)
            continue
        held.append(tuple(x[:last] for x in rows))
        done = [np.concatenate(x) for x in zip(*held, strict=True)]
        if len(done[0]):
            yield of(*done)
        held = [tuple(x[last:] for x in rows)]
    if held:
        yield of(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _distinct(fp, indexed):
    fp, at = np.unique(fp, return_inverse=True)
    return fp, np.bincount(at, indexed) > 0


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """a, b: enough of the pairs of different fingerprints within ``TAU`` bits to connect all that they connect."""
    rows, light = arrow_map(fps.select("fp"), _probes, ROWS), None
    for depth in (2, 3):
        full = rows.where("indexed").groupBy("key").count().where(F.col("count") > hot).select("key")
        crowded = cut(arrow_map(full, _beside(depth), "key long").distinct())
        if not crowded.take(1):
            break
        rest = rows.join(crowded, "key", "left_anti").select("key", "fp", "indexed")
        light = rest if light is None else light.union(rest)
        rows = cut(arrow_map(rows.join(crowded, "key", "left_semi").select("key", "fp", "indexed"), _deeper(depth), ROWS))
    rows = rows if light is None else light.union(rows)
    return arrow_map(rows.repartition("key").sortWithinPartitions("key"), _linked, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the component's smallest node) of all nodes in ``edges`` (a, b; long), by alternating stars."""
    state = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        digest = state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
        if digest == mark:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root")).union(state.select("v", "v")).distinct()
        mark = digest
        both = state.union(state.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        state = cut(large.join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(near).distinct())


def clustered(fps: DataFrame) -> DataFrame:
    """fp, root of every distinct fingerprint in ``fps`` (any number of rows)."""
    distinct = cut(fps.select("fp").distinct())
    roots = components(links(distinct))
    return distinct.join(roots, distinct.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def _met(rows: DataFrame, table: DataFrame, key: str, crowd: int = CROWD) -> DataFrame:
    """``rows`` with the columns of ``table``, which has a row for each ``key`` and in ``n`` how many rows it meets. Keys of
    more than ``crowd`` rows are dealt over salts; these keys are one for each ``crowd`` rows at most."""
    crowded = table.where(F.col("n") > crowd).select(key, F.ceil(F.col("n") / crowd).cast("int").alias("salts"))
    held = crowded.count()
    table = table.drop("n")
    if not held:
        return rows.join(table, key)
    crowded = F.broadcast(crowded) if held <= 1 << 16 else crowded
    last = F.coalesce("salts", F.lit(1)) - 1
    dealt = rows.join(crowded, key, "left").withColumn("salt", F.pmod(F.xxhash64(*rows.columns), last + 1).cast("int")).drop("salts")
    copies = table.join(crowded, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), last))).drop("salts")
    return dealt.join(copies, [key, "salt"]).drop("salt")


def near_duplicates(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every row."""
    fps = cut(fingerprints(docs, width))
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    known = cut(clustered(fps).join(least, "fp"))
    ids = known.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    label = cut(_met(known, ids, "root").select("fp", "component_id", F.col("copies").alias("n")))
    return _met(fps, label, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, width: int = 4) -> DataFrame:
    """The rows of ``docs``, one of each component: that with the smallest id (null last), of several the smallest text hash."""

    def made(batches):
        for batch, texts in slices(batches):
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64))], ["doc_id", "digest", "fp"])

    own, none, key = fresh(docs.columns, "text_digest", "kept_id", "kept_digest")
    digest = F.xxhash64("text")
    fps = cut(arrow_map(docs.select(F.col("doc_id").cast("long"), "text", digest.alias("digest")), made, "doc_id long, digest long, fp long"))
    best = fps.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("best"))
    kept = clustered(fps).join(best, "fp").groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.doc_id").alias(none), F.col("best.digest").alias(key))
    mine = docs.withColumn(own, digest)
    mine = mine.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(none)) & (F.col(own) == F.col(key)), "left_semi")
    return mine.dropDuplicates(["doc_id", own]).drop(own)
