"""Packing by minimum bin slack.

A document's ids are cut into windows of ``capacity``; what remains of each is one piece. How the pieces fill windows
depends on their lengths only, so the driver plans with one count for each length (``capacity`` numbers, whatever
the data): again and again it takes the longest length left, a bitset of reachable sums finds the multiset of other
lengths that leaves the least slack, backtracking gives its counts, and the window is repeated as often as the counts
allow. A plan has a bounded number of patterns for any number of documents. Pieces of a length are numbered (ranges of
hashed ids, so that a hot length is dealt over many tasks), and a number decides the window and the place in it.

Rows: a piece each; a document has one at least, as its end id counts. Null texts are empty. Equal pieces are
interchangeable. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.llm._shared import arrow_map, cut, slices
from vertexloom.llm.token_counts import encoded

RANGE = 2048


def fill(room: int, counts: dict[int, int]) -> dict[int, int]:
    """How many of each length fill ``room`` with the least slack: subset sums in a bitset, counts backtracked."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((n for n in counts if n <= room and counts[n]), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & mask
            left -= k
            k *= 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, defaultdict(int)
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            out[length] += k
            total -= length * k
    return dict(out)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Windows as (count of each length, repetitions) that use up ``counts``."""
    left, out = {n: c for n, c in counts.items() if c}, []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        window = fill(capacity - longest, rest)
        window[longest] = window.get(longest, 0) + 1
        times = min(left[n] // k for n, k in window.items())
        out.append((window, times))
        for n, k in window.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return out


class Placement:
    """From a length and a number among its pieces to a window and an offset."""

    def __init__(self, windows: list[tuple[dict[int, int], int]]):
        rows, used, first = defaultdict(list), defaultdict(int), 0
        for window, times in windows:
            offset = 0
            for length, k in sorted(window.items(), reverse=True):
                rows[length].append((used[length], k, first, offset))
                used[length] += k * times
                offset += length * k
            first += times
        self.rows = {n: np.array(r, np.int64) for n, r in rows.items()}

    def __call__(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        window, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for n in np.unique(length):
            here = length == n
            rows = self.rows[int(n)]
            row = rows[np.searchsorted(rows[:, 0], number[here], side="right") - 1]
            nth = number[here] - row[:, 0]
            window[here] = row[:, 2] + nth // row[:, 1]
            offset[here] = row[:, 3] + nth % row[:, 1] * n
        return window, offset


def pieces(docs: DataFrame, path: str, end: int = 1, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids of every piece."""

    def made(batches):
        for batch, texts in slices(batches):
            rows, ids_out = [], []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded(path, texts), strict=True):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                for at in range(0, len(ids), capacity):
                    part = ids[at : at + capacity]
                    rows.append((doc_id, at, len(part), zlib.crc32(part.tobytes()), len(ids)))
                    if with_ids:
                        ids_out.append(part.astype(np.int32))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            yield pa.record_batch([*columns, *([pa.array(ids_out, pa.list_(pa.int32()))] if with_ids else [])], [*NAMES, *(["ids"] if with_ids else [])])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), made, ", ".join(f"{n} long" for n in NAMES) + (", ids array<int>" if with_ids else ""))


NAMES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")


def pack(docs: DataFrame, path: str, end: int = 1, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """The pieces with sequence_id and offset; a sequence holds ``capacity`` ids at most, without gaps from 0.

    What is not UTF-8 in a text is encoded as replacement characters.
    """
    parts = cut(pieces(docs, path, end, capacity, with_ids))
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}
    place = parts.sparkSession.sparkContext.broadcast(Placement(plan(counts, capacity)))
    key = F.xxhash64("doc_id", "start", "ids_crc32")
    bits = max(0, (sum(counts.values()) // RANGE).bit_length())
    parts = parts.withColumn("key", key).withColumn("range", F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long"))
    ranges = parts.groupBy("length", "range").count()
    before = ranges.select(F.col("length").alias("l"), F.col("range").alias("r"), (F.sum("count").over(Window.partitionBy("length").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")).alias("before"))
    inner = Window.partitionBy("length", "range").orderBy("key", "doc_id", "start", "ids_crc32")
    numbered = parts.withColumn("nth", F.row_number().over(inner) - 1)
    numbered = numbered.join(before, (F.col("length") == F.col("l")) & (F.col("range") == F.col("r"))).withColumn("nth", (F.col("nth") + F.col("before")).cast("long"))
    names = [*NAMES, *(["ids"] if with_ids else [])]

    def placed(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            window, offset = place.value(batch.column(2).to_numpy(), batch.column(len(names)).to_numpy())
            yield pa.record_batch([*batch.columns[: len(names)], pa.array(window), pa.array(offset)], [*names, "sequence_id", "offset"])

    return arrow_map(numbered.select(*names, "nth"), placed, ", ".join(f"{n} long" for n in NAMES) + (", ids array<int>" if with_ids else "") + ", sequence_id long, offset long")
