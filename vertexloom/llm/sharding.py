"""Sharding by a permutation-filled lookup table (a prime number of slots).

Each shard prefers the slots in an order of its own, ``(offset + j * skip) mod slots``; shards take turns claiming
their next free preference until the table is full, so shares differ by one slot at most and losing a shard moves few
other keys. Placement is ``table[xxhash64(key) mod slots]``: the table has a fixed size whatever the data, so it is
broadcast, and the rows stay where they are. A null key hashes like any other value (to Spark's seed) and so has a
place; equal keys share one.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.llm._shared import fresh

SLOTS = 65537


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot the position of its shard in ``shards``; ``slots`` is prime and not less than their number."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct, and one at least")
    if slots < max(2, len(shards)) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime not below the number of shards")
    at = [xxhash.xxh64_intdigest(s, 1) % slots for s in shards]
    skip = [xxhash.xxh64_intdigest(s, 2) % (slots - 1) + 1 for s in shards]
    table, filled = [-1] * slots, 0
    while True:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            table[at[i]] = i
            filled += 1
            if filled == slots:
                return table


def shard(df: DataFrame, key: Column, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """``df`` with ``slot`` and ``shard``; columns of these names are replaced."""
    placed = lookup_table(shards, slots)
    rest = [c for c in df.columns if c.lower() not in ("slot", "shard")]
    at, to = fresh(rest, "slot", "shard")
    table = df.sparkSession.createDataFrame([(k, shards[i]) for k, i in enumerate(placed)], f"{at} long, {to} string")
    joined = df.select(*rest, F.pmod(F.xxhash64(key), F.lit(slots)).cast("long").alias(at)).join(F.broadcast(table), at)
    return joined.select(*rest, F.col(at).alias("slot"), F.col(to).alias("shard"))
