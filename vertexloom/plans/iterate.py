"""Loops on the driver over DataFrames: reliable cuts of the lineage, and a fixpoint."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


#: Of an estimated size in bytes, as a number of bits.
ABSURD_BITS = 192


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own if all runs in one process, as in tests."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not known and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(known or tempfile.mkdtemp(prefix="vertexloom-"))
    return known or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder, by a checkpoint.

    A checkpoint hands its plan's estimated size on, and loops over joins multiply that until planning stands still. Once it
    is absurd, ``df`` is written as a table instead, whose size Spark knows.
    """
    folder = shared_dir(df.sparkSession)
    if int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()).bit_length() < ABSURD_BITS:
        return df.checkpoint()
    path = f"{folder.rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` in partitions by ``keys``, checkpointed: joins on them don't shuffle it again."""
    shared_dir(df.sparkSession)
    return df.repartition(*keys).checkpoint()


class Rows:
    """Rows that rounds find one after the other. Each round's are written once, and parts are merged in groups of ``many``, so
    that a row is written a number of times that grows as the logarithm of the rounds."""

    def __init__(self, many: int = 16):
        self.many, self.levels = many, [[]]

    def add(self, df: DataFrame) -> None:
        self.levels[0].append(cut(df))
        for k, parts in enumerate(self.levels):
            if len(parts) == self.many:
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(cut(union(parts)))
                parts.clear()

    def all(self) -> DataFrame | None:
        parts = [p for level in self.levels for p in level]
        return union(parts) if parts else None


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fixpoint(state: DataFrame, step: Callable[[DataFrame], DataFrame], delta: Callable[[DataFrame, DataFrame], float], epsilon: float = 0.0, max_iter: int | None = None, every: int = 5) -> tuple[DataFrame, int]:
    """Repeat ``step`` until ``delta`` of two states is not above ``epsilon`` or ``max_iter`` steps are done.

    With ``epsilon`` 0 and a number of steps no delta is computed and states are cut each ``every`` steps only.
    """
    n = 0
    if not epsilon and max_iter is not None:
        while n < max_iter:
            state, n = step(state), n + 1
            if n % every == 0 and n < max_iter:
                state = cut(state)
        return state, n
    while max_iter is None or n < max_iter:
        new, n = cut(step(state)), n + 1
        change = delta(new, state)
        state = new
        if change <= epsilon:
            break
    return state, n
