"""What the operators of this subpackage share: reliable cuts, Arrow helpers, hash tables."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Words: everything between the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Documents are decoded in slices of so many rows and about so many bytes, whatever the Arrow batch.
SLICE_ROWS, SLICE_BYTES = 512, 1 << 19
LAST_ID = (1 << 63) - 1
#: Of an estimated size in bytes, as a number of bits.
ABSURD_BITS = 192


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all runs in
    one process (tests)."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not known and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(known or tempfile.mkdtemp(prefix="vertexloom-"))
    return known or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint: lost executors cost a reread, and no branch computes ``df`` twice.

    A checkpoint hands on its plan's estimated size, which loops over joins multiply until planning stands still; once it is
    absurd, ``df`` is written as a table instead.
    """
    spark = df.sparkSession
    shared_dir(spark)
    if int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()).bit_length() > ABSURD_BITS:
        return written(df)
    out = df.checkpoint()
    del df  # its plan holds the shuffles
    release(spark)
    return out


def written(df: DataFrame) -> DataFrame:
    """As ``cut``, but columnar: Parquet in the shared folder, for tables with many rows of few bytes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    schema = df.schema
    del df
    release(spark)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of phases that are over, instead of at the next chance collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Give executors this package as a zip, so that workers need no PYTHONPATH; once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_vertexloom_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    path = os.path.join(tempfile.mkdtemp(prefix="vertexloom-"), "vertexloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"vertexloom/{p.relative_to(root)}")
    sc.addPyFile(path)
    sc._vertexloom_shipped = True


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow``, for names with dots and back-ticks too, if ``schema`` is a StructType."""
    ship(df.sparkSession)
    names = df.columns
    if not isinstance(schema, StructType) or not set(".`") & set("".join(names)):
        return df.mapInArrow(fn, schema)
    plain = StructType([StructField(f"c{k}", f.dataType, f.nullable) for k, f in enumerate(schema)])

    def renamed(batches):
        for batch in fn(b.rename_columns(names) for b in batches):
            yield batch.rename_columns(plain.names)

    return df.toDF(*[f"c{k}" for k in range(len(names))]).mapInArrow(renamed, plain).toDF(*schema.names)


def holdout(doc_id, modulus: int):
    """Whether crc32 of the id as text leaves remainder 2; ids that are null don't."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == 2, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Each slice of rows with its texts as UTF-8 (null: empty); a slice is bounded in rows and bytes, one text at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
        ends = np.cumsum(np.fromiter((0 if n is None else n for n in pa.compute.binary_length(column).to_pylist()), np.int64, batch.num_rows))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, min(start + SLICE_ROWS, int(np.searchsorted(ends, before + SLICE_BYTES, side="right"))))
            yield batch.slice(start, stop - start), [b or b"" for b in column.slice(start, stop - start).to_pylist()]
            start = stop


def mixed(a: np.ndarray) -> np.ndarray:
    """The finaliser of MurmurHash3 over uint64."""
    a = a ^ (a >> np.uint64(33))
    a = a * np.uint64(0xFF51AFD7ED558CCD)
    a ^= a >> np.uint64(33)
    a = a * np.uint64(0xC4CEB9FE1A85EC53)
    return a ^ (a >> np.uint64(33))


class Lookup:
    """From distinct uint64 keys under 2**63 to their positions, by open addressing; -1 for others."""

    EMPTY = np.uint64((1 << 64) - 1)

    def __init__(self, keys: np.ndarray):
        keys = np.asarray(keys, np.uint64)
        bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.slots = np.full(1 << bits, self.EMPTY, np.uint64)
        self.at = np.full(1 << bits, -1, np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        place = self._home(keys)
        while len(left):
            free = self.slots[place] == self.EMPTY
            self.slots[place[free]] = keys[left[free]]
            won = self.slots[place] == keys[left]
            self.at[place[won]] = left[won]
            left, place = left[~won], (place[~won] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        place = self._home(keys)
        seen = self.slots[place]
        out = np.where(seen == keys, self.at[place], np.int32(-1))
        left = np.flatnonzero((seen != keys) & (seen != self.EMPTY))
        while len(left):
            place_left = (place[left] + 1) & self.mask
            place[left] = place_left
            seen = self.slots[place_left]
            hit = seen == keys[left]
            out[left[hit]] = self.at[place_left[hit]]
            left = left[~hit & (seen != self.EMPTY)]
        return out


def quoted(names: list[str]) -> list[str]:
    """Column names as they are selected by, whatever they hold."""
    return ["`" + n.replace("`", "``") + "`" for n in names]


def fresh(taken: list[str], *names: str) -> list[str]:
    """``names`` with underscores in front until none clashes with a column in ``taken``."""
    known, out = {c.lower() for c in taken}, []
    for n in names:
        n = f"_{n}"
        while n.lower() in known:
            n = f"_{n}"
        known.add(n.lower())
        out.append(n)
    return out
