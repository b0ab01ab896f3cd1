"""Substring dedup by fixed-block anchors.

A document's reference blocks are its words cut every ``block`` words; a window of ``window`` words holds at least
``reach`` = (window - block + 1) // block whole ones. Every rolling block of every document probes the reference blocks:

1. of the rolling blocks on each of the ``block`` grids a task keeps the least hashed among ``reach`` neighbours.
   Reference blocks are grid 0, chosen by the same rule, so a shared window always has a chosen reference block that a
   chosen rolling block meets; the others can't be needed;
2. a block lives if some document owns it and a later one has it. A window over it holds half of its other words on
   one side of the block at least, so a hit, a place of a live block, must have that half in common too. All windows
   over a hit are extended word by word: the XXH3-128 of each window's bytes meet in one aggregate with the first document
   of each, so that neighbouring windows make up the maximal repeats, and no pairs of documents are formed. The quicker
   hashes of words, blocks and halves only choose these windows: one that collides costs time and removes nothing;
3. each document drops the words under its windows that an earlier document has.

Whole copies are known by 128 bits of their texts (XXH64 with two seeds): they are dropped by that alone (if they hold a window) and spare
stage 2 their windows, as the first copy stands for them.

Texts are read in place for 1 and joined by document for 2 (documents with hits) and 3. Counts are pre-summed by task;
a passage that many documents share costs a row for each of its windows in each.

Rows: one for each document. A null text has no words. A null id comes after all others, and two such don't compare;
rows of one id don't either. Repeated rows have equal results. Other columns pass through ``deduplicated`` untouched.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm._shared import LAST_ID, arrow_map, cut, fresh, mixed, quoted, slices, written

WINDOW, BLOCK = 50, 5
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
_WHITE = np.zeros(256, bool)
_WHITE[list(b" \t\n\x0b\x0c\r")] = True


class Words:
    """64-bit hashes of all words of some texts, without taking the words apart: by prefix sums over the bytes. Equal words
    have equal hashes; the reverse may fail (for one, on words of the Thue-Morse sequence), so nothing is removed by them."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes, and the text of each."""
        buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        if len(buffer) > len(self.up):
            self.up, self.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(buffer), x)])) for x in (_BASES[0], np.uint64(pow(int(_BASES[0]), -1, 1 << 64))))
        word = ~_WHITE[buffer]
        edge = np.diff(np.concatenate([[False], word]).view(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((buffer + np.uint64(1)) * self.up[: len(buffer)])])
        hashes = mixed((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))
        return hashes, np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")


def rolling(hashes: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash of every window of ``width``."""
    n = len(hashes) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    if width <= 8:
        out = np.zeros(n, np.uint64)
        for k in range(width):
            out = out * base + hashes[k : n + k]
        return mixed(out)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(hashes) - 1, base)]))
    back = np.uint64(pow(int(base), -1, 1 << 64))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * powers)])
    return mixed((sums[width:] - sums[:n]) * np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, back)])))


def chosen(blocks: np.ndarray, text: np.ndarray, block: int, reach: int) -> np.ndarray:
    """The rolling blocks that are least, the first of equals, among some ``reach`` neighbours on their grid.

    ``text`` is the text of each word; neighbours lie in one text, and so do their words.
    """
    n = len(blocks) - (reach - 1) * block
    if n < 1:
        return np.zeros(0, np.int64)
    least, at, span = blocks, np.arange(len(blocks)), 1
    while span < reach:
        step = min(span, reach - span)
        later, later_at = least[step * block :], at[step * block :]
        less = later < least[: len(later)]
        least, at = np.where(less, later, least[: len(later)]), np.where(less, later_at, at[: len(later)])
        span += step
    keep = np.zeros(len(blocks), bool)
    keep[at[:n][text[:n] == text[reach * block - 1 : reach * block - 1 + n]]] = True
    return np.flatnonzero(keep)


def sides(words: np.ndarray, text: np.ndarray, at: np.ndarray, block: int, half: int) -> list[pa.Array]:
    """Hashes of the ``half`` words before and after each block at ``at``; null where its text has fewer there."""
    if not half:
        return [pa.array(np.zeros(len(at), np.int32))] * 2
    runs = (rolling(words, half, _BASES[1]) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    out = []
    for start in (at - half, at + block):
        inside = (start >= 0) & (start < len(runs))
        start = np.where(inside, start, 0)
        inside &= (text[start] == text[at]) & (text[np.minimum(start + half, len(text)) - 1] == text[at])
        out.append(pa.array(runs[start] if len(runs) else np.zeros(len(at), np.int32), mask=~inside))
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """doc (the id, null last) and digest (of the text) name a row; rows that share both are equal in all that counts here."""
    return docs.withColumn("_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))).withColumn("_digest", F.xxhash64("text"))


def repeats(docs: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """_doc, _digest, spans and whole of the documents that repeat an earlier one: starts of the windows that it has, or
    that all of the document is a copy (then without spans)."""
    reach, half = (window - block + 1) // block, (window - block) // 2
    if reach < 1:
        raise ValueError("window must hold a whole block wherever it starts")
    keyed = _keyed(docs.select("doc_id", "text")).select("_doc", "_digest", "text")

    def anchors(batches):
        hashes = Words()
        for batch, texts in slices(batches):
            ids, digests = (batch.column(k).to_numpy() for k in (0, 1))
            words, rows = hashes(texts)
            blocks = rolling(words, block, _BASES[0])
            at = chosen(blocks, rows, block, reach)
            at = at[np.bincount(rows, minlength=len(texts))[rows[at]] >= window]
            row = rows[at]
            place = at - np.searchsorted(rows, row)
            yield pa.record_batch([pa.array(blocks[at].view(np.int64)), pa.array(ids[row]), pa.array(digests[row]), pa.array(place.astype(np.int32)), *sides(words, rows, at, block, half)], ["key", "_doc", "_digest", "place", "left", "right"])

    def living(rows, *keys):
        return cut(rows.groupBy(*keys).agg(F.min(F.when(owned, F.col("_doc"))).alias("first"), F.max("_doc").alias("last")).where("first < last"))

    probes = arrow_map(keyed, anchors, "key long, _doc long, _digest long, place int, left int, right int")
    owned = F.col("place") % block == 0
    shared = (F.col("_doc") > F.col("first")) | (owned & (F.col("_doc") < F.col("last")))
    hits = written(probes.join(living(probes, "key"), "key").where(shared).drop("first", "last"))
    hits = hits.select("key", "_doc", "_digest", "place", F.posexplode(F.array("left", "right")).alias("side", "half")).where("half is not null")
    hits = hits.join(living(hits, "key", "side", "half"), ["key", "side", "half"]).where(shared)
    marks = cut(hits.groupBy("_doc", "_digest").agg(F.collect_set("place").alias("places")))
    texts = keyed.where("text is not null").select("_doc", "_digest", F.xxhash64("text", F.lit(1)).alias("more"))
    firsts = cut(texts.groupBy("_digest", "more").agg(F.min("_doc").alias("first"), F.max("_doc").alias("last")).where("first < last").drop("last"))
    copies = cut(texts.join(firsts, ["_digest", "more"]).where("_doc > first").select("_doc", "_digest").distinct())
    marks = marks.join(copies, ["_doc", "_digest"], "left_anti")

    def extended(batches):
        for batch, texts in slices(batches):
            found, rows, starts = [], [], []
            for k, (text, places) in enumerate(zip(texts, batch.column(3).to_pylist(), strict=True)):
                words = text.split()
                ends = np.cumsum([len(w) + 1 for w in words])
                n = len(words) - window + 1
                edge = np.zeros(n + 1, np.int64)
                places = np.array(places)
                np.add.at(edge, np.clip(places - (window - block), 0, n), 1)
                np.add.at(edge, np.clip(places + 1, 0, n), -1)
                at = np.flatnonzero(np.cumsum(edge)[:n] > 0)
                stream, begins = b" ".join(words), np.concatenate([[0], ends[:-1]])
                names = b"".join([xxhash.xxh3_128_digest(stream[i:j]) for i, j in zip(begins[at].tolist(), (ends[at + window - 1] - 1).tolist(), strict=True)])
                found.append(np.frombuffer(names, "<i8").reshape(-1, 2))
                rows.append(np.full(len(at), k))
                starts.append(at)
            rows, names = np.concatenate(rows).astype(np.int64), np.concatenate(found)
            yield pa.record_batch([pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array(batch.column(0).to_numpy()[rows]), pa.array(batch.column(1).to_numpy()[rows]), pa.array(np.concatenate(starts).astype(np.int32))], ["a", "b", "_doc", "_digest", "place"])

    windows = written(arrow_map(keyed.join(marks, ["_doc", "_digest"]).select("_doc", "_digest", "text", "places"), extended, "a long, b long, _doc long, _digest long, place int"))
    first = cut(windows.groupBy("a", "b").agg(F.min("_doc").alias("first"), F.max("_doc").alias("last")).where("first < last").drop("last"))
    spans = windows.join(first, ["a", "b"]).where("_doc > first").groupBy("_doc", "_digest").agg(F.collect_set("place").alias("spans"))
    none = F.lit(None).cast("array<int>")
    return cut(spans.withColumn("whole", F.lit(False)).unionByName(copies.select("_doc", "_digest", none.alias("spans"), F.lit(True).alias("whole"))))


def kept_words(words: list[bytes], spans: list[int] | None, whole: bool | None, window: int) -> list[bytes]:
    if whole:
        return [] if len(words) >= window else words
    if not spans:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.array(spans), 1)
    np.add.at(edge, np.array(spans) + window, -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(edge)[:-1] == 0)]


def digests(docs: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""

    def made(batches):
        for batch, texts in slices(batches):
            words = [t.split() for t in texts]
            kept = [kept_words(w, s, all_, window) for w, s, all_ in zip(words, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.record_batch([batch.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array([len(w) - len(k) for w, k in zip(words, kept, strict=True)], pa.int64()), pa.array([hashlib.sha256(b" ".join(k)).hexdigest() for k in kept], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    docs = docs.select("doc_id", "text")
    rows = _keyed(docs).join(repeats(docs, window, block), ["_doc", "_digest"], "left").select(F.col("doc_id").cast("long"), "text", "spans", "whole")
    return arrow_map(rows, made, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def deduplicated(docs: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """All rows; where words were removed the text is the kept words, joined by one space, else as it was."""
    columns = docs.columns

    def made(batches):
        for batch, texts in slices(batches):
            spans, wholes = (batch.column(len(columns) + k).to_pylist() for k in (0, 1))
            at = batch.schema.get_field_index("text")
            old = batch.column(at)
            if any(spans) or any(wholes):
                kept = [kept_words(t.split(), s, w, window) if s or w else None for t, s, w in zip(texts, spans, wholes, strict=True)]
                plain = pa.large_binary() if pa.types.is_large_string(old.type) else pa.binary()
                new = [o if k is None or w and k else b" ".join(k) for k, w, o in zip(kept, wholes, old.view(plain).to_pylist(), strict=True)]
                old = pa.array(new, plain).view(old.type)
            yield pa.record_batch([old if k == at else batch.column(k) for k in range(len(columns))], columns)

    doc, digest, found, all_ = fresh(columns, "doc", "digest", "spans", "whole")
    spans = repeats(docs, window, block).toDF(doc, digest, found, all_)
    named = docs.withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))).withColumn(digest, F.xxhash64("text"))
    rows = named.join(spans, [doc, digest], "left").select(*quoted([*columns, found, all_]))
    return arrow_map(rows, made, docs.schema)
