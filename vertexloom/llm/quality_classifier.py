"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Features of a text: its words hashed to ``WORDS`` buckets with damped, length-normalised counts; the shares of
``_text.measure``, each as the one of its bins that holds it; and metadata, the bins of the size columns (bytes,
words, lines). Label, language, source and id are never features. The score is

    sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)**2 - sum_i v_if**2 x_i**2)),

linear in the number of features present. Training takes at most ``bound`` labelled documents, by smallest id hash;
everything else reads every row. Rows: one for each document; null and empty texts are scored as empty texts. Null
labels teach nothing; without both classes the score is 0.5. Other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.llm import _text
from vertexloom.llm._shared import arrow_map, holdout, slices
from vertexloom.llm.quality_rules import sampled

WORDS, BINS, FACTORS = 1 << 15, 16, 8
_SIZES = 3  # bytes, words, lines
SIZE = WORDS + (len(_text.SHARES) + _SIZES) * BINS
#: How much each word bucket weighs beside a statistic's bin: words decide where statistics don't.
WORD_SCALE = 0.5
#: Upper edges of the bins of shares that lie in 0..1; the others take a logarithm first.
_EDGES = np.array([0.001, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.75, 0.9])
_UNBOUNDED = {"mean_word", "words_per_line"}


class Features:
    """Feature vectors; keeps the buckets of words it has met, up to a bound."""

    def __init__(self):
        self.bucket: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        counts, shares, words = _text.measure(text)
        bag: dict[int, int] = {}
        if len(self.bucket) > 400_000:
            self.bucket.clear()
        for w in words:
            b = self.bucket.get(w)
            if b is None:
                b = self.bucket[w] = zlib.crc32(w.lower()) % WORDS
            bag[b] = bag.get(b, 0) + 1
        index = np.fromiter(bag, np.int64, len(bag))
        value = np.log1p(np.fromiter(bag.values(), float, len(bag)))
        if len(bag):
            value *= WORD_SCALE / np.sqrt((value**2).sum())
        bins = []
        for k, (name, s) in enumerate(zip(_text.SHARES, shares, strict=True)):
            at = min(BINS - 1, int(2 * np.log2(1 + s))) if name in _UNBOUNDED else int(np.searchsorted(_EDGES, s))
            bins.append(WORDS + k * BINS + at)
        for k, n in enumerate((len(text), counts[0], text.count(b"\n") + 1)):
            bins.append(WORDS + (len(_text.SHARES) + k) * BINS + min(BINS - 1, int(n).bit_length()))
        return np.concatenate([index, bins]).astype(np.int32), np.concatenate([value, np.full(len(bins), 0.5)])


class Machine:
    """The factorisation machine; ``fit`` is Adagrad on the logistic loss with L2, from a fixed seed."""

    def __init__(self, size: int = SIZE, factors: int = FACTORS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.w0, self.w = 0.0, np.zeros(size)
        self.v = rng.normal(0, 0.02, (size, factors))

    def raw(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores before the sigmoid of rows laid end to end (none empty)."""
        vx = self.v[index] * value[:, None]
        sums, squares = np.add.reduceat(vx, starts), np.add.reduceat(vx * vx, starts)
        return self.w0 + np.add.reduceat(self.w[index] * value, starts) + 0.5 * (sums * sums - squares).sum(1)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, epochs: int = 6, rate: float = 0.15, l2: float = 1e-5, seed: int = 7) -> Machine:
        label = np.asarray(label, float)
        if not len(label) or label.min() == label.max():
            self.v[:] = 0
            return self
        share = label.mean()
        weight = np.where(label == 1, 0.5 / share, 0.5 / (1 - share)) ** 0.5
        rng = np.random.default_rng(seed)
        gw, gv, g0 = np.full(len(self.w), 1e-3), np.full(self.v.shape, 1e-3), 1e-3
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 64)):
                index = np.concatenate([rows[i][0] for i in part])
                value = np.concatenate([rows[i][1] for i in part])
                lengths = np.array([len(rows[i][0]) for i in part])
                starts = np.cumsum(lengths) - lengths
                vx = self.v[index] * value[:, None]
                sums = np.add.reduceat(vx, starts)
                raw = self.w0 + np.add.reduceat(self.w[index] * value, starts) + 0.5 * (sums * sums - np.add.reduceat(vx * vx, starts)).sum(1)
                error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label[part]) * weight[part] / len(part)
                each = np.repeat(error, lengths) * value
                used, owner = np.unique(index, return_inverse=True)
                dw = np.bincount(owner, each, len(used)) + l2 * self.w[used]
                dv_each = each[:, None] * (np.repeat(sums, lengths, axis=0) - vx)
                dv = np.stack([np.bincount(owner, dv_each[:, f], len(used)) for f in range(self.v.shape[1])], 1) + l2 * self.v[used]
                gw[used] += dw**2
                gv[used] += dv**2
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                self.v[used] -= rate * 0.3 * dv / np.sqrt(gv[used])
                g0 += error.sum() ** 2
                self.w0 -= rate * error.sum() / np.sqrt(g0)
        return self

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        lengths = np.array([len(r[0]) for r in rows])
        raw = self.raw(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), np.cumsum(lengths) - lengths)
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, bound: int = 8000, where: Column | None = None) -> Machine:
    """Trained on at most ``bound`` labelled documents that ``where`` (over labels) admits."""
    sample, label = sampled(docs, labels, bound, where)

    def features(batches):
        make = Features()
        for batch, texts in slices(batches):
            rows = [make(t) for t in texts]
            yield pa.record_batch([batch.column(0), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1].astype(np.float32) for r in rows], pa.list_(pa.float32()))], ["doc_id", "index", "value"])

    got = arrow_map(sample, features, "doc_id long, index array<int>, value array<float>").orderBy("doc_id", F.xxhash64("index", "value")).toArrow()
    rows = [(i, v.astype(float)) for i, v in zip(*(_lists(got.column(c)) for c in ("index", "value")), strict=True)]
    return Machine().fit(rows, np.array([label[d] for d in got.column("doc_id").to_pylist()]))


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [a for chunk in column.chunks for a in np.split(chunk.flatten().to_numpy(), np.cumsum(pa.compute.list_value_length(chunk).to_numpy())[:-1])] if len(column) else []


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, bound: int = 8000, modulus: int = 4) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; the fold with remainder 2 is never learned from."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, bound, ~holdout(F.col("doc_id"), modulus)))

    def scored(batches):
        make = Features()
        for batch, texts in slices(batches):
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(model.value.score([make(t) for t in texts]))], ["doc_id", "held_out", "score"])

    out = arrow_map(docs.select(F.col("doc_id").cast("long"), "text", holdout(F.col("doc_id"), modulus).alias("held_out")), scored, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, bound: int = 8000, modulus: int = 4) -> DataFrame:
    """The whole rows that ``classify`` gives 1, with all their columns; the texts are not shuffled."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, bound, ~holdout(F.col("doc_id"), modulus)))

    def kept(batches):
        make = Features()
        for batch, texts in slices(batches):
            yield batch.filter(pa.array(model.value.score([make(t) for t in texts]) >= threshold))

    return arrow_map(docs, kept, docs.schema)
