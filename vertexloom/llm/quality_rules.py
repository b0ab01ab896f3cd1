"""Quality rules: learned decision lists over text statistics.

``learn`` covers the labelled rows one rule at a time: it grows a conjunction of thresholds by information gain on one
part of the rows, prunes it on the other, keeps it if it is precise there, and removes what it covers. ``verdict`` is
the list as one Spark conditional expression, the first rule that fires deciding.
``rules`` applies it to documents: statistics, a base filter and the list's verdict for every row.

Rows: one for each document, null texts being empty (no words, so the base fails). Null labels, and labels without a
document, teach nothing; without labelled rows of both kinds the list is empty and keeps what the base keeps. Of
documents that share a labelled id each teaches. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.llm import _text
from vertexloom.llm._shared import arrow_map, slices

FIELDS = (*_text.COUNTS, *_text.SHARES)
SCHEMA = "doc_id long, " + ", ".join([*(f"{c} long" for c in _text.COUNTS), *(f"{c} double" for c in _text.SHARES)])


@dataclass(frozen=True)
class Rule:
    """All (column, above, threshold) hold: the row is of class ``label``; ``precision`` is that on the pruning rows."""

    conditions: tuple[tuple[str, bool, float], ...]
    label: int
    precision: float
    covered: int

    def fires(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(columns.values()))), bool)
        for name, above, at in self.conditions:
            out &= (columns[name] > at) if above else (columns[name] <= at)
        return out

    def expression(self) -> Column:
        out = F.lit(True)
        for name, above, at in self.conditions:
            out = out & ((F.col(name) > at) if above else (F.col(name) <= at))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {'>' if a else '<='} {t:.6g}" for n, a, t in self.conditions) + f" -> {self.label}"


def _grown(columns, names, target, at_most: int) -> list[tuple[str, bool, float]]:
    """Add the condition with the largest gain (as in FOIL) until only targets are covered."""
    inside, out = np.ones(len(target), bool), []
    while len(out) < at_most and inside.any() and not target[inside].all():
        before = np.log2((target[inside].sum() + 1e-9) / inside.sum())
        best, gain = None, 1e-6
        y = target[inside]
        for name in names:
            x = columns[name][inside]
            order = np.argsort(x, kind="stable")
            xs, hits = x[order], np.cumsum(y[order])
            ends = np.flatnonzero(xs[1:] != xs[:-1])
            if not len(ends):
                continue
            low_n, low_p = ends + 1, hits[ends]
            for above, n, p in ((False, low_n, low_p), (True, len(xs) - low_n, hits[-1] - low_p)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gains = np.where(p > 0, p * (np.log2(p / n) - before), -1)
                k = int(np.argmax(gains))
                if gains[k] > gain:
                    best, gain = (name, above, float((xs[ends[k]] + xs[ends[k] + 1]) / 2)), float(gains[k])
        if best is None:
            break
        out.append(best)
        inside &= (columns[best[0]] > best[2]) if best[1] else (columns[best[0]] <= best[2])
    return out


def learn(columns: dict[str, np.ndarray], label: np.ndarray, target: int = 0, at_most: int = 4, most_rules: int = 12, precision: float = 0.9) -> list[Rule]:
    """Ordered rules for ``target``; rows that none covers are of the other class. Every third row prunes."""
    label = np.asarray(label)
    hit, rules = label == target, []
    if not hit.any() or hit.all():
        return rules
    left, prune = np.ones(len(label), bool), np.arange(len(label)) % 3 == 2
    names = sorted(columns)
    while len(rules) < most_rules:
        grow = left & ~prune
        if hit[grow].sum() < 3:
            break
        conditions = _grown({n: columns[n][grow] for n in names}, names, hit[grow], at_most)
        if not conditions:
            break
        test = left & prune

        def worth(cs):
            fires = Rule(tuple(cs), target, 0, 0).fires(columns) & test if cs else test
            return (hit[fires].sum() + 1) / (fires.sum() + 2)

        while len(conditions) > 1 and worth(conditions[:-1]) >= worth(conditions):
            conditions = conditions[:-1]
        rule = Rule(tuple(conditions), target, 0, 0)
        fires = rule.fires(columns) & left
        on_test = fires & test
        seen = hit[on_test].mean() if on_test.any() else hit[fires].mean()
        if seen < precision:
            break
        rules.append(Rule(rule.conditions, target, float(seen), int(fires.sum())))
        left &= ~fires
    return rules


def verdict(rules: list[Rule], otherwise: int = 1) -> Column:
    """The class as one ordered conditional expression."""
    out = None
    for r in rules:
        out = F.when(r.expression(), r.label) if out is None else out.when(r.expression(), r.label)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def _measured(batches):
    for batch, texts in slices(batches):
        rows = [_text.measure(t)[:2] for t in texts]
        counts, shares = (list(zip(*x, strict=True)) for x in zip(*rows, strict=True))
        yield pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), *(pa.array(s, pa.float64()) for s in shares)], ["doc_id", *FIELDS])


def statistics(docs: DataFrame) -> DataFrame:
    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), _measured, SCHEMA)


def sampled(docs: DataFrame, labels: DataFrame, bound: int, where: Column | None = None) -> tuple[DataFrame, dict[int, int]]:
    """The documents of up to ``bound`` ids with a quality label, those with the smallest hashes, and their labels. Of several
    texts under one id that with the smallest hash stands for it, so that rows are bounded too."""
    teach = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    if where is not None:
        teach = teach.where(where)
    chosen = {r[0]: r[1] for r in teach.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).orderBy(F.xxhash64("doc_id"), "doc_id", F.desc("quality")).limit(bound).collect()}
    ids = docs.sparkSession.createDataFrame([(k,) for k in chosen], "doc_id long")
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(ids), "doc_id", "left_semi")
    return rows.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")), chosen


def fit(docs: DataFrame, labels: DataFrame, bound: int = 8000, **options) -> list[Rule]:
    """Rules for label 0 of ``quality``, from at most ``bound`` labelled documents."""
    sample, label = sampled(docs, labels, bound)
    rows = statistics(sample).toPandas().sort_values(["doc_id", *FIELDS], kind="stable")
    return learn({c: rows[c].to_numpy(float) for c in (*_text.SHARES, "n_words")}, rows["doc_id"].map(label).to_numpy(), **options)


def rules(docs: DataFrame, labels: DataFrame, bound: int = 8000) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the statistics that the rules name."""
    learned = fit(docs, labels, bound)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return statistics(docs).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (verdict(learned) == 1))
