"""Histogram bins: open constant width, bounded constant width, irregular edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Bins:
    """Two numbers are an origin and a width, open to the right. More are edges: half-open intervals, values outside
    are dropped. Edges are sorted and distinct; ``whole`` truncates them as for an integer property."""

    def __init__(self, edges: list[float], whole: bool = False):
        self.open = len(edges) == 2
        if len(edges) < 2:
            raise ValueError("bins need two numbers at least")
        if self.open:
            self.origin, self.width = edges
            if self.width <= 0:
                raise ValueError("bins of no width")
            return
        self.edges = sorted({float(int(e)) if whole else float(e) for e in edges})
        if len(self.edges) < 2:
            raise ValueError("bins of no width")

    def index(self, value: Column) -> Column:
        """Position of the value's bin; null outside."""
        if self.open:
            return F.when(value >= self.origin, F.floor((value - F.lit(self.origin)) / F.lit(self.width)))
        steps = [self.edges[i + 1] - self.edges[i] for i in range(len(self.edges) - 1)]
        inside = (value >= self.edges[0]) & (value < self.edges[-1])
        if max(steps) - min(steps) == 0:
            return F.when(inside, F.floor((value - F.lit(self.edges[0])) / F.lit(steps[0])))
        at = F.lit(-1)
        for e in self.edges[:-1]:
            at = at + F.when(value >= e, 1).otherwise(0)
        return F.when(inside, at.cast("long"))

    def left(self, index: Column) -> Column:
        if self.open:
            return F.lit(float(self.origin)) + index * F.lit(float(self.width))
        return F.element_at(F.array(*[F.lit(e) for e in self.edges]), (index + 1).cast("int"))

    def all(self, used: DataFrame, index: str = "bin") -> DataFrame:
        """Every bin of the range, from the ones used: 0..largest if open, else all."""
        last = F.max(index) if self.open else F.lit(len(self.edges) - 2)
        return used.agg(last.cast("long").alias("last")).where("last is not null").select(F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias(index))


def histogram(rows: DataFrame, value: Column, bins: Bins, weight: Column | None = None) -> DataFrame:
    """bin_left, count (or sum of weights) with empty bins inside the range as 0."""
    counts = rows.select(bins.index(value).alias("bin"), *([weight.alias("w")] if weight is not None else [])).where("bin is not null")
    counts = counts.groupBy("bin").agg((F.count(F.lit(1)) if weight is None else F.sum("w")).alias("count"))
    return bins.all(counts).join(counts, "bin", "left").select(bins.left(F.col("bin")).alias("bin_left"), F.coalesce("count", F.lit(0)).alias("count"))
