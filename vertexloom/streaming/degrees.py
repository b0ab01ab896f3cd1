"""Degree counts over a stream of edges (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def degree_stream(edges: DataFrame, kind: str = "total", window: str | None = None, watermark: str = "1 hour", time: str = "ts") -> DataFrame:
    """Running degrees of a streaming (src, dst[, ts]); by time windows that late edges may join until the watermark, if ``window`` is given."""
    ends = {"in": ["dst"], "out": ["src"], "total": ["src", "dst"]}[kind]
    keep = [time] if window else []
    rows = edges.select(*keep, F.explode(F.array(*ends)).alias("id"))
    if window is None:
        return rows.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return rows.withWatermark(time, watermark).groupBy(F.window(time, window), "id").agg(F.count(F.lit(1)).alias("degree"))
