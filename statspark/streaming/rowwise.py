"""Streams: plans fitted on a batch and applied row by row, and watermarked group summaries.

Bounds, edges and mappings are learned once on a bounded batch; applying them is a
projection, so it runs unchanged on ``readStream`` frames with no state.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, finite, normalised
from ..operators.bins import bin_code, bin_edges
from ..operators.prep import outlier_bounds


@dataclass(frozen=True)
class RowwisePlan:
    """A fitted, stateless transformation."""

    apply: Callable[[DataFrame], DataFrame]
    fitted: dict[str, Any]


def plan_encoding(batch: DataFrame, column: str, method: str = "equal_width", count: int = 5, target: str | None = None) -> RowwisePlan:
    """Bin codes by edges learned on a batch; values beyond the edges get no code."""
    edges, _ = bin_edges(normalised(batch), column, method, count)
    name = target or f"{column}_bin"

    def apply(stream: DataFrame) -> DataFrame:
        return stream.withColumn(name, bin_code(finite(col(column).cast("double")), edges).cast("long"))

    return RowwisePlan(apply, {"edges": edges})


def plan_outlier_bounds(batch: DataFrame, columns: list[str], method: str = "iqr", clip: bool = True, **params: Any) -> RowwisePlan:
    """Clip (or set to null) values outside bounds learned on a batch."""
    bounds = outlier_bounds(normalised(batch), columns, method, params)

    def apply(stream: DataFrame) -> DataFrame:
        changed = {}
        for c, (_, low, high) in bounds.items():
            v = col(c).cast("double")
            below, above = (F.lit(low), F.lit(high)) if clip else (F.lit(None).cast("double"),) * 2
            changed[c] = F.when(v < low, below).when(v > high, above).otherwise(v)
        return stream.withColumns(changed)

    return RowwisePlan(apply, {"bounds": {c: (low, high) for c, (_, low, high) in bounds.items()}})


def windowed_summary(stream: DataFrame, time: str, groups: list[str], values: list[str], window: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts, sums and means by event-time window and groups; rows later than the watermark are dropped by Spark."""
    spans = F.window(col(time), window, slide) if slide else F.window(col(time), window)
    aggs = [F.count(F.lit(1)).alias("count")]
    for v in values:
        aggs += [F.sum(col(v)).alias(f"{v}_sum"), F.avg(col(v)).alias(f"{v}_mean")]
    return stream.withWatermark(time, late).groupBy(spans.alias("window"), *(col(g) for g in groups)).agg(*aggs)
