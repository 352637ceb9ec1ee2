"""Bin edges and codes: right-closed bins, the lowest edge included."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, finite
from ..model import data_error
from ..plans.quantiles import exact_quantiles


def equal_width_edges(low: float, high: float, count: int) -> list[float]:
    """count bins between the extremes; the lowest edge is moved out by a thousandth of the range."""
    if low == high:
        spread = 0.001 * abs(low) if low else 0.001
        low, high = low - spread, high + spread
        return [low + (high - low) * i / count for i in range(count + 1)]
    edges = [low + (high - low) * i / count for i in range(count + 1)]
    edges[-1] = high
    edges[0] = low - (high - low) * 0.001
    return edges


def bin_edges(df: DataFrame, column: str, method: str, count: int) -> tuple[list[float], bool]:
    """Edges of a column, and whether equal quantiles were joined."""
    value = finite(col(column).cast("double"))
    if method == "equal_width":
        row = df.agg(F.min(value).alias("low"), F.max(value).alias("high")).first()
        if row["low"] is None:
            raise data_error("column has no finite values", column=column)
        return equal_width_edges(row["low"], row["high"], count), False
    found = exact_quantiles(df, [value], [i / count for i in range(count + 1)])[0]
    if found is None:
        raise data_error("column has no finite values", column=column)
    edges = sorted(set(found))
    return edges, len(edges) < count + 1


def bin_code(value: Column, edges: list[float], lowest_included: bool = True) -> Column:
    """1-based bin of a value, null outside the edges."""
    above = reduce(lambda a, b: a + b, [(value > F.lit(e)).cast("int") for e in edges[1:-1]], F.lit(0))
    low = value >= F.lit(edges[0]) if lowest_included else value > F.lit(edges[0])
    return F.when(low & (value <= F.lit(edges[-1])), above + 1)


def bin_labels(edges: list[float], lowest_included: bool = True) -> list[str]:
    text = [f"{e:.6g}" for e in edges]
    if len(set(text)) < len(text):
        text = [repr(e) for e in edges]
    first = "[" if lowest_included else "("
    return [f"{first if i == 0 else '('}{text[i]}, {text[i + 1]}]" for i in range(len(edges) - 1)]
