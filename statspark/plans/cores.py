"""Aggregates that several operators build on: second moments, count grids and mid-ranks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col
from ..model import data_error

#: Terms of one aggregate; more are split over several to keep generated code small.
TERMS_PER_AGGREGATE = 400
#: Distinct levels of a grid side that may reach the driver.
GRID_LEVELS = 10_000


@dataclass
class Moments:
    """n, means and centred cross products of columns, by optional group."""

    n: float
    mean: np.ndarray
    cross: np.ndarray

    @property
    def covariance(self) -> np.ndarray:
        return self.cross / (self.n - 1)


def moments(df: DataFrame, columns: list[Column], by: Column | None = None) -> Moments | dict:
    """Second moments in two passes: means first, then products of centred values, each as flat sums.

    The centre is the overall mean, so that sums of groups can be added.
    """
    k = len(columns)
    named = df.select(*(c.cast("double").alias(f"x{i}") for i, c in enumerate(columns)), *([by.alias("g")] if by is not None else []))
    first = named.agg(F.count(F.lit(1)).alias("n"), *(F.avg(f"x{i}").alias(f"m{i}") for i in range(k))).first()
    if not first["n"]:
        raise data_error("no complete rows are left")
    centre = np.array([first[f"m{i}"] for i in range(k)], float)
    shifted = named.select(*((F.col(f"x{i}") - F.lit(float(centre[i]))).alias(f"x{i}") for i in range(k)), *(["g"] if by is not None else []))
    terms = [F.sum(f"x{i}").alias(f"s{i}") for i in range(k)] + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)]
    parts: dict = {}
    for start in range(0, len(terms), TERMS_PER_AGGREGATE):
        some = [F.count(F.lit(1)).alias("n"), *terms[start : start + TERMS_PER_AGGREGATE]]
        rows = (shifted.groupBy("g").agg(*some) if by is not None else shifted.agg(*some)).collect()
        for r in rows:
            parts.setdefault(r["g"] if by is not None else None, {}).update(r.asDict())
    out = {}
    for key, got in parts.items():
        sums = np.array([got[f"s{i}"] for i in range(k)], float)
        raw = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                raw[i, j] = raw[j, i] = got[f"p{i}_{j}"]
        out[key] = Moments(got["n"], centre + sums / got["n"], raw - np.outer(sums, sums) / got["n"])
    return out if by is not None else out[None]


def pooled(parts: list[Moments]) -> Moments:
    """Moments of the union of disjoint groups."""
    n = sum(p.n for p in parts)
    mean = sum(p.n * p.mean for p in parts) / n
    return Moments(n, mean, sum(p.cross + p.n * np.outer(p.mean - mean, p.mean - mean) for p in parts))


def grid_matrix(df: DataFrame, a: Column, b: Column, weight: Column | None = None) -> tuple[list, list, np.ndarray]:
    """The count grid on the driver, levels in ascending order; refused beyond ``GRID_LEVELS`` levels."""
    value = F.count(F.lit(1)).cast("double") if weight is None else F.sum(weight.cast("double"))
    cells = df.groupBy(a.alias("a"), b.alias("b")).agg(value.alias("n")).limit(GRID_LEVELS * 100 + 1).collect()
    rows, cols = (sorted({r[x] for r in cells}, key=lambda v: (v is None, v)) for x in ("a", "b"))
    if len(rows) > GRID_LEVELS or len(cols) > GRID_LEVELS or len(cells) > GRID_LEVELS * 100:
        raise data_error("too many levels for a count grid", rows=len(rows), columns=len(cols))
    place_a, place_b = ({v: i for i, v in enumerate(x)} for x in (rows, cols))
    out = np.zeros((len(rows), len(cols)))
    for r in cells:
        out[place_a[r["a"]], place_b[r["b"]]] = r["n"]
    return rows, cols, out


def chi_square(observed: np.ndarray) -> tuple[float, int, np.ndarray]:
    """Statistic of independence with continuity correction on one degree of freedom, and expected counts."""
    expected = np.outer(observed.sum(1), observed.sum(0)) / observed.sum()
    df = (observed.shape[0] - 1) * (observed.shape[1] - 1)
    if (expected == 0).any():
        raise data_error("a row or column of the table is empty")
    gap = np.abs(observed - expected)
    if df == 1:
        gap = gap - np.minimum(0.5, gap)
    return float((gap**2 / expected).sum()), df, expected


def mid_ranks(df: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` with average ranks (from 1) of a column, from the counts of its values.

    Counts are cumulated over ranges of distinct values: totals of the ranges
    first, then inside each, so no task sorts all values of a large frame.
    """
    counts = df.where(col(column).isNotNull()).groupBy(col(column).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    return df.join(ranked_counts(counts).select(F.col("__v").alias(column), F.col("__rank").alias(out)), column, "left")


def ranked_counts(counts: DataFrame, single_sort_rows: int = 500_000) -> DataFrame:
    """(__v, __n, __rank): mid-ranks of value counts."""
    upto = running_totals(counts, "__v", ["__n"], single_sort_rows=single_sort_rows)
    return upto.withColumn("__rank", F.col("__n__upto") - F.col("__n") + (F.col("__n") + 1) / 2).drop("__n__upto")


def running_totals(counts: DataFrame, key: str, columns: list[str], descending: bool = False, single_sort_rows: int = 500_000) -> DataFrame:
    """``counts`` with ``<c>__upto``: the sum of each column up to and with the row, in the order of the distinct keys."""
    order = F.desc(key) if descending else F.asc(key)
    if counts.limit(single_sort_rows + 1).count() <= single_sort_rows:
        spec = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return counts.withColumns({f"{c}__upto": F.sum(c).over(spec) for c in columns})
    from .storage import settled

    laid = settled(counts.repartitionByRange(order).sortWithinPartitions(order).withColumn("__part", F.spark_partition_id()))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = laid.groupBy("__part").agg(*(F.sum(c).alias(f"{c}__t") for c in columns))
    before = before.select("__part", *(F.coalesce(F.sum(f"{c}__t").over(earlier), F.lit(0)).alias(f"{c}__before") for c in columns))
    inside = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    placed = laid.withColumns({f"{c}__in": F.sum(c).over(inside) for c in columns}).join(F.broadcast(before), "__part")  # one row a partition
    return placed.withColumns({f"{c}__upto": F.col(f"{c}__before") + F.col(f"{c}__in") for c in columns}).drop("__part", *(f"{c}__{x}" for c in columns for x in ("in", "before")))
