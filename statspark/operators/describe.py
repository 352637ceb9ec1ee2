"""Overview, frequencies, crosstabs, descriptive statistics, group summaries and normality."""

from __future__ import annotations

import math
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import special
from ..functions.columns import canonical_text, col, finite
from ..model import ROW_ID, Chart, Metric, Result, Table, data_error, parameter_error
from ..plans.cores import chi_square, grid_matrix
from ..plans.order import POSITION, with_position
from ..plans.quantiles import exact_quantiles
from ..plans.registry import ANY, BOTH, CATEGORICAL, DISCRETE, NUMERIC, QUANTITATIVE, Constraint, Run, Slot, disjoint, operator
from .bins import bin_code, bin_edges, bin_labels

MODULE = "descriptive_analysis"
_X = [Slot("x_columns", NUMERIC, QUANTITATIVE)]


@operator("data_overview.basic", MODULE, [Slot("columns", ANY, BOTH)], {"preview_rows": {"type": "integer", "default": 10, "minimum": 1, "maximum": 100}, "include_missing": {"type": "boolean", "default": True}, "include_unique": {"type": "boolean", "default": True}, "include_duplicates": {"type": "boolean", "default": True}})
def overview(run: Run) -> Result:
    """Types, counts and extremes of all columns in one aggregate."""
    columns = run.columns("columns")
    kinds = {f.name: f.dataType for f in run.df.schema.fields}
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        aggs.append(F.count(col(c)).alias(f"n{i}"))
        if run.params["include_unique"]:
            aggs.append(F.count_distinct(col(c)).alias(f"d{i}"))
        if isinstance(kinds[c], T.NumericType):
            aggs += [F.min(col(c)).alias(f"a{i}"), F.max(col(c)).alias(f"b{i}")]
    row = run.df.agg(*aggs).first()
    total = row["rows"]
    result = Result()
    fields = []
    for i, c in enumerate(columns):
        missing = total - row[f"n{i}"]
        rate = missing / total if total else 0.0
        entry: dict[str, Any] = {"field": c, "data_type": run.meta(c).data_type, "analysis_type": run.meta(c).analysis_type, "valid_count": row[f"n{i}"]}
        if run.params["include_missing"]:
            entry |= {"missing_count": missing, "missing_rate": rate}
        if run.params["include_unique"]:
            entry["unique_count"] = row[f"d{i}"]
        numeric = isinstance(kinds[c], T.NumericType)
        fields.append(entry | {"minimum": row[f"a{i}"] if numeric else None, "maximum": row[f"b{i}"] if numeric else None})
        if rate >= 0.5 and total:
            result.warn("HIGH_MISSING_RATE", "half of the values or more are missing", column=c, rate=rate)
    result.metrics = [Metric("row_count", total), Metric("column_count", len(run.user_columns)), Metric("selected_column_count", len(columns))]
    if run.params["include_duplicates"]:
        distinct = run.df.select(*(col(c) for c in columns)).distinct().count()
        result.metrics.append(Metric("duplicate_row_count", total - distinct))
    preview = run.df.orderBy(ROW_ID).select(*(col(c) for c in columns)).limit(run.params["preview_rows"])
    result.tables = [Table("field_overview", fields), Table("data_preview", preview)]
    if not total:
        result.warn("EMPTY_DATA", "the table has no rows")
    return result


def _shares(counts: DataFrame, total: Column | float, order: list[Column]) -> DataFrame:
    spec = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    share = F.col("frequency") / total
    return counts.withColumns({"percentage": share, "cumulative_frequency": F.sum("frequency").over(spec), "cumulative_percentage": F.sum("frequency").over(spec) / total})


def exact_frequency(df: DataFrame, column: str, include_missing: bool = False, sort_by: str = "count_desc", top_n: int = 0, missing_label: str = "(missing)") -> DataFrame:
    """(value, frequency, percentage, cumulative_*); a cut to top_n keeps the full denominator."""
    kind = df.schema[column].dataType
    source = df if include_missing else df.where(col(column).isNotNull())
    counts = source.groupBy(col(column).alias("__v")).agg(F.count(F.lit(1)).alias("frequency"))
    total = counts.agg(F.sum("frequency")).first()[0] or 0
    order = ([F.desc("frequency")] if sort_by == "count_desc" else []) + [F.col("__v").asc_nulls_last()]
    if top_n:
        counts = counts.orderBy(*order).limit(top_n)
    shared = _shares(counts, F.lit(float(total)), order)
    return shared.orderBy(*order).select(F.coalesce(canonical_text(F.col("__v"), kind), F.lit(missing_label)).alias("value"), "frequency", "percentage", "cumulative_frequency", "cumulative_percentage")


@operator("frequency_analysis.exact", MODULE, [Slot("columns", ANY, BOTH)], {"include_missing": {"type": "boolean", "default": False}, "sort_by": {"type": "string", "enum": ["count_desc", "value_asc"], "default": "count_desc"}, "top_n": {"type": "integer", "minimum": 0, "maximum": 10000, "default": 0}})
def frequency_exact(run: Run) -> Result:
    """Counts and cumulative shares of values."""
    result = Result([Metric("field_count", len(run.columns("columns")))])
    for i, c in enumerate(run.columns("columns")):
        table = exact_frequency(run.df, c, run.params["include_missing"], run.params["sort_by"], run.params["top_n"])
        result.tables.append(Table(f"frequency_{i + 1}", table.withColumn("field", F.lit(c)).select("field", *table.columns)))
        if not run.is_categorical(c):
            n, d = run.df.agg(F.count(col(c)), F.count_distinct(col(c))).first()
            if n and d / n > 0.5:
                result.warn("HIGH_CARDINALITY_EXACT_FREQUENCY", "most values are distinct; bins may say more", column=c)
    return result


def binned_frequency(df: DataFrame, column: str, method: str = "equal_width", count: int = 10, custom: list[float] | None = None, include_missing: bool = False) -> tuple[DataFrame, bool]:
    """Frequencies of bins, empty ones included unless missing values count too; and whether edges were joined."""
    joined = False
    if method == "custom":
        edges = [float(e) for e in custom or []]
        if len(edges) < 2 or any(a >= b for a, b in zip(edges, edges[1:], strict=False)):
            raise parameter_error("edges must rise and be two at least")
    else:
        edges, joined = bin_edges(df, column, method, count)
        if len(edges) < 2:
            raise data_error("too few distinct values for bins", column=column)
    code = bin_code(col(column).cast("double"), edges)
    counts = {r["b"]: r["n"] for r in df.where(F.lit(True) if include_missing else col(column).isNotNull()).groupBy(code.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    rows, running = [], 0
    for i, label in enumerate(bin_labels(edges)):
        n = counts.get(i + 1, 0)
        if include_missing and not n:
            continue
        running += n
        rows.append((i + 1, label, edges[i], edges[i + 1], n, n / total if total else None, running, running / total if total else None))
    if counts.get(None):
        running += counts[None]
        rows.append((None, None, None, None, counts[None], counts[None] / total, running, running / total))
    schema = "bin int, interval string, lower double, upper double, frequency long, percentage double, cumulative_frequency long, cumulative_percentage double"
    return df.sparkSession.createDataFrame(rows, schema), joined


@operator("frequency_analysis.binned", MODULE, [Slot("columns", NUMERIC, QUANTITATIVE)], {"include_missing": {"type": "boolean", "default": False}, "bin_method": {"type": "string", "enum": ["equal_width", "equal_frequency", "custom"], "default": "equal_width"}, "bin_count": {"type": "integer", "minimum": 2, "maximum": 100, "default": 10}, "custom_edges": {"type": "array", "items": {"type": "number"}, "default": []}})
def frequency_binned(run: Run) -> Result:
    """Counts and cumulative shares of right-closed bins."""
    result = Result([Metric("field_count", len(run.columns("columns")))])
    for i, c in enumerate(run.columns("columns")):
        table, joined = binned_frequency(run.df, c, run.params["bin_method"], run.params["bin_count"], run.params["custom_edges"], run.params["include_missing"])
        result.tables.append(Table(f"binned_frequency_{i + 1}", table.withColumn("field", F.lit(c)).select("field", *table.columns)))
        if joined:
            result.warn("DUPLICATE_BIN_EDGES", "equal quantiles were joined", column=c)
    return result


def crosstab(df: DataFrame, group: str, x: Column, normalize: str = "none", include_missing: bool = False) -> tuple[list[dict[str, Any]], np.ndarray]:
    """Long crosstab with row and column shares, and the grid."""
    g = canonical_text(col(group), df.schema[group].dataType)
    x = x.cast("string")
    source = df
    if include_missing:
        g, x = F.coalesce(g, F.lit("(missing)")), F.coalesce(x, F.lit("(missing)"))
    else:
        source = df.where(g.isNotNull() & x.isNotNull())
    rows, cols, grid = grid_matrix(source, g, x)
    if grid.size == 0:
        raise data_error("no rows to count")
    row_sums, col_sums, total = grid.sum(1), grid.sum(0), grid.sum()
    base = {"index": row_sums[:, None], "columns": col_sums[None, :], "all": total}.get(normalize)
    out = []
    for i, a in enumerate(rows):
        for j, b in enumerate(cols):
            n = grid[i, j]
            entry = {"group": a, "x": b, "frequency": int(n), "row_percentage": n / row_sums[i], "column_percentage": n / col_sums[j]}
            if base is not None:
                entry["normalized_value"] = float((grid / base)[i, j])
            out.append(entry)
    return out, grid


@operator("contingency_analysis.crosstab", MODULE, [Slot("group_column", DISCRETE, CATEGORICAL, 1, 1), Slot("x_columns", DISCRETE, BOTH)], {"include_missing": {"type": "boolean", "default": False}, "include_chi_square": {"type": "boolean", "default": True}, "normalize": {"type": "string", "enum": ["none", "index", "columns", "all"], "default": "none"}, "binning": {"type": "object", "default": {}, "additionalProperties": {"type": "object", "properties": {"bin_count": {"type": "integer", "minimum": 2, "maximum": 100}}, "required": ["bin_count"], "additionalProperties": False}}}, constraints=(disjoint("group_column", "x_columns"),))
def contingency(run: Run) -> Result:
    """Crosstabs of a group with each column, and the chi-square test of independence."""
    result = Result()
    group = run.column("group_column")
    for i, c in enumerate(run.columns("x_columns")):
        if run.is_categorical(c):
            x = canonical_text(col(c), run.df.schema[c].dataType)
        else:
            if c not in run.params["binning"]:
                raise parameter_error("a quantitative column needs bins", column=c)
            edges, _ = bin_edges(run.df, c, "equal_width", run.params["binning"][c]["bin_count"])
            x = F.element_at(F.array(*(F.lit(v) for v in bin_labels(edges, False))), bin_code(col(c).cast("double"), edges))
        rows, grid = crosstab(run.df, group, x, run.params["normalize"], run.params["include_missing"])
        if grid.shape[0] < 2 or grid.shape[1] < 2:
            raise data_error("a crosstab needs two rows and two columns", column=c)
        result.tables.append(Table(f"contingency_{i + 1}", rows))
        if run.params["include_chi_square"]:
            statistic, df, expected = chi_square(grid)
            result.metrics += [Metric(f"chi_square_{i + 1}", statistic), Metric(f"p_value_{i + 1}", special.chi2_sf(statistic, df))]
            if (expected < 5).any():
                result.warn("LOW_EXPECTED_FREQUENCY", "some expected counts are below 5", column=c, degrees_of_freedom=df)
    return result


STATISTICS = ["count", "missing", "mean", "std", "variance", "min", "q1", "median", "q3", "max", "range", "iqr", "skewness", "kurtosis", "coefficient_of_variation", "standard_error"]
_DEFAULT_STATISTICS = ["count", "missing", "mean", "std", "min", "q1", "median", "q3", "max", "skewness", "kurtosis"]


def _rounded(value: float | None, digits: int) -> float | None:
    return None if value is None or (isinstance(value, float) and not math.isfinite(value)) else round(value, digits) if isinstance(value, float) else value


def describe(df: DataFrame, columns: list[str], statistics: list[str], digits: int) -> tuple[list[dict[str, Any]], list[dict[str, float]]]:
    """Statistics of finite values, all columns in one aggregate (and exact quantiles); infinite values count as missing."""
    need_quantiles = bool({"q1", "median", "q3", "iqr"} & set(statistics))
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        v = finite(col(c).cast("double"))
        aggs += [f(v).alias(f"{n}{i}") for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp), ("low", F.min), ("high", F.max), ("g1", F.skewness), ("g2", F.kurtosis))]
    row = df.agg(*aggs).first()
    quartiles = exact_quantiles(df, [finite(col(c).cast("double")) for c in columns], [0.25, 0.5, 0.75]) if need_quantiles else [None] * len(columns)
    out, raw = [], []
    for i, c in enumerate(columns):
        n, mean, var, low, high = (row[f"{k}{i}"] for k in ("n", "mean", "var", "low", "high"))
        sd = math.sqrt(var) if n > 1 and var is not None else None
        q1, q2, q3 = quartiles[i] or (None, None, None)
        constant = n > 0 and low == high
        whole = {
            "count": n, "missing": row["rows"] - n, "mean": mean, "std": sd, "variance": var if n > 1 else None, "min": low, "q1": q1, "median": q2, "q3": q3, "max": high,
            "range": None if low is None else high - low, "iqr": None if q1 is None else q3 - q1,
            "skewness": 0.0 if constant and n >= 3 else special.corrected_skewness(row[f"g1{i}"], n), "kurtosis": 0.0 if constant and n >= 4 else special.corrected_kurtosis(row[f"g2{i}"], n),
            "coefficient_of_variation": sd / mean if sd is not None and mean else None, "standard_error": sd / math.sqrt(n) if sd is not None else None,
        }
        raw.append(whole)
        out.append({"field": c} | {s: _rounded(whole[s], digits) for s in statistics})
    return out, raw


def histograms(df: DataFrame, specs: list[tuple[str, float, float, int, float | None]]) -> list[dict[str, Any]]:
    """Histograms of (column, low, high, count, iqr), all columns in one grouped count.

    The number of bins is the larger of Sturges' and Freedman and Diaconis'.
    """
    cells, sizes = [], []
    for k, (column, low, high, n, iqr) in enumerate(specs):
        span = high - low
        width = span / (math.log2(n) + 1)
        if iqr:
            width = min(width, 2 * iqr / n ** (1 / 3))
        bins = min(10_000, max(1, math.ceil(span / width))) if span > 0 else 1
        v = finite(col(column).cast("double"))
        place = F.least(F.floor((v - low) / span * bins), F.lit(bins - 1)) if span > 0 else F.when(v.isNotNull(), 0)
        cells.append(F.struct(F.lit(k).alias("k"), place.cast("long").alias("b")))
        sizes.append(bins)
    if not cells:
        return []
    counts = {(r["k"], r["b"]): r["n"] for r in df.select(F.inline(F.array(*cells))).where("b is not null").groupBy("k", "b").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = []
    for k, (_, low, high, _, _) in enumerate(specs):
        edges = [low + (high - low) * i / sizes[k] for i in range(sizes[k] + 1)] if high > low else [low - 0.5, low + 0.5]
        out.append({"edges": edges, "counts": [counts.get((k, i), 0) for i in range(sizes[k])]})
    return out


@operator("descriptive_statistics.basic", MODULE, _X, {"statistics": {"type": "array", "items": {"type": "string", "enum": STATISTICS}, "uniqueItems": True, "default": _DEFAULT_STATISTICS}, "round_digits": {"type": "integer", "minimum": 0, "maximum": 12, "default": 4}})
def descriptive(run: Run) -> Result:
    """The usual statistics of numeric columns, with a histogram and box for each."""
    columns, wanted = run.columns("x_columns"), run.params["statistics"]
    rows, raw = describe(run.df, columns, list(dict.fromkeys([*wanted, "q1", "median", "q3"])), run.params["round_digits"])
    result = Result([Metric("field_count", len(columns))], [Table("descriptive_statistics", [{k: r[k] for k in ("field", *wanted)} for r in rows])])
    drawn = [(i, c, r) for i, (c, r) in enumerate(zip(columns, raw, strict=True)) if r["count"]]
    shapes = histograms(run.df, [(c, r["min"], r["max"], r["count"], r["iqr"]) for _, c, r in drawn])
    for (i, c, r), shape in zip(drawn, shapes, strict=True):
        if r["min"] == r["max"]:
            result.warn("CONSTANT_COLUMN", "all values are equal", column=c)
        result.charts.append(Chart(f"distribution_{i + 1}", "histogram_boxplot", shape | {"box": [r["min"], r["q1"], r["median"], r["q3"], r["max"]]}, {"field": c}))
    return result


AGGREGATIONS = ["max", "min", "sum", "std", "mean", "median", "count"]


def group_summary(df: DataFrame, groups: list[str], values: list[str], aggregations: list[str], drop_missing: bool = True, digits: int = 4) -> DataFrame:
    """One partial and one final aggregate, sorted by the groups."""
    source = df.dropna(subset=groups) if drop_missing else df
    keyed = source.groupBy(*(col(g) for g in groups))
    if not values:
        return keyed.agg(F.count(F.lit(1)).alias("count")).orderBy(*(col(g) for g in groups))
    make = {
        "max": F.max, "min": F.min, "sum": lambda v: F.coalesce(F.sum(v), F.lit(0.0)), "std": F.stddev_samp, "mean": F.avg, "median": F.median, "count": F.count,
    }
    aggs = []
    for v in values:
        for a in aggregations:
            e = make[a](col(v).cast("double"))
            aggs.append((e if a == "count" else F.bround(e, digits)).alias(f"{v}_{a}"))
    return keyed.agg(*aggs).orderBy(*(col(g) for g in groups))


@operator("group_summary.aggregate", MODULE, [Slot("group_columns", DISCRETE, CATEGORICAL), Slot("value_columns", NUMERIC, QUANTITATIVE, 0)], {"aggregations": {"type": "array", "items": {"type": "string", "enum": AGGREGATIONS}, "minItems": 1, "uniqueItems": True, "default": ["count"]}, "drop_missing_groups": {"type": "boolean", "default": True}, "round_digits": {"type": "integer", "minimum": 0, "maximum": 12, "default": 4}}, constraints=(disjoint("group_columns", "value_columns"),))
def summarise(run: Run) -> Result:
    """Aggregates of value columns by groups."""
    values, wanted = run.columns("value_columns"), run.params["aggregations"]
    if not values and wanted != ["count"]:
        raise parameter_error("without value columns only count can be given")
    table = group_summary(run.df, run.columns("group_columns"), values, wanted, run.params["drop_missing_groups"], run.params["round_digits"])
    return Result([Metric("group_count", table.count())], [Table("group_summary", table)])


#: Values of one column up to which the driver takes Shapiro-Wilk's order statistics; beyond, sums over ranks are taken side by side.
SHAPIRO_ROWS = 50_000


def anderson_statistic(df: DataFrame, column: str, n: int, mean: float, sd: float) -> float:
    """-n - 1/n sum (2i - 1)(log F(x_i) + log(1 - F(x_(n+1-i)))), as one sum over positions."""
    v = finite(col(column).cast("double"))
    placed = with_position(df.where(v.isNotNull()).select(v.alias("v"), ROW_ID), "v")
    z = (F.col("v") - F.lit(mean)) / F.lit(sd)
    i = F.col("__position") + 1
    # erf by the standard library is not in Spark, so log CDFs of distinct values go through a small Arrow function.

    @F.pandas_udf("double")
    def log_cdf(x: pd.Series) -> pd.Series:
        return x.map(lambda u: math.log(max(special.norm_cdf(u), 1e-300)))

    total = placed.agg(F.sum((2 * i - 1) * log_cdf(z) + (2 * (n - i) + 1) * log_cdf(-z))).first()[0]
    return -n - total / n


def shapiro_statistic(df: DataFrame, column: str, n: int, mean: float) -> tuple[float, float]:
    """W and p from sums over the ranked values: a normal score depends on the rank alone, so no task and no driver holds the sample."""
    v = finite(col(column).cast("double"))
    placed = with_position(df.where(v.isNotNull()).select(v.alias("v"), ROW_ID), "v")

    @F.pandas_udf("double")
    def score(at: pd.Series) -> pd.Series:
        return ((at + 0.625) / (n + 0.25)).map(special.norm_ppf)

    def value(at: int) -> Column:
        return F.max(F.when(F.col(POSITION) == at, F.col("v")))

    gap = F.col("v") - F.lit(mean)
    scored = placed.select(POSITION, "v", score(POSITION).alias("m"))
    got = scored.agg(F.sum(F.col("m") * F.col("m")), F.sum(F.col("m") * gap), value(n - 1) - value(0), value(n - 2) - value(1), F.sum(gap * gap)).first()
    return special.shapiro_from_sums(n, *got)


def normality_row(df: DataFrame, column: str, method: str, alpha: float) -> dict[str, Any]:
    v = finite(col(column).cast("double"))
    got = df.agg(F.count(v).alias("n"), F.min(v).alias("a"), F.max(v).alias("b"), F.avg(v).alias("m"), F.stddev_samp(v).alias("s"), F.skewness(v).alias("g1"), F.kurtosis(v).alias("g2")).first()
    n = got["n"]
    if not n or got["a"] == got["b"]:
        raise data_error("column is constant or empty", column=column)
    actual, reason = method, "requested"
    if method == "auto":
        actual = "shapiro" if n < 5000 else "dagostino"
        reason = "fewer than 5000 values" if n < 5000 else "5000 values or more"
    critical = None
    if actual == "shapiro":
        if n < 3:
            raise data_error("too few values", column=column, count=n)
        if n > SHAPIRO_ROWS:
            statistic, p = shapiro_statistic(df, column, n, got["m"])
        else:
            sample = np.array([r[0] for r in df.where(v.isNotNull()).select(v).collect()])
            statistic, p = special.shapiro(sample)
    elif actual == "dagostino":
        if n < 8:
            raise data_error("too few values", column=column, count=n)
        statistic, p = special.dagostino(got["g1"], got["g2"], n)
    else:
        statistic = anderson_statistic(df, column, n, got["m"], got["s"])
        p, critical = special.anderson_p(statistic, n), special.anderson_critical(n)
    return {"field": column, "method": actual, "sample_count": n, "statistic": statistic, "p_value": p, "alpha": alpha, "critical_values": critical, "conclusion": "reject" if p < alpha else "not rejected", "selection_reason": reason}


def _normality(run: Run, method: str) -> Result:
    rows = [normality_row(run.df, c, method, run.params["alpha"]) for c in run.columns("x_columns")]
    result = Result([Metric("field_count", len(rows))], [Table("normality_test", rows)])
    for r in rows:
        if r["method"] == "shapiro" and r["sample_count"] > 5000:
            result.warn("SHAPIRO_LARGE_SAMPLE", "p values are approximate beyond 5000 values", column=r["field"])
    return result


_ALPHA = {"alpha": {"type": "number", "exclusiveMinimum": 0, "exclusiveMaximum": 1, "default": 0.05}}
for _method in ("auto", "shapiro", "dagostino", "anderson"):
    _params = {"alpha": {"type": "number", "enum": list(special.ANDERSON_LEVELS), "default": 0.05}} if _method == "anderson" else _ALPHA
    operator(f"normality_test.{_method}", MODULE, _X, _params, constraints=(Constraint("min_rows", value=8),) if _method == "dagostino" else ())(lambda run, m=_method: _normality(run, m))
