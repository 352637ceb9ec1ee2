"""Sliding windows and downsampling over an explicit order. Every operator returns a new table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col
from ..functions.signal import filtered
from ..model import ROW_ID, Metric, Result, Table, data_error, parameter_error
from ..plans.order import POSITION, shifted, with_position
from ..plans.registry import BOTH, NUMERIC, ORDERING, QUANTITATIVE, Constraint, Run, Slot, disjoint, operator

MODULE = "time_signal_processing"
PREVIEW = 20
#: Rows a block of a recursive filter covers, and samples (times the factor) after which its start is forgotten.
FILTER_BLOCK, FILTER_MEMORY = 200_000, 2000
_ORDER = Slot("order_column", ORDERING, BOTH, 0, 1)


def _row_order(result: Result, order: str | None) -> None:
    if order is None:
        result.warn("ROW_ORDER_USED", "no order column is given; the current row order is used")


def sliding_windows(df: DataFrame, value: str, order: str | None, size: int = 3, step: int = 1, horizon: int | None = 1, include_incomplete: bool = False) -> DataFrame:
    """Windows from every step-th position: lag_1 is the oldest value, the target lies ``horizon`` after the last (none: features only)."""
    kept = [col(value).cast("double").alias("__value"), ROW_ID] + ([col(order)] if order else [])
    placed = with_position(df.where(col(value).isNotNull()).select(*kept), order)
    total = placed.count()
    offsets = list(range(size)) + ([size - 1 + horizon] if horizon else [])
    wide = shifted(placed, ["__value"], offsets)
    if order:
        ends = shifted(placed.select(POSITION, col(order)), [order], [size - 1]) if size > 1 else placed.select(POSITION, col(order), col(order).alias(f"{order}__0"))
        last = placed.agg(F.max_by(col(order), POSITION)).first()[0]
        wide = wide.join(ends.select(POSITION, F.coalesce(col(f"{order}__{size - 1}"), F.lit(last)).alias("__order_end")), POSITION)
    needed = size if horizon is None else size + horizon
    chosen = (F.col(POSITION) % step == 0) & ((F.col(POSITION) + needed <= total) if horizon or not include_incomplete else F.lit(True))
    columns = [F.col(POSITION).alias("window_start"), F.least(F.col(POSITION) + size - 1, F.lit(total - 1)).alias("window_end")]
    columns += [F.col(f"__value__{k}").alias(f"{value}_lag_{k + 1}") for k in range(size)]
    if order:
        columns += [col(order).alias("order_start"), F.col("__order_end").alias("order_end")]
    if horizon:
        columns.append(F.col(f"__value__{size - 1 + horizon}").alias(f"{value}_target"))
    return wide.where(chosen).select(*columns)


@operator("time_series_window.sliding", MODULE, [Slot("value_column", NUMERIC, QUANTITATIVE, 1, 1), _ORDER], {
    "window_size": {"type": "integer", "minimum": 1, "maximum": 10000, "default": 3}, "step_size": {"type": "integer", "minimum": 1, "maximum": 10000, "default": 1},
    "output_mode": {"type": "string", "enum": ["supervised", "features"], "default": "supervised"}, "forecast_horizon": {"type": "integer", "minimum": 1, "maximum": 10000, "default": 1},
    "include_incomplete": {"type": "boolean", "default": False}, "flatten_output": {"type": "boolean", "enum": [True], "default": True}, "duplicate_order": {"type": "string", "enum": ["error", "first", "last", "keep"], "default": "error"},
}, constraints=(disjoint("value_column", "order_column"),), produces_data=True)
def sliding(run: Run) -> Result:
    """Lag features (and a target) of an ordered series; rows of equal order are refused, one of them is taken, or all are kept in row order."""
    value, order, p = run.column("value_column"), run.optional("order_column"), run.params
    df, result = run.df, Result(metadata={"output_mode": p["output_mode"]})
    if order and p["duplicate_order"] != "keep":
        n, d, nulls = df.agg(F.count(col(order)), F.count_distinct(col(order)), F.count(F.when(col(order).isNull(), 1))).first()
        if n != d or nulls > 1:
            if p["duplicate_order"] == "error":
                raise data_error("order values repeat", column=order)
            pick = F.min(ROW_ID) if p["duplicate_order"] == "first" else F.max(ROW_ID)
            df = df.join(df.groupBy(col(order)).agg(pick.alias(ROW_ID)).select(ROW_ID), ROW_ID, "left_semi")
    _row_order(result, order)
    rows, valid = df.agg(F.count(F.lit(1)), F.count(col(value))).first()
    if valid < rows:
        result.warn("MISSING_VALUES_DROPPED", "rows without a value were dropped", count=rows - valid)
    horizon = p["forecast_horizon"] if p["output_mode"] == "supervised" else None
    if valid < p["window_size"] + (horizon or 0):
        raise data_error("too few values for a window", count=valid)
    data = sliding_windows(df, value, order, p["window_size"], p["step_size"], horizon, p["include_incomplete"])
    result.data = data
    result.metrics = [Metric("window_count", data.count()), Metric("feature_count", len(data.columns))]
    result.tables = [Table("window_preview", data.orderBy("window_start"), limit=PREVIEW)]
    return result


def _downsampled(run: Run, data: DataFrame, order: str | None, sort_by: str) -> Result:
    result = Result(metadata={k: v for k, v in run.params.items()}, data=data.drop(POSITION))
    result.metrics = [Metric("rows_in", run.df.count()), Metric("rows_out", data.count())]
    result.tables = [Table("downsample_preview", data.orderBy(sort_by).drop(POSITION), limit=PREVIEW)]
    _row_order(result, order)
    return result


_VALUES = [Slot("value_columns", NUMERIC, QUANTITATIVE), _ORDER]
_APART = (disjoint("value_columns", "order_column"),)


def periodic_sample(df: DataFrame, order: str | None, factor: int, offset: int) -> DataFrame:
    """Rows at positions offset, offset + factor, ..., with all columns and their position."""
    return with_position(df, order).where((F.col(POSITION) >= offset) & ((F.col(POSITION) - offset) % factor == 0)).drop(ROW_ID)


@operator("data_downsampling.periodic_sample", MODULE, _VALUES, {"factor": {"type": "integer", "minimum": 2, "maximum": 10000, "default": 2}, "offset": {"type": "integer", "minimum": 0, "maximum": 9999, "default": 0}}, constraints=_APART, produces_data=True)
def periodic(run: Run) -> Result:
    """Every factor-th row."""
    if run.params["offset"] >= run.params["factor"]:
        raise parameter_error("offset must be below factor")
    order = run.optional("order_column")
    return _downsampled(run, periodic_sample(run.df, order, run.params["factor"], run.params["offset"]), order, POSITION)


def block_aggregate(df: DataFrame, values: list[str], order: str | None, factor: int, how: str = "mean", others: str = "drop") -> DataFrame:
    """Aggregates of blocks of ``factor`` positions; first and last skip missing values."""
    placed = with_position(df, order).withColumn("__block", F.floor(F.col(POSITION) / factor))

    def edge(c: str, which: str):
        value = F.struct(col(c).alias("v"))
        place = F.when(col(c).isNotNull(), F.col(POSITION))
        return (F.min_by if which == "first" else F.max_by)(value, place)["v"]

    make = {"mean": F.avg, "median": lambda v: F.percentile(v, 0.5), "min": F.min, "max": F.max, "sum": lambda v: F.coalesce(F.sum(v), F.lit(0.0))}
    aggs = [F.min(POSITION).alias(POSITION)]
    if order:
        aggs.append(edge(order, "first").alias(order))
    aggs += [(edge(c, how) if how in ("first", "last") else make[how](col(c).cast("double"))).alias(c) for c in values]
    rest = [c for c in df.columns if c not in {*values, order, ROW_ID}] if others != "drop" else []
    aggs += [edge(c, others).alias(c) for c in rest]
    return placed.groupBy("__block").agg(*aggs).drop("__block")


@operator("data_downsampling.block_aggregate", MODULE, _VALUES, {"factor": {"type": "integer", "minimum": 2, "maximum": 10000, "default": 2}, "aggregation": {"type": "string", "enum": ["first", "last", "mean", "median", "min", "max", "sum"], "default": "mean"}, "other_columns": {"type": "string", "enum": ["drop", "first", "last"], "default": "drop"}}, constraints=_APART, produces_data=True)
def blocks(run: Run) -> Result:
    """One aggregated row for each block of rows."""
    order = run.optional("order_column")
    return _downsampled(run, block_aggregate(run.df, run.columns("value_columns"), order, run.params["factor"], run.params["aggregation"], run.params["other_columns"]), order, POSITION)


def filtered_decimate(df: DataFrame, values: list[str], order: str, factor: int, kind: str = "iir", zero_phase: bool = True, block: int = FILTER_BLOCK) -> DataFrame:
    """Low-pass, then every factor-th row.

    The filters forget their past, so long series are filtered in blocks that
    overlap by their memory, each block in one Arrow call on some executor.
    """
    import pandas as pd

    placed = with_position(df.select(col(order), *(col(c).cast("double").alias(c) for c in values), ROW_ID), order).drop(ROW_ID)
    memory = FILTER_MEMORY * factor
    block = max(block, 2 * memory)
    block -= block % factor
    own = F.floor(F.col(POSITION) / block)
    reach = F.array_distinct(F.array(own, F.floor((F.col(POSITION) - memory) / block), F.floor((F.col(POSITION) + memory) / block)))
    spread = placed.withColumn("__block", F.explode(F.filter(reach, lambda b: b >= 0)))
    schema = T.StructType([T.StructField(POSITION, T.LongType()), df.schema[order], *(T.StructField(c, T.DoubleType()) for c in values)])

    def solve(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(POSITION, ignore_index=True)
        out = {c: filtered(part[c].to_numpy(float), factor, kind, zero_phase) for c in values}
        mine = (part[POSITION] // block == key[0]) & (part[POSITION] % factor == 0)
        return pd.DataFrame({POSITION: part[POSITION], order: part[order], **out})[mine]

    return spread.groupBy("__block").applyInPandas(solve, schema)


@operator("data_downsampling.filtered_decimate", MODULE, [Slot("value_columns", NUMERIC, QUANTITATIVE, allow_missing=False, finite_only=True), Slot("order_column", frozenset({"integer", "number", "datetime"}), BOTH, 1, 1, allow_missing=False)], {"factor": {"type": "integer", "minimum": 2, "maximum": 1000, "default": 2}, "filter_type": {"type": "string", "enum": ["iir", "fir"], "default": "iir"}, "zero_phase": {"type": "boolean", "default": True}}, constraints=(disjoint("value_columns", "order_column"), Constraint("equal_interval", ("order_column",))), produces_data=True)
def decimate(run: Run) -> Result:
    """Anti-aliased decimation of equally spaced series."""
    order = run.column("order_column")
    if run.df.limit(3).count() < 3:
        raise data_error("too few rows")
    data = filtered_decimate(run.df, run.columns("value_columns"), order, run.params["factor"], run.params["filter_type"], run.params["zero_phase"])
    return _downsampled(run, data, order, POSITION)
