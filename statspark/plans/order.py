"""Row identity and global positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col
from ..model import ROW_ID, data_error
from .storage import settled

#: Rows up to which one sorted partition numbers them all; beyond, ranges are numbered side by side.
SINGLE_SORT_ROWS = 500_000
POSITION = "__position"
_IN_PARTITION = (1 << 33) - 1


def with_row_id(df: DataFrame) -> DataFrame:
    """A row identity in the order of the partitions, unless the source already gave one."""
    return df if ROW_ID in df.columns else df.withColumn(ROW_ID, F.monotonically_increasing_id())


def order_keys(order: str | None) -> list[Column]:
    """Missing order values last, ties in row order."""
    return ([col(order).asc_nulls_last()] if order else []) + [F.col(ROW_ID).asc()]


def with_position(df: DataFrame, order: str | None, single_sort_rows: int = SINGLE_SORT_ROWS) -> DataFrame:
    """``df`` with its rank from 0 in the order, without a single-task sort for large frames."""
    keys = order_keys(order)
    if df.limit(single_sort_rows + 1).count() <= single_sort_rows:
        return df.withColumn(POSITION, (F.row_number().over(Window.orderBy(*keys)) - 1).cast("long"))
    laid = settled(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()))
    laid = laid.withColumn("__part", F.shiftrightunsigned("__at", 33))
    before = laid.groupBy("__part").agg(F.count("*").alias("n")).withColumn("__before", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    placed = laid.join(F.broadcast(before), "__part")  # one row a partition
    return placed.withColumn(POSITION, F.col("__before") + F.col("__at").bitwiseAND(F.lit(_IN_PARTITION))).drop("__at", "__part", "__before")


def shifted(df: DataFrame, columns: list[str], offsets: list[int], single_sort_rows: int = SINGLE_SORT_ROWS) -> DataFrame:
    """``<c>__<k>`` for each column and offset: the value k positions on, for frames with a position."""
    spec = Window.orderBy(POSITION)
    if df.limit(single_sort_rows + 1).count() <= single_sort_rows:
        return df.withColumns({f"{c}__{k}": F.lead(col(c), k).over(spec) for c in columns for k in offsets})
    # Blocks of positions, each carrying the rows its offsets reach, keep every window local.
    reach = max(offsets)
    block = max(100_000, 4 * reach)
    part = F.floor(F.col(POSITION) / block)
    own = df.withColumn("__block", part)
    ahead = df.where((F.col(POSITION) % block < reach) & (F.col(POSITION) >= block)).withColumn("__block", part - 1)
    both = own.withColumn("__own", F.lit(True)).unionByName(ahead.withColumn("__own", F.lit(False)))
    local = Window.partitionBy("__block").orderBy(POSITION)
    return both.withColumns({f"{c}__{k}": F.lead(col(c), k).over(local) for c in columns for k in offsets}).where("__own").drop("__own", "__block")


def check_steps(df: DataFrame, order: str, equal: bool, least_rows: int = 2) -> None:
    """Order values must rise from row to row of their order, by equal steps if so wanted; one aggregate over differences."""
    kind = df.schema[order].dataType
    number = col(order).cast("double") if isinstance(kind, T.NumericType) else F.unix_micros(col(order).cast("timestamp")).cast("double")
    placed = shifted(with_position(df.select(col(order), number.alias("__t"), ROW_ID), order), ["__t"], [1])
    step = F.col("__t__1") - F.col("__t")
    n, low, high = placed.agg(F.count(F.lit(1)), F.min(step), F.max(step)).first()
    if n < least_rows:
        raise data_error("too few rows", count=n)
    if low is None or low <= 0:
        raise data_error("order values do not rise", column=order)
    if equal and high != low:
        raise data_error("order values are not equally spaced", column=order)
