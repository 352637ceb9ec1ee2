"""Design columns: quantitative ones as they are, categorical ones as indicators of sorted levels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import all_present, canonical_text, col
from ..model import ROW_ID, data_error
from .registry import Run

MOST_LEVELS = 100


@dataclass
class Design:
    names: list[str]
    columns: list[Column]
    encoding: dict[str, dict]
    owner: list[str]


def complete(run: Run, columns: list[str]) -> tuple[DataFrame, int]:
    """Rows without a missing value in the columns, and how many were dropped."""
    kept = run.df.where(all_present(*columns))
    rows, n = run.df.agg(F.count(F.lit(1)), F.count(F.when(all_present(*columns), 1))).first()
    if not n:
        raise data_error("no complete rows are left")
    return kept, rows - n


def design(run: Run, df: DataFrame, columns: list[str], drop_first: bool = True) -> Design:
    """Levels of all categorical columns, and finiteness of the others, in one aggregate."""
    categorical = [c for c in columns if run.is_categorical(c)]
    text = {c: canonical_text(col(c), df.schema[c].dataType) for c in categorical}
    numeric = [c for c in columns if c not in text]
    aggs = [F.count(F.when(F.abs(col(c).cast("double")) == float("inf"), 1)).alias(f"i{k}") for k, c in enumerate(numeric)]
    levels: dict[str, list[str]] = {}
    for c in categorical:
        found = [r[0] for r in df.select(text[c].alias("v")).distinct().limit(MOST_LEVELS + 1).collect()]
        if len(found) > MOST_LEVELS:
            raise data_error("too many levels for indicators", column=c, most=MOST_LEVELS)
        levels[c] = sorted(found)
    if aggs:
        row = df.agg(*aggs).first()
        for k, c in enumerate(numeric):
            if row[f"i{k}"]:
                raise data_error("column has infinite values", column=c)
    out = Design([], [], {}, [])
    for c in columns:
        if c in text:
            kept = levels[c][1:] if drop_first else levels[c]
            out.encoding[c] = {"categories": levels[c], "reference": levels[c][0] if drop_first and levels[c] else None}
            for v in kept:
                out.names.append(f"{c}={v}")
                out.columns.append(F.when(text[c] == v, 1.0).otherwise(0.0))
                out.owner.append(c)
        else:
            out.names.append(c)
            out.columns.append(col(c).cast("double"))
            out.owner.append(c)
    if not out.names:
        raise data_error("no feature is left after encoding")
    return out


def feature_frame(df: DataFrame, made: Design, *extra: Column) -> DataFrame:
    return df.select(*(c.alias(f"f{i}") for i, c in enumerate(made.columns)), *extra, ROW_ID)
