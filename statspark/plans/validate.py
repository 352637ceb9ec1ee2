"""Request validation: metadata checks without a job, all data checks fused into one aggregate."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import normalised
from ..model import ROW_ID, Context, column_error, data_error
from .order import check_steps, with_row_id
from .registry import Operator, Run
from .schema import resolve


def type_of(kind: T.DataType) -> str:
    """Physical type of a Spark type in the catalogue's terms."""
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.IntegralType):
        return "integer"
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return "number"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "string" if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)) else "unknown"


def _agrees(stated: str, actual: str) -> bool:
    return stated == actual or {stated, actual} <= {"integer", "number"} or (stated, actual) == ("category", "string")


def _check_metadata(op: Operator, df: DataFrame, slots: dict[str, list[str]], context: Context) -> None:
    names = [c.lower() for c in df.columns]
    if len(set(names)) != len(names):
        raise column_error("column names must differ by more than case")
    known = {s.id for s in op.slots}
    if set(slots) - known:
        raise column_error("unknown slots", slots=sorted(set(slots) - known))
    actual = {f.name: type_of(f.dataType) for f in df.schema.fields}
    for slot in op.slots:
        chosen = slots.get(slot.id, [])
        if len(chosen) < slot.least or (slot.most is not None and len(chosen) > slot.most):
            raise column_error(f"slot {slot.id} has {len(chosen)} columns", slot=slot.id, least=slot.least, most=slot.most)
        if len(set(chosen)) != len(chosen):
            raise column_error(f"slot {slot.id} names a column twice", slot=slot.id)
        for c in chosen:
            if c not in actual:
                raise column_error("no such column", column=c)
            if c not in context.fields:
                raise column_error("column has no metadata", column=c)
            meta = context.fields[c]
            if not _agrees(meta.data_type, actual[c]):
                raise column_error("stated type differs from the data", column=c, stated=meta.data_type, actual=actual[c])
            if meta.data_type not in slot.types and not (meta.data_type == "integer" and "number" in slot.types):
                raise column_error("type does not fit the slot", column=c, slot=slot.id)
            if meta.analysis_type not in slot.labels:
                raise column_error("analysis label does not fit the slot", column=c, slot=slot.id)
    for rule in op.constraints:
        lists = [slots.get(s, []) for s in rule.slots]
        flat = [c for cols in lists for c in cols]
        if rule.kind == "slots_disjoint" and len(set(flat)) != len(flat):
            raise column_error("slots share a column", slots=list(rule.slots))
        if rule.kind == "total_min_items" and len(flat) < rule.value or rule.kind == "total_max_items" and len(flat) > rule.value:
            raise column_error("slots have too few or too many columns together", slots=list(rule.slots))
        if rule.kind == "requires_slot" and lists[0] and not all(lists[1:]):
            raise column_error("a slot needs another", slots=list(rule.slots))


def _data_checks(op: Operator, df: DataFrame, slots: dict[str, list[str]]) -> list[tuple[Any, Any]]:
    """Pairs of an aggregate and a function that gives the complaint for its value, or nothing."""
    checks: list[tuple[Any, Any]] = []
    kinds = {f.name: f.dataType for f in df.schema.fields}
    for slot in op.slots:
        for name in slots.get(slot.id, []):
            c = F.col(f"`{name}`")
            numeric = isinstance(kinds[name], T.NumericType)
            if not slot.allow_missing:
                checks.append((F.count(F.when(c.isNull(), 1)), lambda n, x=name: data_error("column has missing values", column=x) if n else None))
            if slot.finite_only and numeric:
                checks.append((F.count(F.when(F.abs(c.cast("double")) == float("inf"), 1)), lambda n, x=name: data_error("column has infinite values", column=x) if n else None))
            if slot.unique_values or slot.least_unique or slot.most_unique:
                checks.append((F.struct(F.count_distinct(c).alias("d"), F.count(c).alias("n")), lambda v, x=name, s=slot: _unique_complaint(v, x, s)))
            if numeric and (slot.minimum is not None or slot.maximum is not None):
                checks.append((F.struct(F.min(c.cast("double")).alias("a"), F.max(c.cast("double")).alias("b")), lambda v, x=name, s=slot: _range_complaint(v, x, s)))
    for rule in op.constraints:
        if rule.kind == "min_rows":
            checks.append((F.count(F.lit(1)), lambda n, r=rule: data_error("too few rows", rows=n, least=r.value) if n < r.value else None))
        if rule.kind == "exact_category_count":
            for name in (c for s in rule.slots for c in slots.get(s, [])):
                checks.append((F.count_distinct(F.col(f"`{name}`")), lambda n, x=name, r=rule: data_error("column must have an exact number of categories", column=x, found=n, wanted=r.value) if n != r.value else None))
    return checks


def _unique_complaint(v, name, slot):
    if slot.unique_values and v["d"] != v["n"]:
        return data_error("values must be unique", column=name)
    if slot.least_unique and v["d"] < slot.least_unique or slot.most_unique and v["d"] > slot.most_unique:
        return data_error("number of distinct values does not fit", column=name, found=v["d"])
    return None


def _range_complaint(v, name, slot):
    low = v["a"] is not None and slot.minimum is not None and v["a"] < slot.minimum
    high = v["b"] is not None and slot.maximum is not None and v["b"] > slot.maximum
    return data_error("values are out of range", column=name) if low or high else None


def prepare(op: Operator, df: DataFrame, slots: dict[str, list[str]], parameters: dict[str, Any], context: Context) -> Run:
    """Validate a request against its operator; the frame comes back with missing values as nulls and a row identity."""
    params = resolve(parameters, op.parameters, op.required)
    _check_metadata(op, df.drop(ROW_ID), slots, context)
    clean = with_row_id(normalised(df))
    checks = _data_checks(op, clean, slots)
    if checks:
        row = clean.agg(*(a.alias(f"c{i}") for i, (a, _) in enumerate(checks))).first()
        for i, (_, complaint) in enumerate(checks):
            if found := complaint(row[i]):
                raise found
    for rule in op.constraints:
        if rule.kind in ("time_order", "equal_interval"):
            for name in (c for s in rule.slots for c in slots.get(s, [])):
                check_steps(clean, name, rule.kind == "equal_interval")
    return Run(clean, slots, params, context)
