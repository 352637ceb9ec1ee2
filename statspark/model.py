"""Requests, results and errors. Result tables stay lazy DataFrames until a sink asks for rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from pyspark.sql import DataFrame

ROW_ID = "__row_id"


class ErrorCode(str, Enum):
    PARAMETER_ERROR = "PARAMETER_ERROR"
    COLUMN_ERROR = "COLUMN_ERROR"
    DATA_ERROR = "DATA_ERROR"
    DEPENDENCY_ERROR = "DEPENDENCY_ERROR"
    EXECUTION_ERROR = "EXECUTION_ERROR"
    TIMEOUT_ERROR = "TIMEOUT_ERROR"
    CANCELLED = "CANCELLED"
    INTERNAL_ERROR = "INTERNAL_ERROR"


class OperatorError(Exception):
    """An error a caller can act on; its payload holds no stack and no local path."""

    def __init__(self, code: ErrorCode, message: str, **details: Any) -> None:
        super().__init__(message)
        self.code, self.message, self.details = code, message, details

    def payload(self) -> dict[str, Any]:
        return {"code": self.code.value, "message": self.message, "details": strict_json(self.details)}


def data_error(message: str, **details: Any) -> OperatorError:
    return OperatorError(ErrorCode.DATA_ERROR, message, **details)


def column_error(message: str, **details: Any) -> OperatorError:
    return OperatorError(ErrorCode.COLUMN_ERROR, message, **details)


def parameter_error(message: str, **details: Any) -> OperatorError:
    return OperatorError(ErrorCode.PARAMETER_ERROR, message, **details)


@dataclass
class FieldMeta:
    """What a caller states about a column: physical type, analysis label, measurement level."""

    data_type: str
    analysis_type: str = "unknown"
    measurement_level: str | None = None
    semantic_role: str | None = None
    category_order: list[Any] = field(default_factory=list)
    display_name: str | None = None
    value_labels: dict[str, str] = field(default_factory=dict)
    unit: str | None = None
    description: str | None = None

    def __post_init__(self) -> None:
        if self.analysis_type == "quantitative" and self.measurement_level not in (None, "scale"):
            raise column_error("a quantitative field has the level scale or none")
        if self.analysis_type == "categorical" and self.measurement_level == "scale":
            raise column_error("a categorical field cannot have the level scale")


@dataclass
class Context:
    run_id: str = "run"
    step_id: str | None = None
    locale: str = "en"
    random_seed: int = 42
    protocol_version: str = "1.0"
    fields: dict[str, FieldMeta] = field(default_factory=dict)


@dataclass
class Request:
    operation_key: str
    slots: dict[str, list[str]]
    parameters: dict[str, Any] = field(default_factory=dict)
    context: Context = field(default_factory=Context)

    @classmethod
    def from_dict(cls, raw: dict[str, Any]) -> Request:
        """Parse a JSON request; unknown names are refused."""
        extra = set(raw) - {"operation_key", "slots", "parameters", "context"}
        if extra or "operation_key" not in raw or not isinstance(raw.get("slots"), dict):
            raise parameter_error("request is malformed", unknown=sorted(extra))
        context = dict(raw.get("context") or {})
        metas = context.pop("field_metadata", {})
        known = {"run_id", "step_id", "locale", "random_seed", "protocol_version"}
        ignored = {"field_metadata_revision"}
        if set(context) - known - ignored:
            raise parameter_error("context has unknown names", unknown=sorted(set(context) - known - ignored))
        accepted = set(FieldMeta.__dataclass_fields__)
        fields = {c: FieldMeta(**{k: v for k, v in m.items() if k in accepted}) for c, m in metas.items()}
        return cls(raw["operation_key"], {k: list(v) for k, v in raw["slots"].items()}, dict(raw.get("parameters") or {}), Context(**{k: v for k, v in context.items() if k in known}, fields=fields))


@dataclass
class Metric:
    id: str
    value: Any
    unit: str | None = None


@dataclass
class Warning_:
    code: str
    message: str
    details: dict[str, Any] = field(default_factory=dict)


@dataclass
class Table:
    """A result table: a lazy DataFrame, or rows already on the driver."""

    id: str
    source: DataFrame | list[dict[str, Any]]
    columns: list[str] | None = None
    limit: int | None = None

    def rows(self) -> list[dict[str, Any]]:
        if isinstance(self.source, list):
            return [strict_json(r) for r in self.source]
        df = self.source if self.limit is None else self.source.limit(self.limit)
        return [strict_json(r.asDict()) for r in df.collect()]

    def column_names(self) -> list[str]:
        if self.columns is not None:
            return self.columns
        if isinstance(self.source, list):
            return list(self.source[0]) if self.source else []
        return self.source.columns


@dataclass
class Chart:
    id: str
    kind: str
    data: Any
    options: dict[str, Any] = field(default_factory=dict)


@dataclass
class Result:
    metrics: list[Metric] = field(default_factory=list)
    tables: list[Table] = field(default_factory=list)
    charts: list[Chart] = field(default_factory=list)
    warnings: list[Warning_] = field(default_factory=list)
    metadata: dict[str, Any] = field(default_factory=dict)
    data: DataFrame | None = None
    presentation: list[dict[str, Any]] = field(default_factory=list)

    def metric(self, name: str) -> Any:
        return next(m.value for m in self.metrics if m.id == name)

    def table(self, name: str) -> Table:
        return next(t for t in self.tables if t.id == name)

    def warn(self, code: str, message: str, **details: Any) -> None:
        self.warnings.append(Warning_(code, message, details))

    def check_references(self) -> None:
        """Presentation blocks may only name metrics, tables and charts that exist."""
        known = {"metric": {m.id for m in self.metrics}, "table": {t.id for t in self.tables}, "chart": {c.id for c in self.charts}}
        for block in self.presentation:
            kind = block.get("kind")
            if kind in known and block.get("ref") not in known[kind]:
                raise OperatorError(ErrorCode.EXECUTION_ERROR, "presentation names an unknown result", ref=block.get("ref"))

    def to_dict(self) -> dict[str, Any]:
        self.check_references()
        return {
            "metrics": [{"id": m.id, "value": strict_json(m.value), "unit": m.unit} for m in self.metrics],
            "tables": [{"id": t.id, "columns": t.column_names(), "rows": t.rows()} for t in self.tables],
            "charts": [{"id": c.id, "kind": c.kind, "data": strict_json(c.data), "options": strict_json(c.options)} for c in self.charts],
            "warnings": [{"code": w.code, "message": w.message, "details": strict_json(w.details)} for w in self.warnings],
            "metadata": strict_json(self.metadata),
            "presentation": strict_json(self.presentation),
            "produced_data": self.data is not None,
        }


def strict_json(value: Any) -> Any:
    """Values JSON can hold: NaN and infinities become null, times ISO text; unknown types are refused.

    Floats keep 13 significant digits, beyond the noise of sums in another order.
    """
    if value is None or isinstance(value, (str, bool, int)):
        return value
    if isinstance(value, float):
        return float(f"{value:.13g}") if math.isfinite(value) else None
    if hasattr(value, "item") and not isinstance(value, (bytes, bytearray)) and getattr(value, "shape", ()) == ():
        return strict_json(value.item())
    if isinstance(value, (dt.datetime, dt.date, dt.time)):
        return value.isoformat()
    if isinstance(value, dt.timedelta):
        return value.total_seconds()
    if isinstance(value, decimal.Decimal):
        return strict_json(float(value))
    if isinstance(value, dict):
        if not all(isinstance(k, str) for k in value):
            raise OperatorError(ErrorCode.EXECUTION_ERROR, "result has a name that is not text")
        return {k: strict_json(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)) or hasattr(value, "tolist"):
        return [strict_json(v) for v in (value.tolist() if hasattr(value, "tolist") else value)]
    raise OperatorError(ErrorCode.EXECUTION_ERROR, f"result holds a {type(value).__name__}, which JSON cannot")
