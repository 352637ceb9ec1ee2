"""The operator catalogue: declared slots, parameters and constraints, found by operation key."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import ROW_ID, Context, FieldMeta, OperatorError, ErrorCode, Result, column_error

NUMERIC = frozenset({"integer", "number"})
DISCRETE = frozenset({"integer", "number", "string", "boolean", "category"})
ANY = DISCRETE | {"datetime"}
ORDERING = frozenset({"integer", "number", "string", "datetime", "category"})
QUANTITATIVE = frozenset({"quantitative"})
CATEGORICAL = frozenset({"categorical"})
BOTH = QUANTITATIVE | CATEGORICAL


@dataclass(frozen=True)
class Slot:
    id: str
    types: frozenset[str] = ANY
    labels: frozenset[str] = BOTH
    least: int = 1
    most: int | None = None
    allow_missing: bool = True
    finite_only: bool = False
    unique_values: bool = False
    least_unique: int | None = None
    most_unique: int | None = None
    minimum: float | None = None
    maximum: float | None = None


CONSTRAINTS = frozenset({"slots_disjoint", "total_min_items", "total_max_items", "requires_slot", "exact_category_count", "min_rows", "time_order", "equal_interval"})


@dataclass(frozen=True)
class Constraint:
    kind: str
    slots: tuple[str, ...] = ()
    value: float | None = None


def disjoint(*slots: str) -> Constraint:
    return Constraint("slots_disjoint", slots)


@dataclass(frozen=True)
class Operator:
    key: str
    module: str
    slots: tuple[Slot, ...]
    parameters: dict[str, dict[str, Any]]
    required: tuple[str, ...]
    constraints: tuple[Constraint, ...]
    produces_data: bool
    run: Callable[[Run], Result]
    doc: str = ""


@dataclass
class Run:
    """One validated call: a frame with a row identity, and everything the operator may read."""

    df: DataFrame
    slots: dict[str, list[str]]
    params: dict[str, Any]
    context: Context = field(default_factory=Context)

    def columns(self, slot: str) -> list[str]:
        return list(self.slots.get(slot, []))

    def column(self, slot: str) -> str:
        found = self.slots.get(slot, [])
        if len(found) != 1:
            raise column_error(f"slot {slot} takes one column", slot=slot)
        return found[0]

    def optional(self, slot: str) -> str | None:
        found = self.slots.get(slot, [])
        return found[0] if found else None

    def meta(self, column: str) -> FieldMeta:
        return self.context.fields[column]

    def is_categorical(self, column: str) -> bool:
        return self.meta(column).analysis_type == "categorical"

    @property
    def user_columns(self) -> list[str]:
        return [c for c in self.df.columns if c != ROW_ID]

    def new_name(self, wanted: str) -> str:
        """A column name that is not taken: wanted, wanted_2, wanted_3, ..."""
        taken = {c.lower() for c in self.user_columns}
        name, n = wanted, 2
        while name.lower() in taken:
            name, n = f"{wanted}_{n}", n + 1
        return name


CATALOGUE: dict[str, Operator] = {}


def operator(key: str, module: str, slots: list[Slot], parameters: dict[str, dict[str, Any]] | None = None, required: tuple[str, ...] = (), constraints: tuple[Constraint, ...] = (), produces_data: bool = False):
    """Register a function as the operator of a key."""

    def add(function: Callable[[Run], Result]) -> Callable[[Run], Result]:
        if key in CATALOGUE:
            raise ValueError(f"{key} is registered twice")
        CATALOGUE[key] = Operator(key, module, tuple(slots), parameters or {}, required, constraints, produces_data, function, (function.__doc__ or "").strip())
        return function

    return add


def lookup(key: str) -> Operator:
    from .. import operators  # noqa: F401  registers the catalogue

    if key not in CATALOGUE:
        raise OperatorError(ErrorCode.PARAMETER_ERROR, "unknown operation", operation_key=key)
    return CATALOGUE[key]


def catalogue() -> dict[str, Operator]:
    from .. import operators  # noqa: F401

    return CATALOGUE


def check_catalogue() -> list[str]:
    """Problems of the declarations: bad keys, unknown slots in constraints, ill-formed parameters."""
    from .schema import check_schema

    problems = []
    for key, op in catalogue().items():
        if key.count(".") != 1:
            problems.append(f"{key}: a key is algorithm.method")
        ids = {s.id for s in op.slots}
        for c in op.constraints:
            if c.kind not in CONSTRAINTS:
                problems.append(f"{key}: unknown constraint {c.kind}")
            if set(c.slots) - ids:
                problems.append(f"{key}: constraint {c.kind} names unknown slots")
        for name, schema in op.parameters.items():
            problems.extend(f"{key}.{name}: {p}" for p in check_schema(schema))
        problems.extend(f"{key}: required {n} is not declared" for n in op.required if n not in op.parameters)
    return problems


def number(column: str):
    return F.col(f"`{column}`").cast("double")
