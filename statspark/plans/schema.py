"""A small JSON-Schema validator for operator parameters."""

from __future__ import annotations

import math
from typing import Any

from ..model import parameter_error

_KNOWN = {
    "type", "enum", "const", "oneOf", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength", "items", "minItems", "maxItems",
    "uniqueItems", "required", "properties", "additionalProperties", "minProperties", "default",
}
_TYPES = {
    "integer": lambda v: (isinstance(v, int) or (isinstance(v, float) and v.is_integer())) and not isinstance(v, bool),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v),
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "array": lambda v: isinstance(v, list),
    "object": lambda v: isinstance(v, dict),
    "null": lambda v: v is None,
}


def check_schema(schema: dict[str, Any]) -> list[str]:
    """Problems of a schema itself."""
    problems = [f"unknown keyword {k}" for k in schema if k not in _KNOWN]
    kinds = schema.get("type", [])
    problems += [f"unknown type {t}" for t in ([kinds] if isinstance(kinds, str) else kinds) if t not in _TYPES]
    if "default" in schema and (found := list(errors(schema["default"], schema, "default"))):
        problems += found
    return problems


def errors(value: Any, schema: dict[str, Any], at: str):
    """What is wrong with a value, as text."""
    kinds = schema.get("type")
    if kinds is not None:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        if not any(_TYPES[k](value) for k in kinds):
            yield f"{at} must be {' or '.join(kinds)}"
            return
    if "enum" in schema and not any(value == e and isinstance(value, bool) == isinstance(e, bool) for e in schema["enum"]):
        yield f"{at} must be one of {schema['enum']}"
    if "const" in schema and value != schema["const"]:
        yield f"{at} must be {schema['const']!r}"
    if "oneOf" in schema and sum(not list(errors(value, s, at)) for s in schema["oneOf"]) != 1:
        yield f"{at} fits not exactly one form"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        for keyword, broken in (("minimum", value < schema.get("minimum", value)), ("maximum", value > schema.get("maximum", value))):
            if broken:
                yield f"{at} is beyond its {keyword} {schema[keyword]}"
        if "exclusiveMinimum" in schema and value <= schema["exclusiveMinimum"]:
            yield f"{at} must be above {schema['exclusiveMinimum']}"
        if "exclusiveMaximum" in schema and value >= schema["exclusiveMaximum"]:
            yield f"{at} must be below {schema['exclusiveMaximum']}"
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", len(value)):
            yield f"{at} has a length out of range"
    if isinstance(value, list):
        if len(value) < schema.get("minItems", 0) or len(value) > schema.get("maxItems", len(value)):
            yield f"{at} has too few or too many items"
        if schema.get("uniqueItems") and any(v in value[:i] for i, v in enumerate(value)):
            yield f"{at} repeats an item"
        if "items" in schema:
            for i, v in enumerate(value):
                yield from errors(v, schema["items"], f"{at}[{i}]")
    if isinstance(value, dict):
        if len(value) < schema.get("minProperties", 0):
            yield f"{at} has too few entries"
        named = schema.get("properties", {})
        for name in schema.get("required", []):
            if name not in value:
                yield f"{at}.{name} is missing"
        for name, v in value.items():
            if name in named:
                yield from errors(v, named[name], f"{at}.{name}")
            elif schema.get("additionalProperties") is False:
                yield f"{at}.{name} is unknown"
            elif isinstance(schema.get("additionalProperties"), dict):
                yield from errors(v, schema["additionalProperties"], f"{at}.{name}")


def resolve(given: dict[str, Any], schemas: dict[str, dict[str, Any]], required: tuple[str, ...]) -> dict[str, Any]:
    """Defaults filled in, then validated."""
    whole = {n: s["default"] for n, s in schemas.items() if "default" in s} | given
    found = list(errors(whole, {"type": "object", "properties": schemas, "required": list(required), "additionalProperties": False}, "parameters"))
    if found:
        raise parameter_error("parameters are not valid", problems=found)
    return whole
