"""Encoding, outliers and invalid rows. Every operator returns a new table."""

from __future__ import annotations

import re
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import canonical_text, col, finite, missing_text
from ..functions.special import corrected_skewness
from ..model import ROW_ID, Metric, Result, Table, column_error, data_error, parameter_error
from ..plans.order import POSITION, with_position
from ..plans.quantiles import exact_quantiles
from ..plans.registry import ANY, BOTH, DISCRETE, NUMERIC, QUANTITATIVE, Run, Slot, operator
from .bins import bin_code, bin_edges

MODULE = "data_processing"
_SCALAR = {"type": ["string", "number", "integer", "boolean", "null"]}
_TARGET = {
    "output_mode": {"type": "string", "enum": ["new_column", "replace"], "default": "new_column"},
    "output_column_name": {"type": "string", "minLength": 1, "maxLength": 128, "default": "encoded_value"},
}
_ENCODE = {"unmatched": {"type": "string", "enum": ["keep", "null", "error"], "default": "keep"}, "include_missing": {"type": "boolean", "default": False}, **_TARGET}
_SOURCE = Slot("source_column", DISCRETE, BOTH, 1, 1)
_NUMERIC_SOURCE = Slot("source_column", NUMERIC, QUANTITATIVE, 1, 1)


def common_type(values: list[Any], kept: T.DataType | None) -> T.DataType:
    """One Spark type for codes: boolean, long or double if all agree (with the kept source), else text."""
    kinds = {type(v) for v in values if v is not None}
    if kept is not None:
        kinds.add(bool if isinstance(kept, T.BooleanType) else int if isinstance(kept, T.IntegralType) else float if isinstance(kept, T.FractionalType) else str)
    if kinds <= {bool}:
        return T.BooleanType()
    if kinds <= {int}:
        return T.LongType()
    if kinds <= {int, float}:
        return T.DoubleType()
    return T.StringType()


def _literal(value: Any, kind: T.DataType) -> Column:
    if value is not None and isinstance(kind, T.StringType):
        value = str(value)
    return F.lit(value).cast(kind)


def _target(run: Run, source: str) -> str:
    return source if run.params["output_mode"] == "replace" else run.new_name(run.params["output_column_name"])


def _encoded(run: Run, source: str, matched: Column, code, values: list[Any], mapping_rows: list[dict], null_kept: bool) -> Result:
    """Shared tail of the two explicit encodings."""
    kind_of = run.df.schema[source].dataType
    policy = run.params["unmatched"]
    value = col(source)
    missing = value.isNull() & F.lit(not null_kept)
    hit = F.coalesce(matched, F.lit(False)) & ~missing
    counts = run.df.agg(F.count(F.when(hit, 1)).alias("hit"), F.count(F.when(~hit & ~missing, 1)).alias("miss")).first()
    if policy == "error" and counts["miss"]:
        raise data_error("values have no code", column=source, count=counts["miss"])
    kind = common_type(values, kind_of if policy == "keep" else None)
    rest = canonical_text(value, kind_of).cast(kind) if policy == "keep" and isinstance(kind, T.StringType) else value.cast(kind) if policy == "keep" else F.lit(None).cast(kind)
    target = _target(run, source)
    data = run.df.withColumn(target, F.when(hit, code(kind)).when(~missing, rest)).drop(ROW_ID)
    result = Result(
        [Metric("changed_count", counts["hit"]), Metric("unmatched_count", counts["miss"])],
        [Table("encoding_mapping", mapping_rows)],
        metadata={"source_column": source, "output_column": target, "output_type": kind.simpleString(), "changed_columns": [target]},
        data=data,
    )
    if counts["miss"]:
        result.warn("UNMATCHED_VALUES", "some values have no code", column=source, count=counts["miss"])
    return result


@operator("data_encoding.manual", MODULE, [_SOURCE], {"mapping": {"type": "object", "minProperties": 1, "additionalProperties": _SCALAR}, **_ENCODE}, ("mapping",), produces_data=True)
def encode_manual(run: Run) -> Result:
    """Codes by the text of a value, through one literal map."""
    source = run.column("source_column")
    mapping: dict[str, Any] = run.params["mapping"]
    text = canonical_text(col(source), run.df.schema[source].dataType)
    if run.params["include_missing"]:
        text = F.coalesce(text, F.lit(missing_text(run.df.schema[source].dataType)))
    known = text.isin(list(mapping))

    def code(kind: T.DataType) -> Column:
        pairs = [x for k, v in mapping.items() for x in (F.lit(k), _literal(v, kind))]
        return F.element_at(F.create_map(*pairs), text)

    rows = [{"source": k, "target": v if v is None else str(v)} for k, v in mapping.items()]
    return _encoded(run, source, known, code, list(mapping.values()), rows, run.params["include_missing"])


_RANGE = {"type": "object", "properties": {"minimum": {"type": ["number", "null"]}, "maximum": {"type": ["number", "null"]}, "value": _SCALAR}, "required": ["value"], "additionalProperties": False}


@operator("data_encoding.range", MODULE, [_NUMERIC_SOURCE], {"ranges": {"type": "array", "minItems": 1, "items": _RANGE}, **_ENCODE}, ("ranges",), produces_data=True)
def encode_range(run: Run) -> Result:
    """Codes by half-open ranges [minimum, maximum)."""
    source = run.column("source_column")
    inf = float("inf")
    spans = []
    for r in run.params["ranges"]:
        low, high = r.get("minimum"), r.get("maximum")
        if low is None and high is None:
            raise parameter_error("a range needs a bound")
        low, high = -inf if low is None else float(low), inf if high is None else float(high)
        if low >= high:
            raise parameter_error("a range must rise", minimum=low, maximum=high)
        spans.append((low, high, r["value"]))
    spans.sort(key=lambda s: s[0])
    if any(a[1] > b[0] for a, b in zip(spans, spans[1:], strict=False)):
        raise parameter_error("ranges overlap")
    value = col(source).cast("double")
    inside = [(value >= low) & (value < high) if high < inf else value >= low if low > -inf else value < high for low, high, _ in spans]

    def code(kind: T.DataType) -> Column:
        return F.coalesce(*(F.when(m, _literal(v, kind)) for m, (_, _, v) in zip(inside, spans, strict=True)))

    rows = [{"minimum": None if low == -inf else low, "maximum": None if high == inf else high, "target": v if v is None else str(v)} for low, high, v in spans]
    return _encoded(run, source, reduce(lambda a, b: a | b, inside), code, [v for *_, v in spans], rows, False)


@operator("data_encoding.auto_bin", MODULE, [_NUMERIC_SOURCE], {"bin_method": {"type": "string", "enum": ["equal_width", "equal_frequency"], "default": "equal_width"}, "bin_count": {"type": "integer", "minimum": 2, "maximum": 100, "default": 5}, **_TARGET, "output_column_name": {"type": "string", "minLength": 1, "maxLength": 128, "default": "encoded_group"}}, produces_data=True)
def encode_auto_bin(run: Run) -> Result:
    """1-based codes of equal-width or equal-frequency bins."""
    source = run.column("source_column")
    edges, joined = bin_edges(run.df, source, run.params["bin_method"], run.params["bin_count"])
    if len(edges) < 2:
        raise data_error("too few distinct values for bins", column=source)
    target = _target(run, source)
    code = bin_code(finite(col(source).cast("double")), edges).cast("long")
    data = run.df.withColumn(target, code).drop(ROW_ID)
    rows = [{"group": i + 1, "minimum": edges[i], "maximum": edges[i + 1]} for i in range(len(edges) - 1)]
    changed = data.agg(F.count(col(target))).first()[0]
    result = Result([Metric("changed_count", changed), Metric("group_count", len(rows))], [Table("bin_mapping", rows)], metadata={"source_column": source, "output_column": target, "changed_columns": [target]}, data=data)
    if joined:
        result.warn("DUPLICATE_BIN_EDGES", "equal quantiles were joined", column=source)
    return result


ACTIONS = ["set_null", "custom_value", "mean", "median", "mode", "zero", "random_valid_value", "winsorize"]
_BOUND = {"type": "object", "properties": {"minimum": {"type": ["number", "null"]}, "maximum": {"type": ["number", "null"]}}, "additionalProperties": False}
_ACTION = {"action": {"type": "string", "enum": ACTIONS, "default": "set_null"}, "replacement_value": {"type": "number", "default": 0}}
_NO_BOUNDS = {"bounds": {"type": "object", "default": {}}}
_POSITIVE = {"type": "number", "exclusiveMinimum": 0}
NORMAL_QUARTILE = 0.6744897501960817
PREVIEW = 20


def outlier_bounds(df: DataFrame, columns: list[str], method: str, params: dict[str, Any]) -> dict[str, tuple[str, float, float]]:
    """Method and bounds of each column: one aggregate for all, then exact quantiles where the method needs them."""
    value = {c: col(c).cast("double") for c in columns}
    aggs = []
    for i, c in enumerate(columns):
        v = value[c]
        aggs += [
            F.count(v).alias(f"n{i}"), F.min(v).alias(f"low{i}"), F.max(v).alias(f"high{i}"), F.count(F.when(F.abs(v) == float("inf"), 1)).alias(f"inf{i}"),
            F.avg(v).alias(f"mean{i}"), F.stddev_samp(v).alias(f"sd{i}"), F.skewness(v).alias(f"skew{i}"),
        ]
    row = df.agg(*aggs).first()
    chosen: dict[str, str] = {}
    for i, c in enumerate(columns):
        if row[f"inf{i}"]:
            raise data_error("column has infinite values", column=c)
        if not row[f"n{i}"]:
            raise data_error("column has no values", column=c)
        if row[f"low{i}"] == row[f"high{i}"]:
            raise data_error("column is constant", column=c)
        skew = corrected_skewness(row[f"skew{i}"], row[f"n{i}"])
        chosen[c] = ("mad" if skew is not None and abs(skew) > 1 else "iqr") if method == "auto" else method
    ranked = [c for c in columns if chosen[c] in ("mad", "iqr")]
    quartiles = dict(zip(ranked, exact_quantiles(df, [value[c] for c in ranked], [0.25, 0.5, 0.75]), strict=True)) if ranked else {}
    by_mad = [c for c in columns if chosen[c] == "mad"]
    gaps = exact_quantiles(df, [F.abs(value[c] - F.lit(quartiles[c][1])) for c in by_mad], [0.5]) if by_mad else []
    spread = {c: g[0] for c, g in zip(by_mad, gaps, strict=True)}
    out = {}
    for i, c in enumerate(columns):
        q1, median, q3 = quartiles.get(c, (0.0, 0.0, 0.0))
        if chosen[c] == "custom":
            given = params["bounds"].get(c)
            if given is None:
                raise parameter_error("no bounds are given for a column", column=c)
            low = -float("inf") if given.get("minimum") is None else float(given["minimum"])
            high = float("inf") if given.get("maximum") is None else float(given["maximum"])
            if low >= high:
                raise parameter_error("bounds must rise", column=c)
        elif chosen[c] == "mad":
            if not spread[c]:
                raise data_error("median absolute deviation is zero", column=c)
            reach = params.get("threshold", 3.5) * spread[c] / NORMAL_QUARTILE
            low, high = median - reach, median + reach
        elif chosen[c] == "iqr":
            low, high = q1 - params.get("k", 1.5) * (q3 - q1), q3 + params.get("k", 1.5) * (q3 - q1)
        else:
            low, high = row[f"mean{i}"] - params.get("k", 3.0) * row[f"sd{i}"], row[f"mean{i}"] + params.get("k", 3.0) * row[f"sd{i}"]
        out[c] = chosen[c], low, high
    return out


def _random_valid(df: DataFrame, column: str, inside: Column, outside: Column, seed: int) -> DataFrame:
    """Each outlier gets the value of a valid row, drawn by hash among the positions of all of them."""
    valid = with_position(df.where(inside).select(ROW_ID, col(column).cast("double").alias("__pick")), None).select(F.col(POSITION).alias("__at"), "__pick")
    total = df.where(inside).count()
    if not total:
        raise data_error("no valid value is left to draw from", column=column)
    drawn = df.where(outside).withColumn("__at", F.pmod(F.xxhash64(ROW_ID, F.lit(seed)), F.lit(total)))
    drawn = drawn.join(valid, "__at").withColumn(column, F.col("__pick")).select(*df.columns)
    return df.where(~outside).withColumn(column, col(column).cast("double")).unionByName(drawn)


def _handle(run: Run, method: str) -> Result:
    columns = run.columns("x_columns")
    params = run.params
    bounds = outlier_bounds(run.df, columns, method, params)
    outside = {c: F.coalesce((col(c).cast("double") < F.lit(low)) | (col(c).cast("double") > F.lit(high)), F.lit(False)) for c, (_, low, high) in bounds.items()}
    inside = {c: col(c).isNotNull() & ~outside[c] for c in columns}
    valid = {c: F.when(inside[c], col(c).cast("double")) for c in columns}
    action = params["action"]
    aggs = [F.count(F.when(outside[c], 1)).alias(f"n{i}") for i, c in enumerate(columns)]
    if action == "mean":
        aggs += [F.avg(valid[c]).alias(f"r{i}") for i, c in enumerate(columns)]
    row = run.df.agg(*aggs).first()
    new_values: dict[str, float | None] = {c: row[f"r{i}"] for i, c in enumerate(columns)} if action == "mean" else {}
    if action == "median":
        new_values = {c: q and q[0] for c, q in zip(columns, exact_quantiles(run.df, [valid[c] for c in columns], [0.5]), strict=True)}
    if action == "mode":  # the smallest of the most frequent values
        for c in columns:
            top = run.df.where(valid[c].isNotNull()).groupBy(valid[c].alias("v")).count().orderBy(F.desc("count"), "v").first()
            new_values[c] = top and top["v"]
    previews = {c: [str(r[0]) for r in run.df.where(outside[c]).select(ROW_ID).orderBy(ROW_ID).limit(PREVIEW).collect()] if row[f"n{i}"] else [] for i, c in enumerate(columns)}
    data = run.df
    for i, c in enumerate(columns):
        v, (_, low, high) = col(c).cast("double"), bounds[c]
        if not row[f"n{i}"]:
            continue
        if action == "winsorize":
            data = data.withColumn(c, F.when(v < F.lit(low), F.lit(low)).when(v > F.lit(high), F.lit(high)).otherwise(v))
        elif action == "set_null":
            data = data.withColumn(c, F.when(~outside[c], col(c)))
        elif action == "random_valid_value":
            data = _random_valid(data, c, inside[c], outside[c], run.context.random_seed)
        else:
            new = {"custom_value": params["replacement_value"], "zero": 0.0}.get(action, new_values.get(c))
            if new is None:
                raise data_error("no valid value is left", column=c)
            data = data.withColumn(c, F.when(outside[c], F.lit(float(new))).otherwise(v))
    rows = [{"field": c, "actual_method": m, "lower_bound": low, "upper_bound": high, "outlier_count": row[f"n{i}"], "index_preview": previews[c]} for i, (c, (m, low, high)) in enumerate(bounds.items())]
    result = Result([Metric("outlier_count", sum(r["outlier_count"] for r in rows))], [Table("outlier_bounds", rows)], metadata={"method": method, "action": action, "changed_columns": columns}, data=data.drop(ROW_ID))
    if method == "auto":
        result.warn("AUTO_OUTLIER_METHOD", "the method was chosen by skewness", methods={c: m for c, (m, _, _) in bounds.items()})
    return result


_X = [Slot("x_columns", NUMERIC, QUANTITATIVE)]
for _method, _extra, _required in (
    ("auto", _NO_BOUNDS | {"threshold": _POSITIVE | {"default": 3.5}, "k": _POSITIVE | {"default": 1.5}}, ()),
    ("custom", {"bounds": {"type": "object", "minProperties": 1, "additionalProperties": _BOUND}}, ("bounds",)),
    ("mad", _NO_BOUNDS | {"threshold": _POSITIVE | {"default": 3.5}}, ()),
    ("iqr", _NO_BOUNDS | {"k": _POSITIVE | {"default": 1.5}}, ()),
    ("three_sigma", _NO_BOUNDS | {"k": _POSITIVE | {"default": 3.0}}, ()),
):
    operator(f"outlier_handling.{_method}", MODULE, _X, _ACTION | _extra, _required, produces_data=True)(lambda run, m=_method: _handle(run, m))


_RULE = {
    "type": "object",
    "properties": {
        "type": {"type": "string", "enum": ["missing_ratio", "value_range", "allowed_values", "data_type", "unique_key", "duplicate_row", "cross_field_rule", "pattern"]},
        "columns": {"type": "array", "items": {"type": "string"}},
        "minimum": {"type": ["number", "null"]}, "maximum": {"type": ["number", "null"]}, "values": {"type": "array"}, "threshold": {"type": "number", "minimum": 0, "maximum": 1},
        "operator": {"type": "string", "enum": ["lt", "le", "gt", "ge", "eq", "ne"]}, "pattern": {"type": "string", "maxLength": 256}, "weight": {"type": "number", "minimum": 0},
    },
    "required": ["type"], "additionalProperties": False,
}
_COMPARE = {"lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "eq": lambda a, b: a == b, "ne": lambda a, b: a != b}


def _repeated(df: DataFrame, columns: list[str], out: str) -> DataFrame:
    """Flag rows whose values of the columns occur again (nulls equal), from pre-aggregated counts of a key hash pair."""
    key = [F.xxhash64(*(F.struct(col(c).isNull(), col(c)) for c in columns)).alias("__h1"), F.hash(F.lit(7), *(F.struct(col(c).isNull(), col(c)) for c in columns)).alias("__h2")]
    again = df.select(*key).groupBy("__h1", "__h2").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    marked = df.withColumns({"__h1": key[0], "__h2": key[1]}).join(again, ["__h1", "__h2"], "left")
    return marked.withColumn(out, F.col("__n").isNotNull()).drop("__h1", "__h2", "__n")


def rule_mask(df: DataFrame, rule: dict[str, Any], columns: list[str], index: int) -> tuple[DataFrame, Column]:
    """The frame (with a helper column if needed) and the rows a rule marks as invalid."""
    kind, chosen = rule["type"], list(rule.get("columns") or columns)
    for c in chosen:
        if c not in columns:
            raise column_error("a rule names a column outside the slot", column=c)
    if kind == "missing_ratio":
        share = reduce(lambda a, b: a + b, [col(c).isNull().cast("int") for c in chosen]) / len(chosen)
        return df, share > F.lit(rule.get("threshold", 0.0))
    if kind in ("unique_key", "duplicate_row"):
        name = f"__repeated_{index}"
        return _repeated(df, chosen, name), F.col(name)
    masks = []
    if kind == "cross_field_rule":
        if len(chosen) != 2 or "operator" not in rule:
            raise parameter_error("a cross-field rule needs two columns and an operator")
        a, b = (col(c) for c in chosen)
        return df, F.coalesce(a.isNotNull() & b.isNotNull() & ~_COMPARE[rule["operator"]](a, b), F.lit(False))
    for c in chosen:
        value, present = col(c), col(c).isNotNull()
        text = canonical_text(value, df.schema[c].dataType)
        if kind in ("value_range", "data_type"):
            number = value.cast("double") if isinstance(df.schema[c].dataType, T.NumericType) else F.expr(f"try_cast(`{c}` as double)") if isinstance(df.schema[c].dataType, T.StringType) else F.lit(None).cast("double")
            mask = present & number.isNull()
            if kind == "value_range":
                if rule.get("minimum") is None and rule.get("maximum") is None:
                    raise parameter_error("a range rule needs a bound")
                if rule.get("minimum") is not None:
                    mask = mask | (number < rule["minimum"])
                if rule.get("maximum") is not None:
                    mask = mask | (number > rule["maximum"])
        elif kind == "allowed_values":
            if not rule.get("values"):
                raise parameter_error("a list rule needs values")
            mask = present & ~text.isin([str(v) for v in rule["values"]])
        else:
            try:
                re.compile(rule.get("pattern", ""))
            except re.error as e:
                raise parameter_error("pattern is not a regular expression") from e
            mask = present & ~text.rlike(rf"\A(?:{rule.get('pattern', '')})\z")
        masks.append(F.coalesce(mask, F.lit(False)))
    return df, reduce(lambda a, b: a | b, masks)


def _invalid(run: Run) -> Result:
    columns, params = run.columns("check_columns"), run.params
    df, masks = run.df, []
    for i, rule in enumerate(params["rules"]):
        df, mask = rule_mask(df, rule, columns, i)
        masks.append(mask)
    helpers = [c for c in df.columns if c.startswith("__repeated_")]
    weights = [float(r.get("weight", 1.0)) for r in params["rules"]]
    if params["combination"] == "weighted_score":
        score = reduce(lambda a, b: a + b, [m.cast("double") * w for m, w in zip(masks, weights, strict=True)])
        bad = score >= params["score_threshold"]
    else:
        bad = reduce((lambda a, b: a | b) if params["combination"] == "any" else (lambda a, b: a & b), masks)
    counted = df.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(bad, 1)).alias("bad"), *(F.count(F.when(m, 1)).alias(f"r{i}") for i, m in enumerate(masks))).first()
    flag = run.new_name(params["flag_column_name"])
    data = df.withColumn(flag, bad) if params["action"] == "flag" else df.where(~bad)
    rows = [{"rule_index": i + 1, "rule_type": r["type"], "matched_rows": counted[f"r{i}"], "weight": weights[i]} for i, r in enumerate(params["rules"])]
    result = Result([Metric("invalid_sample_count", counted["bad"]), Metric("valid_sample_count", counted["n"] - counted["bad"])], [Table("rule_details", rows)], metadata={"action": params["action"], "combination": params["combination"]}, data=data.drop(ROW_ID, *helpers))
    result.warn("BUSINESS_RULE_CONFIRMATION", "rules state what is invalid; confirm them with the owner of the data")
    return result


_RULE_PARAMS = {
    "combination": {"type": "string", "enum": ["any", "all", "weighted_score"], "default": "any"},
    "action": {"type": "string", "enum": ["flag", "remove_rows"], "default": "flag"},
    "flag_column_name": {"type": "string", "minLength": 1, "maxLength": 128, "default": "invalid_sample"},
    "score_threshold": {"type": "number", "minimum": 0, "default": 1.0},
}
_CHECK = [Slot("check_columns", ANY, BOTH, 2)]
operator("invalid_sample_handling.rule_based", MODULE, _CHECK, {"rules": {"type": "array", "minItems": 1, "maxItems": 1, "items": _RULE}, **_RULE_PARAMS}, ("rules",), produces_data=True)(lambda run: _invalid(run))
operator("invalid_sample_handling.custom_rules", MODULE, _CHECK, {"rules": {"type": "array", "minItems": 1, "items": _RULE}, **_RULE_PARAMS}, ("rules",), produces_data=True)(lambda run: _invalid(run))
