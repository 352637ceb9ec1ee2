"""Column expressions the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def normalised(df: DataFrame) -> DataFrame:
    """NaN becomes null in floating columns, decimals become doubles."""
    changed = {}
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            changed[f.name] = F.when(~F.isnan(c), c)
        elif isinstance(f.dataType, T.DecimalType):
            changed[f.name] = c.cast("double")
    return df.withColumns(changed) if changed else df


def finite(c: Column) -> Column:
    """The value, or null if it is infinite."""
    return F.when(F.abs(c) != float("inf"), c)


def _float_text(c: Column) -> Column:
    """Text of a floating number: plain digits from 0.0001 up to 1e16, beyond a mantissa and an exponent of two digits at least."""
    text = c.cast("string")
    sign, body = F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit("")), F.regexp_replace(text, "^-", "")
    parts = F.split(body, "E")
    digits, power = F.regexp_replace(F.replace(parts[0], F.lit("."), F.lit("")), "0+$", ""), F.get(parts, 1).cast("int")
    size = F.length(digits)
    whole = F.when(size <= power + 1, F.concat(digits, F.repeat(F.lit("0"), power + 1 - size), F.lit(".0"))).otherwise(F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, size)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    mantissa = F.when(size > 1, F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, F.lit(2), size))).otherwise(digits)
    wide = F.concat(mantissa, F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")), F.when(F.abs(power) < 10, F.lit("0")).otherwise(F.lit("")), F.abs(power).cast("string"))
    return F.when(F.abs(c) == float("inf"), F.when(c > 0, F.lit("inf")).otherwise(F.lit("-inf"))).when(power.isNull(), text).otherwise(F.concat(sign, F.when(power.between(0, 15), whole).when(power.between(-4, -1), small).otherwise(wide)))


def missing_text(kind: T.DataType) -> str:
    """The label of a missing value."""
    return "nan" if isinstance(kind, T.NumericType) else "None"


def canonical_text(c: Column, kind: T.DataType) -> Column:
    """Text of a value as a label: booleans as True and False, floating numbers by their shortest digits, others by Spark's cast."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return _float_text(c)
    if isinstance(kind, T.BooleanType):
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    return c.cast("string")


def round_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)


def all_present(*columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & col(c).isNotNull()
    return out
