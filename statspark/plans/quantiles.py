"""Exact linear-interpolated quantiles that do not gather a column in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows up to which Spark's exact percentile, which merges all values in one task, is used as it is.
DIRECT_ROWS = 2_000_000
ACCURACY = 10_000


def exact_quantiles(df: DataFrame, columns: list[Column], shares: list[float], direct_rows: int = DIRECT_ROWS) -> list[list[float] | None]:
    """Quantiles of each column (None without values).

    Large frames are narrowed down: an approximate sketch brackets each wanted
    rank, one aggregate counts what lies below and inside the brackets, and only
    a bracket that holds few enough values is ordered. All ranks of all columns share each pass.
    """
    named = df.select(*(c.cast("double").alias(f"v{i}") for i, c in enumerate(columns)))
    if named.limit(direct_rows + 1).count() <= direct_rows:
        row = named.agg(*(F.percentile(f"v{i}", F.array(*(F.lit(float(q)) for q in shares))).alias(f"q{i}") for i in range(len(columns)))).first()
        return [row[f"q{i}"] for i in range(len(columns))]
    sizes = named.agg(*(F.count(f"v{i}").alias(f"n{i}") for i in range(len(columns)))).first()
    wanted: dict[tuple[int, int], tuple[float, float, int, int]] = {}  # (column, rank): bracket, values below it, values inside
    for i in range(len(columns)):
        n = sizes[f"n{i}"]
        for q in shares if n else []:
            for rank in {math.floor(q * (n - 1)), math.ceil(q * (n - 1))}:
                wanted[i, rank] = -math.inf, math.inf, 0, n
    found: dict[tuple[int, int], float] = {}
    while wanted:
        ready = {k: w for k, w in wanted.items() if w[3] <= direct_rows or w[0] == w[1]}
        found |= _pick(named, ready)
        wanted = {k: w for k, w in wanted.items() if k not in found}
        if wanted:
            wanted = _narrow(named, wanted)
    out: list[list[float] | None] = []
    for i in range(len(columns)):
        n = sizes[f"n{i}"]
        values = []
        for q in shares if n else []:
            at = q * (n - 1)
            low, high = found[i, math.floor(at)], found[i, math.ceil(at)]
            values.append(low + (high - low) * (at - math.floor(at)))
        out.append(values or None)
    return out


def _inside(i: int, low: float, high: float) -> Column:
    v = F.col(f"v{i}")
    return F.when((v >= F.lit(low)) & (v <= F.lit(high)), v)


def _pick(named: DataFrame, ready: dict) -> dict[tuple[int, int], float]:
    """The values at ranks whose brackets are small, or hold one value only."""
    out = {k: low for k, (low, high, _, _) in ready.items() if low == high}
    rest = [(k, w) for k, w in ready.items() if k not in out]
    if rest:
        row = named.agg(*(F.percentile(_inside(k[0], w[0], w[1]), F.lit((k[1] - w[2]) / max(1, w[3] - 1))).alias(f"p{j}") for j, (k, w) in enumerate(rest))).first()
        # A share of a rank may miss it by rounding, so the nearest value is taken.
        near = named.agg(*(F.min_by(_inside(k[0], w[0], w[1]), F.abs(_inside(k[0], w[0], w[1]) - F.lit(row[f"p{j}"]))).alias(f"p{j}") for j, (k, w) in enumerate(rest))).first()
        out |= {k: near[f"p{j}"] for j, (k, _) in enumerate(rest)}
    return out


def _narrow(named: DataFrame, wanted: dict) -> dict:
    """Tighter brackets from sketches of the values inside the present ones."""
    keys = list(wanted)
    aggs = []
    for j, key in enumerate(keys):
        low, high, below, n = wanted[key]
        share = (key[1] - below) / max(1, n - 1)
        ends = [max(0.0, share - 3 / ACCURACY), min(1.0, share + 3 / ACCURACY)]
        aggs.append(F.percentile_approx(_inside(key[0], low, high), ends, ACCURACY).alias(f"e{j}"))
    row = named.agg(*aggs).first()
    brackets = {}
    for j, key in enumerate(keys):
        low, high, below, n = wanted[key]
        rank, (a, b) = key[1] - below, row[f"e{j}"]
        brackets[key] = (low if rank <= 3 * n / ACCURACY and a != b else a), (high if rank >= n - 1 - 3 * n / ACCURACY and a != b else b)
    counts = named.agg(*(c for j, key in enumerate(keys) for c in (F.count(F.when(F.col(f"v{key[0]}") < F.lit(brackets[key][0]), 1)).alias(f"b{j}"), F.count(_inside(key[0], *brackets[key])).alias(f"n{j}")))).first()
    out = {}
    for j, key in enumerate(keys):
        below, n = counts[f"b{j}"], counts[f"n{j}"]
        hit = below <= key[1] < below + n
        smaller = n < wanted[key][3] or brackets[key][0] == brackets[key][1]
        # A sketch that missed, or that did not narrow, is replaced by halving the value range.
        out[key] = (*brackets[key], below, n) if hit and smaller else _halved(named, key, wanted[key])
    return out


def _halved(named: DataFrame, key: tuple[int, int], present: tuple[float, float, int, int]) -> tuple[float, float, int, int]:
    low, high, below, n = present
    ends = named.agg(F.min(_inside(key[0], low, high)), F.max(_inside(key[0], low, high))).first()
    middle = ends[0] + (ends[1] - ends[0]) / 2
    v = F.col(f"v{key[0]}")
    left = named.agg(F.count(F.when((v >= F.lit(ends[0])) & (v <= F.lit(middle)), 1))).first()[0]
    if key[1] < below + left:
        top = named.agg(F.max(_inside(key[0], ends[0], middle))).first()[0]
        return ends[0], top, below, left
    bottom = named.agg(F.min(F.when((v > F.lit(middle)) & (v <= F.lit(ends[1])), v))).first()[0]
    return bottom, ends[1], below + left, n - left
