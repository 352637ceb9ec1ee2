"""Quality scores: naive Bayes support vectors over hashed n-gram indicators.

A text is a sequence of tokens: maximal runs of lower-case letters (bytes beyond
ASCII count as such), of capitals, of digits, or of one kind of mark; blanks
part tokens. The features are indicators of hashed token unigrams and bigrams,
of runs of three token shapes (kind and capped length), and of repeated
neighbours. Each indicator is scaled by the log-count ratio of the
classes, each row to unit length, and a linear model with squared hinge loss is fitted by
dual coordinate descent. The score is the logistic of the scaled margin.

Training takes at most ``train_rows`` labelled documents, the ones whose id hashes
lowest, so it is a sample of known size; every text is scored whole.

Defined cases: null and empty texts have no feature and get the score of the bias;
rows with a null label, or one other than 0 and 1, are not learned from; with one class or
none the score is that class's, or 0.5; repeated rows are scored alike; an
empty table gives an empty result; an existing column of a result's name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, with_arrow_columns
from .textkit import LOWER, U64, byte_values, mix, prefix_hash, slices, span_hash, text_bytes

BITS = 18
TRAIN_ROWS = 6000
_BYTES = byte_values(41)
# Kinds of bytes: 0 blank, 1 small letter, 2 capital, 3 digit, 4 and up one kind for each mark.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = np.arange(4, 98)
_KIND[97:123] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[128:] = 1


@dataclass
class QualityModel:
    weights: np.ndarray  # float32, one for each hashed feature, ratios folded in
    bias: float
    scale: float


def _hash(*parts: np.ndarray) -> np.ndarray:
    out = np.full(len(parts[0]), 0x632BE59BD9B4E019, U64)
    for p in parts:
        out = mix(out + p.astype(U64))
    return (out >> U64(64 - BITS)).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each text, end to end, and their offsets."""
    rows = len(offsets) - 1
    kind = _KIND[data]
    change = np.ones(len(kind), bool)
    change[1:] = kind[1:] != kind[:-1]
    cuts = offsets[1:-1]
    change[cuts[(cuts > 0) & (cuts < len(kind))]] = True
    at = np.flatnonzero(change)
    ends = np.append(at[1:], len(kind))
    keep = kind[at] > 0
    at, ends = at[keep], ends[keep]
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(rows + 1, np.int64)
    of = np.searchsorted(offsets, at, side="right") - 1
    token = span_hash(prefix_hash(_BYTES[LOWER[data]]), at, ends)
    shape = kind[at].astype(U64) * U64(64) + np.minimum(ends - at, 12).astype(U64)
    keys = [_hash(np.full(len(at), 1), token)]
    owners = [of]
    for n in (2, 3):
        if len(at) < n:
            continue
        same = of[n - 1 :] == of[: len(of) - n + 1]
        parts = [token[j : len(token) - n + 1 + j] for j in range(n)]
        shapes = [shape[j : len(shape) - n + 1 + j] for j in range(n)]
        where = of[: len(of) - n + 1]
        if n == 2:
            keys.append(_hash(np.full(len(where), 2), *parts)[same])
            owners.append(where[same])
        else:
            keys.append(_hash(np.full(len(where), 3), *shapes)[same])
            owners.append(where[same])
        repeated = same & (parts[0] == parts[-1])
        keys.append(_hash(np.full(len(where), 3 + n), np.minimum(shapes[0], U64(128)))[repeated])
        owners.append(where[repeated])
    joined = np.unique(np.concatenate(owners) << BITS | np.concatenate(keys))
    owner = joined >> BITS
    return joined & ((1 << BITS) - 1), np.searchsorted(owner, np.arange(rows + 1))


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, size: int, cost: float = 1.0, rounds: int = 12, tolerance: float = 1e-3, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised squared-hinge linear model; labels are -1 and 1."""
    weights, bias = np.zeros(size), 0.0
    alpha = np.zeros(len(rows))
    squares = np.array([v @ v + 1.0 for v in values]) + 0.5 / cost
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for i in order.permutation(len(rows)):
            y = labels[i]
            gradient = y * (weights[rows[i]] @ values[i] + bias) - 1.0 + alpha[i] * 0.5 / cost
            if alpha[i] == 0.0 and gradient >= 0.0:
                continue
            worst = max(worst, abs(gradient))
            now = max(alpha[i] - gradient / squares[i], 0.0)
            step, alpha[i] = (now - alpha[i]) * y, now
            weights[rows[i]] += step * values[i]
            bias += step
        if worst < tolerance:
            break
    return weights, bias


def _extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces(whole, "text"):
            data, offsets = text_bytes(batch.column("text"))
            for a, b in slices(offsets):
                keys, at = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                packed = [keys[at[i] : at[i + 1]].astype("<u4").tobytes() for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(a, b - a), pa.array(packed, pa.binary())], ["label", "features"])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", train_rows: int = TRAIN_ROWS) -> QualityModel:
    """Learn from at most ``train_rows`` labelled documents; their features, not their texts, reach the driver."""
    marked = labels.select(F.col(key).alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    # Of the labels of these documents alone, so that the bound is of rows learned from.
    learnable = marked.join(docs.select(F.col(key).alias("doc_id")).distinct(), "doc_id", "left_semi")
    chosen = learnable.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(train_rows)
    taken = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "label")
    got = taken.mapInArrow(_extract, "label int, features binary").toArrow()
    y = np.array(got.column("label").to_pylist(), float)
    rows = [np.frombuffer(x, "<u4").astype(np.int64) for x in got.column("features").to_pylist()]
    order = sorted(range(len(rows)), key=lambda i: (rows[i].tobytes(), y[i]))  # the same model whatever the order of arrival
    rows, y = [rows[i] for i in order], y[order]
    size = 1 << BITS
    if len(set(y)) < 2:
        return QualityModel(np.zeros(size, np.float32), 0.0 if not len(y) else (2.0 if y[0] else -2.0), 1.0)
    counts = np.ones((2, size))
    for row, label_of in zip(rows, y, strict=True):
        counts[int(label_of), row] += 1
    shares = counts / np.array([[np.sum(y == 0) + 2.0], [np.sum(y == 1) + 2.0]])
    ratio = np.log(shares[1] / shares[0])
    values = []
    for row in rows:
        v = ratio[row]
        values.append(v / max(1e-9, np.linalg.norm(v)))
    weights, bias = dual_coordinate_descent(rows, values, np.where(y > 0, 1.0, -1.0), size)
    return QualityModel(np.stack([weights * ratio, ratio * ratio], axis=1).astype(np.float32), bias, 2.0)


def score_batch(model: QualityModel, texts: pa.Array) -> np.ndarray:
    data, offsets = text_bytes(texts)
    margin = np.full(len(offsets) - 1, model.bias)
    if model.weights.ndim == 2:
        for a, b in slices(offsets):
            keys, at = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            full = np.flatnonzero(np.diff(at))
            if len(full):
                sums = np.add.reduceat(model.weights[keys], at[full], axis=0, dtype=np.float64)
                margin[a + full] += sums[:, 0] / np.sqrt(np.maximum(sums[:, 1], 1e-18))
    return 1.0 / (1.0 + np.exp(-np.clip(model.scale * margin, -30, 30)))


def score(spark: SparkSession, docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) for every whole text."""
    shared = spark.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> list:
        found = score_batch(shared.value, batch.column(text))
        return [found, (found >= 0.5).astype(np.int32)]

    return with_arrow_columns(docs, text, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], make)
