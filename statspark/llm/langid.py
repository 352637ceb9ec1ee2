"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of one, two and three characters in 2**16 buckets.
``fit`` learns from at most about ``per_class`` labelled texts of each language,
drawn by a hash of the text; the counts are summed by Spark, and only the
finished table (languages x buckets) reaches the driver. Scoring gathers rows of the
broadcast log-probability matrix for all n-grams of a bounded batch and sums
them by document.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
rows with a null label are not learned from; a model without any language calls
every text ``und``; an empty table gives an empty result; repeated rows are
judged alike; a tie goes to the alphabetically first language; an existing
column of the name of a result is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal, pieces, with_arrow_columns
from .textkit import U64, slices, text_bytes

BUCKET_BITS = 16
ORDERS = (1, 2, 3)
UNKNOWN = "und"
PER_CLASS = 4000
#: Bytes of text scored at a time; each takes about 150 bytes of arrays.
SLICE = 30_000

_FOLD = np.array([ord(c) if len(c := chr(i).lower()) == 1 else i for i in range(0x250)], np.uint32)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # buckets x languages, float32
    priors: np.ndarray


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Buckets at each character for each order (-1 where the text ends sooner), and offsets in characters."""
    lead = (data & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(lead)])[offsets]
    code = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    code = np.where(code < 0x250, _FOLD[np.minimum(code, 0x24F)], code).astype(U64)
    out = []
    key = np.zeros(len(code), U64)
    ends = chars[1:][np.diff(chars) > 0]
    starts = chars[:-1][np.diff(chars) > 0]
    for n in ORDERS:
        if n > 1:
            shifted = np.zeros(len(code), U64)
            shifted[: len(code) - n + 1] = code[n - 1 :]
        else:
            shifted = code
        key = (key + shifted + U64(1)) * U64(0x9E3779B97F4A7C15)
        bucket = ((key ^ (key >> U64(29))) * U64(0xBF58476D1CE4E5B9) >> U64(64 - BUCKET_BITS)).astype(np.int64)
        for k in range(1, n):
            at = ends - k
            bucket[at[at >= starts]] = -1
        out.append(bucket)
    return out, chars


def _count(batches):
    """Sparse n-gram counts of a partition by language."""
    totals: dict[str, np.ndarray] = {}
    for whole in batches:
        for batch in pieces(whole, "text"):
            labels = np.array(batch.column("lang").to_pylist(), object)
            data, offsets = text_bytes(batch.column("text"))
            for a, b in slices(offsets, SLICE):
                grams, chars = _grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                owner = np.repeat(np.arange(a, b), np.diff(chars))
                for label in set(labels[a:b]):
                    mine = (labels == label)[owner]
                    into = totals.setdefault(label, np.zeros(1 << BUCKET_BITS, np.int64))
                    for bucket in grams:
                        chosen = bucket[mine]
                        into += np.bincount(chosen[chosen >= 0], minlength=1 << BUCKET_BITS)
    for label, counts in totals.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["lang", "bucket", "n"])


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", per_class: int = PER_CLASS) -> LanguageModel:
    """Learn every label, from about ``per_class`` of its rows; the model grows with the labels only."""
    rows = labelled.select(F.col(text).alias("text"), F.col(label).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").count().orderBy("lang").collect()
    if not sizes:
        return LanguageModel([], np.zeros((1 << BUCKET_BITS, 0), np.float32), np.zeros(0))
    share: Column = F.lit(0.0)
    for r in sizes:
        share = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, per_class / r["count"]))).otherwise(share)
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * (1 << 20)
    counts = rows.where(draw).mapInArrow(frugal(_count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    table = np.full((1 << BUCKET_BITS, len(languages)), 0.1)
    column = {x: i for i, x in enumerate(languages)}
    table[counts["bucket"].to_numpy(int), counts["lang"].map(column).to_numpy(int)] += counts["n"].to_numpy(float)
    logs = np.log(table / table.sum(axis=0))
    known = {r["lang"]: r["count"] for r in sizes}
    priors = np.array([known[x] for x in languages], float)
    return LanguageModel(languages, (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32), np.log(priors / priors.sum()))


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    seen = np.concatenate([[0], np.cumsum(_LETTER[data])])
    found = seen[offsets[1:]] > seen[offsets[:-1]]
    for i in np.flatnonzero(~found & (offsets[1:] > offsets[:-1])):
        found[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def score_batch(model: LanguageModel, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    data, offsets = text_bytes(texts)
    rows = len(offsets) - 1
    total = np.zeros((rows, len(model.languages)))
    length = np.ones(rows)
    letters = np.zeros(rows, bool)
    for a, b in slices(offsets, SLICE):
        local, piece = offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]
        letters[a:b] = _has_letter(piece, local)
        if not len(piece) or not len(model.languages):
            continue
        grams, chars = _grams(piece, local)
        full = np.flatnonzero(np.diff(chars))
        length[a:b] = np.maximum(1, np.diff(chars))
        for bucket in grams:
            part = model.weights[bucket]
            part[bucket < 0] = 0
            total[a + full] += np.add.reduceat(part, chars[full], axis=0, dtype=np.float64)
    if not len(model.languages):
        return [UNKNOWN] * rows, np.zeros(rows)
    # The evidence of neighbouring n-grams overlaps, so it is tempered by the root of the length.
    level = (total + model.priors) / np.sqrt(length)[:, None]
    level = np.exp(level - level.max(axis=1, keepdims=True))
    best = total.argmax(axis=1)
    share = level[np.arange(rows), best] / level.sum(axis=1)
    names = [model.languages[k] if ok else UNKNOWN for k, ok in zip(best, letters, strict=True)]
    return names, np.where(letters, share, 0.0)


def detect(spark: SparkSession, docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` for every whole text."""
    shared = spark.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> list:
        return list(score_batch(shared.value, batch.column(text)))

    return with_arrow_columns(docs, text, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], make)


def reject(detected: DataFrame, min_score: float = 0.0) -> DataFrame:
    """Rows whose language is known and whose score reaches the least one."""
    return detected.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score))
