"""Spark helpers of the text operators: Arrow maps, shared scratch tables, checked broadcasts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager, suppress
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows up to which a narrow table (under about 100 bytes a row) is sent to every executor.
BROADCAST_ROWS = 500_000
#: Bytes of text handed to one kernel call.
PIECE_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local one only where none is configured."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    jsc = spark.sparkContext._jsc.sc()
    if configured:
        if jsc.getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if jsc.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="statspark-"))
    return jsc.getCheckpointDir().get()


class Scratch:
    """Intermediate tables in the shared folder, deleted together when an operator has its result."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.top = spark, f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
        self.made = 0

    def table(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.top}/{self.made}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.top)
        path.getFileSystem(conf).delete(path, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def spread(df: DataFrame) -> DataFrame:
    """A scanned table dealt out evenly where its files make fewer parts than there are cores; a small shuffle, as few parts mean few bytes."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run inside hand Python at most so many rows at a time, for rows that are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def settled(df: DataFrame) -> DataFrame:
    """The rows cut from their lineage, kept in the shared folder until nothing refers to them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sized(df: DataFrame, limit: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """Hint a broadcast if the counted rows (or their summed weight) stay within the limit; else Spark shuffles."""
    if weight is not None:
        return F.broadcast(df) if (df.agg(F.sum(weight)).first()[0] or 0) <= limit else df
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def merged_runs(runs: Column) -> Column:
    """Sorted runs [s, e) with overlapping and touching ones joined."""
    done = F.array().cast("array<struct<s:int,e:int>>")

    def closed(acc: Column) -> Column:
        return F.when(acc["e"] > 0, F.concat(acc["done"], F.array(F.struct(acc["s"].alias("s"), acc["e"].alias("e"))))).otherwise(acc["done"])

    def step(acc: Column, r: Column) -> Column:
        longer = F.struct(acc["done"].alias("done"), F.when(acc["e"] == 0, r["s"]).otherwise(acc["s"]).alias("s"), F.greatest(acc["e"], r["e"]).alias("e"))
        return F.when(r["s"] <= acc["e"], longer).otherwise(F.struct(closed(acc).alias("done"), r["s"].alias("s"), r["e"].alias("e")))

    return F.aggregate(runs, F.struct(done.alias("done"), F.lit(0).alias("s"), F.lit(0).alias("e")), step, closed)


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with bounded bytes in a text column."""
    texts = batch.column(column)
    total = texts.nbytes
    if total <= limit or batch.num_rows <= 1:
        yield batch
        return
    step = max(1, int(batch.num_rows * limit / total))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def frugal(function: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], held: int = 1 << 17) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """An Arrow map that gives freed memory back to the system: large arrays at once, the rest when a task ends, as workers live on.

    ``held`` bytes are kept in the task: arrays of an eighth of it are then not mapped anew, page by page, each time.
    """

    @wraps(function)
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with suppress(AttributeError, OSError):
            ctypes.CDLL(None).mallopt(-3, max(1 << 18, held // 8))  # M_MMAP_THRESHOLD
            ctypes.CDLL(None).mallopt(-1, held)  # M_TRIM_THRESHOLD
        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(AttributeError, OSError):
                ctypes.CDLL(None).malloc_trim(0)

    return run


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def with_arrow_columns(df: DataFrame, text: str, fields: list[T.StructField], make: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """Append columns computed from bounded Arrow pieces; a column of the same name is replaced."""
    names = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in names]
    if text.lower() in names:
        raise ValueError(f"{text} would be replaced")
    order = [f.name for f in kept]
    kinds = [arrow_type(f.dataType) for f in fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, text):
                new = [x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(make(batch), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in order), *new], [*order, *(f.name for f in fields)])

    return df.select(*(F.col(f"`{n}`") for n in order)).mapInArrow(frugal(run), T.StructType([*kept, *fields]))
