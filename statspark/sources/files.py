"""Parquet in, result.json and data.parquet out."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ROW_ID, OperatorError, ErrorCode, Result

SUFFIXES = (".parquet", ".pq")


def read_table(spark: SparkSession, path: str, row_ids: bool = True) -> DataFrame:
    """A Parquet file or folder; with ``row_ids`` rows carry their place in the files, in file order.

    Places are file number and row index from the reader's metadata, so they are
    the same for any partitioning and cost no shuffle.
    """
    if not path.rstrip("/").endswith(SUFFIXES):
        raise OperatorError(ErrorCode.DATA_ERROR, "input must be Parquet", suffixes=list(SUFFIXES))
    df = spark.read.parquet(path)
    if not row_ids:
        return df
    files = sorted({f.path if hasattr(f, "path") else f for f in df.inputFiles()})
    if len(files) == 1:
        return df.withColumn(ROW_ID, F.col("_metadata.row_index"))
    numbers = spark.createDataFrame([(f.rsplit("/", 1)[-1], i) for i, f in enumerate(files)], "__file string, __number long")
    placed = df.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__index"))
    numbered = placed.join(F.broadcast(numbers), "__file")  # one row a file
    return numbered.withColumn(ROW_ID, F.shiftleft(F.col("__number"), 40) + F.col("__index")).drop("__file", "__number", "__index")


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside the target, then rename, through the file system of the path."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    part = jvm.org.apache.hadoop.fs.Path(path + ".part")
    stream = system.create(part, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    system.delete(target, False)
    if not system.rename(part, target):
        raise OperatorError(ErrorCode.INTERNAL_ERROR, "result could not be put in place")


def write_result(spark: SparkSession, folder: str, result: Result) -> dict[str, Any]:
    """data.parquet (if the operator returned a table), then result.json, which marks success."""
    folder = folder.rstrip("/")
    if result.data is not None:
        result.data.write.mode("overwrite").parquet(f"{folder}/data.parquet")
    body = {"status": "success", "result": result.to_dict()}
    _write_text(spark, f"{folder}/result.json", json.dumps(body, ensure_ascii=False, allow_nan=False, indent=1))
    return body


def write_error(spark: SparkSession, folder: str, error: OperatorError) -> dict[str, Any]:
    body = {"status": "error", "error": error.payload()}
    _write_text(spark, f"{folder.rstrip('/')}/result.json", json.dumps(body, ensure_ascii=False, allow_nan=False, indent=1))
    return body
