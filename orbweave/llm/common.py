"""Helpers shared by the training-text operators."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from ..sources.shared import cut, scratch, shared_dir

__all__ = ["cut", "let", "prepare", "release", "row_key", "scratch", "shared_dir", "slices", "table", "utf8_buffers"]

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Bounds of one Arrow batch: a worker never holds more of a column at once.
BATCH_ROWS = 512
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches and let Python workers import this package."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Let the driver drop what finished rounds of an iteration left on disk.

    Spark removes shuffle files and checkpoints once the driver has collected the objects
    that name them, which it would otherwise do every half hour.
    """
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def row_key(doc_id: Column, text: Column) -> Column:
    """A key of (doc_id, text), nulls told apart.  Rows equal in both share it."""
    return F.md5(
        F.concat(
            F.coalesce(doc_id.cast("string"), F.lit("-")),
            F.lit(":"),
            F.coalesce(F.concat(F.lit("t"), text), F.lit("")),
        )
    )


def utf8_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; nulls are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(sizes, most: int):
    """Consecutive (start, end) ranges whose sizes add up to about ``most``."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield start, len(sizes)
