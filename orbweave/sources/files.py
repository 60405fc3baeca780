"""Files and folders through the file system that Spark uses for a path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, bytes) of what a folder holds."""
    fs, p = _fs(spark, path)
    return [(s.getPath().getName(), s.getLen()) for s in fs.listStatus(p)] if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.delete(p, True)


def rename(spark: SparkSession, source: str, target: str) -> bool:
    fs, p = _fs(spark, source)
    return fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(target))


def compact(spark: SparkSession, source: str, target: str, small_bytes: int, file_bytes: int = 128 * 2**20) -> int:
    """Rewrites a table that has files below small_bytes into full ones; the number of files written (D27)."""
    files = [n for name, n in children(spark, source) if name.endswith(".parquet")]
    if not any(n < small_bytes for n in files):
        return 0
    count = max(1, -(-sum(files) // file_bytes))
    spark.read.parquet(source).coalesce(count).write.mode("overwrite").parquet(target)
    return count


def write_rows(df: DataFrame, path: str, rows_per_file: int = 0) -> None:
    df.write.option("maxRecordsPerFile", rows_per_file).mode("append").parquet(path)
