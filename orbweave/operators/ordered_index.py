"""A multimap of keys to value ids as a sorted table (key, value_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(index: DataFrame, key) -> DataFrame:
    return index.filter(F.col("key") == key).groupBy("key").agg(F.sort_array(F.collect_list("value_id")).alias("value_ids"))


def range_scan(index: DataFrame, start, end) -> DataFrame:
    """Keys from start to end, both included, in order, with all their ids."""
    return index.filter(F.col("key").between(start, end)).groupBy("key").agg(F.sort_array(F.collect_list("value_id")).alias("value_ids")).orderBy("key")


def delete(index: DataFrame, pairs: DataFrame) -> DataFrame:
    """The index without the given (key, value_id) pairs, all equal ones."""
    return index.join(pairs.select("key", "value_id").distinct(), ["key", "value_id"], "left_anti")


def rebuild(index: DataFrame, path: str, partitions: int | None = None) -> None:
    """Writes the index range-partitioned and sorted, so that scans prune by file and row group."""
    parts = [partitions] if partitions else []
    index.repartitionByRange(*parts, "key").sortWithinPartitions("key", "value_id").write.mode("overwrite").parquet(path)


def fragmentation(index: DataFrame, target_rows: int) -> DataFrame:
    """files, rows and 1 - rows / (files x target_rows) of a stored index."""
    files = index.groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n"))
    out = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
    return out.withColumn("fragmentation", F.when(F.col("files") > 0, F.round(1 - F.col("rows") / (F.col("files") * target_rows), 6)).otherwise(0.0))
