"""The folder that driver and executors share, and results that are computed once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; a temporary folder only where one machine runs everything."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir()
    if folder is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="orbweave-")
        sc.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession) -> str:
    """A new name below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/orbweave-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and stored in the shared folder, without its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def numbered(df: DataFrame, *order, name: str = "rank", start: int = 0) -> DataFrame:
    """``df`` with its position in the given order, from start + 1 on.

    The rows are dealt into ranges, sorted and stored once; only then is each range's size
    counted and its rows numbered, so both readings see the same rows in the same ranges
    however often the plan runs.  No task sees more than one range.
    """
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)
    # One row for each range, which the session's partition count bounds.
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = F.broadcast(sizes.select("_part", before.alias("_before")))
    own = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    ranked = ranged.withColumn("_part", part).join(sizes, "_part")
    return ranked.withColumn(name, (own + F.col("_before") + F.lit(start + 1)).cast("long")).drop("_at", "_part", "_before")
