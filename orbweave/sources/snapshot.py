"""Versioned snapshots of all tables: one folder each, committed by its metadata row."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import NotFoundError
from .files import children, exists, remove


META = "snapshot_id string, created string, counts map<string,long>, lsn long"


def create(spark: SparkSession, root: str, tables: dict[str, DataFrame], at: str, most: int | None = None, snapshot_id: str | None = None, lsn: int = 0) -> str:
    """Writes every table and then the metadata, which makes the snapshot visible.

    ``lsn`` is the last log entry that the tables contain.
    """
    name = snapshot_id or f"snap-{uuid.uuid4().hex[:12]}"
    for table, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/{table}")
    counts = {t: spark.read.parquet(f"{root}/{name}/{t}").count() for t in tables}
    meta = spark.createDataFrame([(name, at, counts, lsn)], META)
    meta.coalesce(1).write.mode("overwrite").json(f"{root}/{name}/_meta.json")
    if most:
        prune(spark, root, most)
    return name


def listing(spark: SparkSession, root: str) -> DataFrame:
    """snapshot_id, created, counts and lsn, newest first; folders without metadata are unfinished."""
    found = [f"{root}/{n}/_meta.json" for n, _ in children(spark, root) if exists(spark, f"{root}/{n}/_meta.json")]
    rows = spark.read.schema(META).json(found) if found else spark.createDataFrame([], META)
    return rows.orderBy(F.desc("created"), F.desc("snapshot_id"))


def latest(spark: SparkSession, root: str) -> str:
    row = listing(spark, root).first()
    if row is None:
        raise NotFoundError(f"no snapshot in {root}")
    return row["snapshot_id"]


def restore(spark: SparkSession, root: str, snapshot_id: str) -> dict[str, DataFrame]:
    if not exists(spark, f"{root}/{snapshot_id}/_meta.json"):
        raise NotFoundError(f"no snapshot {snapshot_id}")
    return {n: spark.read.parquet(f"{root}/{snapshot_id}/{n}") for n, _ in children(spark, f"{root}/{snapshot_id}") if not n.startswith("_")}


def prune(spark: SparkSession, root: str, most: int) -> list[str]:
    """Removes all but the newest; the removed ids.  The list has one row per snapshot."""
    gone = [r["snapshot_id"] for r in listing(spark, root).collect()[most:]]
    for name in gone:
        remove(spark, f"{root}/{name}")
    return gone
