"""The write-ahead log as a folder of batches (lsn, op, layer, entity_key, payload, crc).

A batch is a folder that names its first and last sequence number.  It is written under a
name that readers skip and renamed when it is whole, so a failed append leaves nothing and
the last number is known from the names alone.  Inside a batch rows lie by segment, a fixed
range of numbers, which is what truncation removes.  One writer appends to a log at a time.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import children, remove, rename
from .shared import numbered

SCHEMA = "lsn long, op string, layer string, entity_key string, payload string, crc long"
SEGMENT_ENTRIES = 1_000_000
_BATCH = re.compile(r"batch=(\d+)-(\d+)-(\w+)$")


def checksum() -> Column:
    """CRC-32 over sequence number, operation, layer, key and payload."""
    parts = F.concat_ws("\x01", F.col("lsn").cast("string"), "op", "layer", "entity_key", F.coalesce("payload", F.lit("")))
    return F.crc32(parts.cast("binary"))


def batches(spark: SparkSession, path: str) -> list[tuple[int, int, str]]:
    """(first number, last number, folder name) of each batch, in order."""
    found = [(m, name) for name, _ in children(spark, path) if (m := _BATCH.match(name))]
    return sorted((int(m[1]), int(m[2]), name) for m, name in found)


def last_lsn(spark: SparkSession, path: str) -> int:
    """The largest sequence number given, 0 for an empty log; no row is read."""
    return max((last for _, last, _ in batches(spark, path)), default=0)


def _commit(rows: DataFrame, path: str, first: int, last: int, segment_entries: int) -> None:
    spark = rows.sparkSession
    pending = f"{path}/_new-{uuid.uuid4().hex}"
    d = rows.withColumn("crc", checksum()).withColumn("segment", F.floor(F.col("lsn") / segment_entries))
    d.write.partitionBy("segment").parquet(pending)
    if not rename(spark, pending, f"{path}/batch={first:020d}-{last:020d}-{uuid.uuid4().hex[:8]}"):
        raise OSError(f"could not commit a batch to {path}")


def append(rows: DataFrame, path: str, first_lsn: int | None = None, segment_entries: int = SEGMENT_ENTRIES) -> int:
    """Appends (op, layer, entity_key, payload, seq) in order of seq; the last number given.

    Rows of one seq are numbered in order of their other columns.  The rows are stored once
    before they are numbered, see ``numbered``.
    """
    spark = rows.sparkSession
    start = last_lsn(spark, path) if first_lsn is None else first_lsn - 1
    d = numbered(rows.select("op", "layer", "entity_key", "payload", "seq"), "seq", "layer", "entity_key", "op", "payload", name="lsn", start=start)
    last = d.agg(F.max("lsn")).first()[0]
    if last is None:
        return start
    _commit(d.select("lsn", "op", "layer", "entity_key", "payload"), path, start + 1, last, segment_entries)
    return last


def append_entries(spark: SparkSession, path: str, entries: list[tuple], segment_entries: int = SEGMENT_ENTRIES) -> int:
    """Appends a few (op, layer, entity_key, payload) tuples of the driver as one file; the last number given."""
    start = last_lsn(spark, path)
    if not entries:
        return start
    rows = [(start + i + 1, *e) for i, e in enumerate(entries)]
    _commit(spark.createDataFrame(rows, SCHEMA.rsplit(",", 1)[0]).coalesce(1), path, start + 1, start + len(rows), segment_entries)
    return start + len(rows)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All entries with their segment, damaged ones too."""
    found = [f"{path}/{name}" for _, _, name in batches(spark, path)]
    schema = SCHEMA + ", segment long"
    return spark.read.schema(schema).option("basePath", path).parquet(*found).drop("batch") if found else spark.createDataFrame([], schema)


def replay(spark: SparkSession, path: str, after: int = 0) -> DataFrame:
    """Entries beyond ``after`` whose checksum holds; others are skipped."""
    return read(spark, path).filter((F.col("lsn") > after) & (F.col("crc") == checksum()))


def tail(spark: SparkSession, path: str) -> DataFrame:
    """The log as a stream: valid entries as their batches are committed."""
    stream = spark.readStream.schema(SCHEMA).option("basePath", path).parquet(f"{path}/batch=*/segment=*")
    return stream.filter(F.col("crc") == checksum()).select(*[c.split()[0] for c in SCHEMA.split(", ")])


def last_entries(log: DataFrame) -> DataFrame:
    """The last operation of each (layer, entity_key), deletes too."""
    last = log.groupBy("layer", "entity_key").agg(F.max_by(F.struct("lsn", "op", "payload"), "lsn").alias("r"))
    return last.select("layer", "entity_key", "r.*")


def compacted(log: DataFrame) -> DataFrame:
    """The last operation of each (layer, entity_key), without deleted ones (D26)."""
    return last_entries(log).filter(F.col("op") != "delete")


def rewrite(spark: SparkSession, path: str, segment_entries: int = SEGMENT_ENTRIES, layers: list[str] | None = None) -> int:
    """Replaces all batches by one with the last operation of each key; the number of entries that went.

    Deletes stay, because a snapshot older than the log may hold what they remove.  Layers
    that are not named (if any are) keep all their entries.  Entries keep their numbers.  A
    reader between the commit and the removal sees entries twice.
    """
    old = batches(spark, path)
    if not old:
        return 0
    entries = replay(spark, path)
    before = entries.count()
    merged = entries if layers is None else entries.filter(F.col("layer").isin(layers))
    names = ["lsn", "op", "layer", "entity_key", "payload"]
    kept = last_entries(merged).select(names)
    if layers is not None:
        kept = kept.unionByName(entries.filter(~F.col("layer").isin(layers)).select(names))
    _commit(kept, path, old[0][0], old[-1][1], segment_entries)
    for _, _, name in old:
        remove(spark, f"{path}/{name}")
    return before - read(spark, path).count()


def retained(log: DataFrame, segments: int) -> DataFrame:
    """Entries of the newest segments."""
    newest = F.broadcast(log.agg(F.max("segment").alias("newest")))
    return log.join(newest, F.col("segment") > F.col("newest") - segments).drop("newest")


def truncate(spark: SparkSession, path: str, segments: int, upto: int, segment_entries: int = SEGMENT_ENTRIES) -> int:
    """Removes the folders of segments that are neither among the newest nor reach beyond ``upto``; how many went.

    The newest segment stays, and with it the last number.
    """
    held = [(int(s.partition("=")[2]), f"{path}/{name}", s) for _, _, name in batches(spark, path) for s, _ in children(spark, f"{path}/{name}") if s.startswith("segment=")]
    newest = max((k for k, _, _ in held), default=0)
    gone = [(folder, s) for k, folder, s in held if k <= newest - max(1, segments) and (k + 1) * segment_entries - 1 <= upto]
    for folder, s in gone:
        remove(spark, f"{folder}/{s}")
    for folder in {f for f, _ in gone}:
        if not any(s.startswith("segment=") for s, _ in children(spark, folder)):
            remove(spark, folder)
    return len(gone)
