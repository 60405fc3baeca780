"""The key-value store as a view over its change log (seq, ts, k, v, ttl, op)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..errors import LimitError
from ..functions.text import safe_key
from ..sources.shared import numbered


def seconds(ts: Column) -> Column:
    return F.unix_timestamp(ts.cast("timestamp"))


def live(as_of: Column) -> Column:
    """Not expired at as_of; a ttl of 0 never expires."""
    return (F.col("ttl") == 0) | (seconds(as_of) - seconds(F.col("ts")) < F.col("ttl"))


def last_writes(log: DataFrame) -> DataFrame:
    """The last operation on each key, whatever it was; one row per key and task is shuffled."""
    last = log.groupBy("k").agg(F.max_by(F.struct("v", "ttl", "ts", "seq", "op"), F.struct("ts", "seq")).alias("r"))
    return last.select("k", "r.*")


def current(log: DataFrame, as_of: Column) -> DataFrame:
    """k, v, ttl, ts and seq of the live keys."""
    return last_writes(log).filter((F.col("op") != "delete") & live(as_of)).drop("op")


def get(log: DataFrame, key: str, as_of: Column) -> DataFrame:
    return current(log.filter(F.col("k") == key), as_of)


def expired(log: DataFrame, as_of: Column) -> DataFrame:
    """Keys whose last write has outlived its ttl."""
    return last_writes(log).filter((F.col("op") != "delete") & ~live(as_of)).drop("op")


def tiers(log: DataFrame, as_of: Column, config: Config, touches: DataFrame | None = None) -> DataFrame:
    """Live keys with their rank by recency (latest first, then key) and tier (D23).

    A key's recency is its last write or a later touch (k, ts), which is how keys are promoted.
    Ranks are counted over ranges of recency, so no task sees all keys.
    """
    rows = current(log, as_of).withColumn("used", F.col("ts"))
    if touches is not None:
        last = touches.groupBy("k").agg(F.max("ts").alias("touched"))
        rows = rows.join(last, "k", "left").withColumn("used", F.greatest("ts", "touched")).drop("touched")
    ranked = numbered(rows, F.desc("used"), F.col("k"))
    tier = F.when(F.col("rank") <= config.hot_capacity, "hot").when(F.col("rank") <= config.hot_capacity + config.warm_capacity, "warm").otherwise("cold")
    return ranked.select("k", "v", "ttl", "ts", "rank", tier.alias("tier"))


def store_tiers(ranked: DataFrame, path: str) -> None:
    """Writes tiers() by tier, sorted by key; a cold entry also has the name it may be exported under."""
    d = ranked.withColumn("name", safe_key(F.col("k")))
    d.repartitionByRange("tier", "k").sortWithinPartitions("tier", "k").write.mode("overwrite").partitionBy("tier").parquet(path)


def tiered_get(spark: SparkSession, path: str, key: str, as_of: Column) -> DataFrame:
    """k, v and tier of a live key in stored tiers; only row groups that may hold the key are read."""
    found = spark.read.parquet(path).filter(F.col("k") == key)
    return found.filter(live(as_of)).select("k", "v", "tier")


def check_limits(rows: DataFrame, config: Config) -> None:
    """Raises for the first key or value beyond its limit."""
    bad = rows.filter((F.octet_length("k") > config.max_key_bytes) | (F.octet_length("v") > config.max_value_bytes)).select("k").limit(1).collect()
    if bad:
        raise LimitError(f"key or value too large at key {bad[0][0][:80]!r}")


def purge(log: DataFrame, as_of: Column, days: int) -> DataFrame:
    """The log without rows that are older than the retention and no longer a key's last write."""
    keep = last_writes(log).select("k", F.col("seq").alias("_last"))
    old = seconds(as_of) - seconds(F.col("ts")) > days * 86400
    return log.join(keep, "k").filter(~old | (F.col("seq") == F.col("_last"))).drop("_last")
