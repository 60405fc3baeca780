"""Streaming forms of the change log, the access counters and the conversation contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions import text as T
from ..sources.files import children


def access_counts(stream: DataFrame) -> DataFrame:
    """vec_id, accesses and last_access; for update or complete mode."""
    return stream.groupBy("vec_id").agg(F.count("*").alias("accesses"), F.max("ts").alias("last_access"))


def windowed_counts(stream: DataFrame, width: str, late: str, key: str = "event_type") -> DataFrame:
    """Extension: event-time windows with a watermark for late rows."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def kv_updates(stream: DataFrame) -> DataFrame:
    """The last write of each key, as the log (k, seq, ts, v, ttl, op) arrives; for update or complete mode.

    The aggregate state holds one row per key and merges partial maxima before the shuffle.
    """
    return stream.groupBy("k").agg(F.max_by(F.struct("v", "ttl", "ts", "seq", "op"), F.struct("ts", "seq")).alias("r")).select("k", "r.*")


class LiveKey(StatefulProcessor):
    """The last write of a key, until it is deleted or its time to live has passed in event time.

    Emits a row per change: the write, or the expiry at the moment the watermark passes it;
    the state of a key that is gone is dropped.
    """

    def init(self, handle):
        self.handle = handle
        self.state = handle.getValueState("last", "ts_us long, seq long, ttl long")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        held = tuple(self.state.get()) if self.state.exists() else None
        best, fresh = (held[:2] if held else None), None
        for pdf in rows:
            for r in pdf.itertuples():
                at = (int(r.ts_us), int(r.seq))
                if best is None or at > best:
                    best, fresh = at, (r.v, int(r.ttl), at[0], at[1], r.op)
        if not fresh:
            return
        if held and held[2]:
            self.handle.deleteTimer((held[0] + held[2] * 1_000_000) // 1000)
        self.state.update((*best, fresh[1]))
        if fresh[1] and fresh[4] != "delete":
            self.handle.registerTimer((best[0] + fresh[1] * 1_000_000) // 1000)
        yield pd.DataFrame([(key[0], *fresh)], columns=["k", "v", "ttl", "ts_us", "seq", "op"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        if self.state.exists():
            ts_us, seq, ttl = self.state.get()
            self.state.clear()
            yield pd.DataFrame([(key[0], None, int(ttl), int(ts_us), int(seq), "expire")], columns=["k", "v", "ttl", "ts_us", "seq", "op"])

    def close(self):
        pass


def kv_live(stream: DataFrame, late: str) -> DataFrame:
    """Changes of the live keys, with expiries in event time; writes later than ``late`` may come too late.

    A key's state goes when its time to live has passed, so the state holds live keys and
    tombstones only.  Needs a state store with column families (RocksDB).
    """
    d = stream.select("k", "v", F.col("ttl").cast("long"), F.col("ts").cast("timestamp").alias("ts"), "seq", "op").withWatermark("ts", late)
    d = d.withColumn("ts_us", F.unix_micros("ts"))
    return d.groupBy("k").transformWithStateInPandas(LiveKey(), "k string, v string, ttl long, ts_us long, seq long, op string", "Update", "EventTime")


class Context(StatefulProcessor):
    """The messages of a conversation that fit its budget, at least the newest."""

    budget = 4096

    def init(self, handle):
        self.messages = handle.getListState("messages", "turn long, role string, text string, tokens long")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        held = [tuple(m) for m in self.messages.get()] if self.messages.exists() else []
        for pdf in rows:
            held += [(int(r.turn), r.role, r.text, int(r.tokens)) for r in pdf.itertuples()]
        held.sort()
        used, first = 0, len(held)
        for i in range(len(held) - 1, -1, -1):
            used += held[i][3]
            if used > self.budget and i < len(held) - 1:
                break
            first = i
        held = held[first:]
        self.messages.put(held)
        yield pd.DataFrame([(key[0], *m) for m in held], columns=["conv_id", "turn", "role", "text", "tokens"])

    def close(self):
        pass


def contexts(stream: DataFrame, budget: int) -> DataFrame:
    """Each conversation's context after every batch that adds to it."""
    processor = Context()
    processor.budget = budget
    d = stream.select("conv_id", "turn", "role", "text", T.token_estimate(F.col("text")).alias("tokens"))
    return d.groupBy("conv_id").transformWithStateInPandas(processor, "conv_id long, turn long, role string, text string, tokens long", "Update", "None")


def drain(out: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Runs a stream until its source is exhausted; its result, which executors write below ``folder``.

    Each micro-batch is a folder of its own, written again if the batch runs again.  In
    complete mode the last one is the result, otherwise all of them are.
    """
    spark = out.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = out.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    found = sorted((int(n.partition("=")[2]), n) for n, _ in children(spark, f"{folder}/out") if n.startswith("batch="))
    if not found:
        return spark.createDataFrame([], out.schema)
    return spark.read.schema(out.schema).parquet(*[f"{folder}/out/{n}" for _, n in (found[-1:] if mode == "complete" else found)])
