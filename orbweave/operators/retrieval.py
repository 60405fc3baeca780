"""Memory ranking, merging of result lists and conversation contexts."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Config
from ..functions import text as T
from . import vector
from .kv import seconds


def access_stats(log: DataFrame) -> DataFrame:
    """vec_id, accesses and last_access."""
    return log.groupBy("vec_id").agg(F.count("*").alias("accesses"), F.max("ts").alias("last_access"))


def recency(last: Column, as_of: Column, days: int) -> Column:
    age = (seconds(as_of) - seconds(last)) / F.lit(days * 86400.0)
    return F.when(last.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - age))


def memory_rank(vectors: DataFrame, log: DataFrame, query, as_of: Column, config: Config, space: str = "cosine") -> DataFrame:
    """vec_id, distance, recency, importance and score of the candidates, best first (D21: similarity = 1 - distance)."""
    near = vector.knn(vectors, query, config.candidates, space)
    stats = access_stats(log)
    most = F.broadcast(stats.agg(F.max("accesses").alias("most")))
    d = near.join(stats, "vec_id", "left").crossJoin(most)  # most is one row
    importance = F.coalesce(F.col("accesses") / F.col("most"), F.lit(0.0))
    fresh = recency(F.col("last_access"), as_of, config.decay_days)
    score = (1 - F.col("distance")) * config.similarity_weight + fresh * config.recency_weight + importance * config.importance_weight
    d = d.select("vec_id", "distance", F.round(fresh, 6).alias("recency"), F.round(importance, 6).alias("importance"), F.round(score, 6).alias("score"))
    return d.orderBy(F.desc("score"), "vec_id")


def merge_union(lists: list[DataFrame]) -> DataFrame:
    out = lists[0]
    for other in lists[1:]:
        out = out.unionByName(other)
    return out


def merge_intersection(lists: list[DataFrame], key: str = "vec_id") -> DataFrame:
    """Rows of the first list whose key is in every list."""
    out = lists[0]
    for other in lists[1:]:
        out = out.join(other.select(key).distinct(), key, "left_semi")
    return out


def merge_weighted(lists: list[DataFrame], key: str = "vec_id", value: str = "score") -> DataFrame:
    """Mean value of each key over the lists (D13)."""
    return merge_union([x.select(key, value) for x in lists]).groupBy(key).agg(F.round(F.avg(value), 6).alias(value))


def merge_weighted_strict(ordered: DataFrame, key: str = "vec_id", value: str = "score", order: str = "seq") -> DataFrame:
    """The running pairwise mean (acc + x) / 2 in arrival order, as first written."""
    rows = ordered.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("xs"))
    first = F.element_at("xs", 1)[value]
    rest = F.slice(F.transform("xs", lambda x: x[value]), 2, F.greatest(F.size("xs") - 1, F.lit(0)))
    return rows.select(key, F.round(F.aggregate(rest, first, lambda acc, x: (acc + x) / 2), 6).alias(value))


def context_window(messages: DataFrame, budget: int, span: int = 256) -> DataFrame:
    """The newest messages of each conversation that fit the budget, at least one (D22).

    Tokens are summed per ``span`` turns first, and spans that newer ones already exhaust are
    left out, so one conversation with a large part of all rows is not ordered in one task.
    """
    d = messages.withColumn("tokens", T.token_estimate(F.col("text")))
    # Rows without a turn rank last.
    d = d.withColumn("_span", F.coalesce(F.floor(F.col("turn") / span), F.lit(-(2**62))))
    sums = d.groupBy("conv_id", "_span").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    newer = Window.partitionBy("conv_id").orderBy(F.desc("_span")).rowsBetween(Window.unboundedPreceding, -1)
    open_ = sums.select("conv_id", "_span", F.coalesce(F.sum("t").over(newer), F.lit(0)).alias("newer"), F.coalesce(F.sum("n").over(newer), F.lit(0)).alias("ahead"))
    open_ = open_.filter((F.col("newer") <= budget) | (F.col("ahead") == 0)).select(F.col("conv_id").alias("_conv"), F.col("_span").alias("_open"))
    d = d.join(open_, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_span") == F.col("_open")), "left_semi")
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    d = d.withColumn("used", F.sum("tokens").over(newest.rowsBetween(Window.unboundedPreceding, 0))).withColumn("back", F.row_number().over(newest))
    return d.filter((F.col("used") <= budget) | (F.col("back") == 1)).select("conv_id", "turn", "role", "text", "tokens")


def _tokens() -> Column:
    """The estimate of a message; one without a text is empty."""
    return T.token_estimate(F.coalesce("text", F.lit("")))


def _in_order(messages: DataFrame, *more: str) -> DataFrame:
    """conv_id, turn, role, text and tokens with each conversation's messages in order in one partition."""
    d = messages.withColumn("tokens", _tokens()).select("conv_id", "turn", "role", "text", "tokens", *more)
    return d.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _conversations(batches):
    """(conv_id, iterator of rows) of sorted Arrow batches; rows are read as they are asked for."""
    rows = (tuple(r) for batch in batches for r in zip(*[c.to_pylist() for c in batch.columns], strict=True))
    return itertools.groupby(rows, key=lambda r: r[0])


CONTEXT = "conv_id {}, turn {}, role string, text string, tokens long"


def _context_schema(messages: DataFrame) -> str:
    return CONTEXT.format(messages.schema["conv_id"].dataType.simpleString(), messages.schema["turn"].dataType.simpleString())


def _context_batches(rows, schema, most: int = 4096):
    import pyarrow as pa

    rows = iter(rows)
    while part := list(itertools.islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(c, schema.field(i).type) for i, c in enumerate(zip(*part, strict=True))], schema=schema)


def _arrow(messages: DataFrame):
    """The Arrow schema of a context's rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(_context_schema(messages)))


def context_window_strict(messages: DataFrame, budget: int) -> DataFrame:
    """As first written: a message that overflows the budget evicts everything before it.

    The fold over a conversation streams through its sorted messages and holds no more than
    the budget's worth of them, however long the conversation is.
    """
    schema = _arrow(messages)

    def run(batches):
        def kept():
            for _, rows in _conversations(batches):
                held, total = [], 0
                for r in rows:
                    if total + r[4] > budget:
                        held, total = [], 0
                    held.append(r)
                    total += r[4]
                yield from held

        return _context_batches(kept(), schema)

    return _in_order(messages).mapInArrow(run, _context_schema(messages))


def context_summarised(messages: DataFrame, budget: int) -> DataFrame:
    """Contexts whose two oldest messages are merged into a summary until they fit.

    Totals come from an aggregate, so that one pass in order knows when the rest fits; it
    holds the summary and two messages.  Of two messages that do not fit the newer stays.
    """
    sums = messages.groupBy("conv_id").agg(F.sum(_tokens()).alias("all"), F.count("*").alias("n"))
    same = messages.withColumnRenamed("conv_id", "_conv")
    d = same.join(sums, F.col("_conv").eqNullSafe(F.col("conv_id"))).drop("_conv")
    schema = _arrow(messages)

    def short(text: str | None) -> str:
        text = text or ""
        return text if len(text) <= 50 else text[:50] + "..."

    def run(batches):
        def kept():
            for _, rows in _conversations(batches):
                first = next(rows)
                head, used, left = first[:5], first[5], first[6]
                for r in rows:
                    if used <= budget:
                        yield head
                        head = r[:5]
                        continue
                    if left > 2:
                        text = f"[Summarized: {short(head[3])} + {short(r[3])}]"
                        tokens = len(text.encode()) // 4 + 1
                        used += tokens - head[4] - r[4]
                        head = (head[0], head[1], "system", text, tokens)
                    else:  # two are left: the older goes
                        used -= head[4]
                        head = r[:5]
                    left -= 1
                yield head

        return _context_batches(kept(), schema)

    return _in_order(d, "all", "n").mapInArrow(run, _context_schema(messages))


def context_lines(messages: DataFrame) -> DataFrame:
    """conv_id, turn and each message as a "role: text" line: the rendering of a context of any length."""
    return messages.select("conv_id", "turn", F.concat_ws(": ", "role", "text").alias("line"))


def context_text(messages: DataFrame) -> DataFrame:
    """conv_id and its messages as "role: text" lines in one string; for contexts, which a budget bounds."""
    rows = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("ms"))
    return rows.select("conv_id", F.array_join(F.transform("ms", lambda m: F.concat_ws(": ", m["role"], m["text"])), "\n").alias("context"))
