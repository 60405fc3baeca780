"""Nearest neighbours, upserts and deletes on vector tables (vec_id, embedding, ...)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType
from pyspark.sql.window import Window

from ..config import FLOAT_DIGITS, Config
from ..errors import DimensionError
from ..functions import vectors as V


def _live(vectors: DataFrame) -> DataFrame:
    return vectors.filter("deleted is not true") if "deleted" in vectors.columns else vectors


def knn(vectors: DataFrame, query, k: int, space: str = "cosine", where: Column | None = None, dimension: int | None = None) -> DataFrame:
    """vec_id and distance of the k nearest live vectors, nearest first, ties by id.

    Filters and tombstones apply below the distance, so k rows remain where there are as
    many (D16).  Top-k is taken per task before anything is shuffled; distances are
    rounded only after it.
    """
    if dimension is not None and len(query) != dimension:
        raise DimensionError(f"query has {len(query)} components, the table {dimension}")
    live = _live(vectors)
    if where is not None:
        live = live.filter(where)
    live = live.filter(F.size("embedding") == len(query))
    scored = live.select("vec_id", V.distance_to(F.col("embedding"), query, space).alias("distance"))
    return scored.orderBy("distance", "vec_id").limit(k).withColumn("distance", F.round("distance", FLOAT_DIGITS))


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int, space: str = "cosine", most_bytes: int = Config.broadcast_bytes) -> DataFrame:
    """query_id, vec_id, distance and rank of the k nearest vectors of each of a stated set of queries.

    Queries (query_id, embedding) are shipped in blocks of at most ``most_bytes`` of
    components; beyond one block the vectors are read once per block.  A task keeps its k
    best per query, so queries x k x tasks rows are shuffled and no vector is.
    """
    return _ranked([_near(_live(vectors), block, k, space) for block in _blocks(queries, most_bytes)], vectors, k)


def _blocks(queries: DataFrame, most_bytes: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The ids and components of the queries, a block at a time."""
    size = queries.agg(F.count("*"), F.max(F.size("embedding"))).first()
    count = max(1, -(-(size[0] * (size[1] or 0) * 8) // most_bytes))
    for i in range(count):
        part = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(count)) == i) if count > 1 else queries
        found = part.select("query_id", "embedding").collect()
        if found:
            yield np.array([r[0] for r in found], np.int64), np.array([r[1] for r in found], np.float64)


def _ranked(near: list[DataFrame], vectors: DataFrame, k: int) -> DataFrame:
    if not near:
        return vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, distance double, rank long")
    out = near[0]
    for other in near[1:]:
        out = out.union(other)
    best = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    out = out.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= k)
    return out.withColumn("distance", F.round("distance", FLOAT_DIGITS))


def _matrix(column) -> np.ndarray:
    """An Arrow array of equally long arrays as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def _distances(q: np.ndarray, v: np.ndarray, space: str) -> np.ndarray:
    if space == "cosine":
        return 1 - q @ v.T / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1) + V.EPSILON)
    if space != "euclidean":
        raise ValueError(f"unknown space {space!r}; known are {', '.join(V.SPACES)}")
    return np.sqrt(np.maximum((q**2).sum(1)[:, None] + (v**2).sum(1) - 2 * q @ v.T, 0))


class _Best:
    """The k best (distance, id) of each query so far."""

    def __init__(self, n: int, k: int):
        self.k, self.d, self.v = k, np.full((n, 0), np.inf), np.zeros((n, 0), np.int64)

    def add(self, a: int, d: np.ndarray, ids: np.ndarray) -> None:
        """Distances of queries a and following; infinite ones do not count."""
        b = a + len(d)
        if self.d.shape[1] < self.k:
            room = self.k - self.d.shape[1]
            self.d = np.pad(self.d, ((0, 0), (0, room)), constant_values=np.inf)
            self.v = np.pad(self.v, ((0, 0), (0, room)), constant_values=np.iinfo(np.int64).max)
        d = np.concatenate([self.d[a:b], d], axis=1)
        v = np.concatenate([self.v[a:b], np.broadcast_to(ids, (b - a, ids.shape[-1]))], axis=1)
        if d.shape[1] > 8 * self.k:  # all that ties with the k-th best stays for the exact order
            worst = np.partition(d, self.k - 1, axis=1)[:, self.k - 1 : self.k]
            width = int((d <= worst).sum(axis=1).max(initial=self.k))
            near = np.argpartition(d, min(width, d.shape[1] - 1), axis=1)[:, :width]
            d, v = np.take_along_axis(d, near, 1), np.take_along_axis(v, near, 1)
        order = np.lexsort((v, d))[:, : self.k]
        self.d[a:b], self.v[a:b] = np.take_along_axis(d, order, 1), np.take_along_axis(v, order, 1)

    def rows(self, ids: np.ndarray):
        import pyarrow as pa

        at, col = np.nonzero(np.isfinite(self.d))
        return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(self.v[at, col]), pa.array(self.d[at, col])], names=["query_id", "vec_id", "distance"])


def _near(rows: DataFrame, block: tuple[np.ndarray, np.ndarray], k: int, space: str, step: int = 512) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        ids, q = shared.value
        best = _Best(len(ids), k)
        for batch in batches:
            if batch.num_rows:
                v, own = _matrix(batch.column(1)), batch.column(0).to_numpy()
                for a in range(0, len(ids), step):
                    best.add(a, _distances(q[a : a + step], v, space), own)
        yield best.rows(ids)

    same = rows.filter(F.size("embedding") == block[1].shape[1])
    return same.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "query_id long, vec_id long, distance double")


# Approximate search: random-hyperplane sketches, then exact distances.

SKETCH_BITS = 512
#: Rows of the nearest sketches whose distances set the first bound, as a multiple of k.
PROBES = 16
#: Standard deviations that a neighbour's sketch may lie beyond its expected place.
SLACK = 2.5


def hyperplanes(dimension: int, bits: int = SKETCH_BITS, seed: int = 42) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dimension, bits))


def sketched(vectors: DataFrame, dimension: int, bits: int = SKETCH_BITS, seed: int = 42) -> DataFrame:
    """The table with ``sketch``: one sign bit for each random hyperplane, 64 to a long.

    Every row of the dimension is indexed; nothing is fitted to the data.
    """
    import pyarrow as pa

    planes = hyperplanes(dimension, bits, seed)
    rows = vectors.filter(F.size("embedding") == dimension)
    at, names = rows.columns.index("embedding"), [*rows.columns, "sketch"]

    def run(batches):
        for batch in batches:
            signs = np.packbits(_matrix(batch.column(at)) @ planes > 0, axis=1)
            words = pa.array(np.ascontiguousarray(signs).view(np.int64).ravel(), pa.int64())
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * (bits // 64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, words)], names=names)

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("sketch", ArrayType(LongType()))]))


def most_bits(distance: np.ndarray, bits: int, slack: float = SLACK) -> np.ndarray:
    """Differing bits that a vector at a cosine distance stays below but for slack deviations.

    Two vectors differ in a bit with probability angle / pi, so the count is binomial
    whatever the data; a neighbour is missed with the normal tail probability of slack.
    """
    p = np.arccos(np.clip(1 - distance, -1, 1)) / math.pi
    return bits * p + slack * np.sqrt(bits * np.maximum(p * (1 - p), 0)) + 1e-9


def knn_sketched(index: DataFrame, queries: DataFrame, k: int, bits: int = SKETCH_BITS, seed: int = 42, slack: float = SLACK, most_bytes: int = Config.broadcast_bytes) -> DataFrame:
    """Approximate knn_batch() in cosine space over ``sketched()`` rows, with ``compared``.

    Of each Arrow batch some rows of the nearest sketches are compared first; with the
    k-th best distance so far, only rows whose sketch may lie within it are.  A task has
    no cap on candidates: rows are left out by their sketch alone.  ``compared`` is the
    number of exact distances that the row's task took for the query.
    """
    near = [_near_sketched(_live(index), block, k, bits, seed, slack) for block in _blocks(queries, most_bytes)]
    if not near:
        return index.sparkSession.createDataFrame([], "query_id long, vec_id long, distance double, rank long, compared long")
    out = near[0]
    for other in near[1:]:
        out = out.union(other)
    taken = out.groupBy("query_id", "task").agg(F.max("compared").alias("c")).groupBy("query_id").agg(F.sum("c").alias("compared"))
    best = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    found = out.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= k)
    return found.join(taken, "query_id").select("query_id", "vec_id", F.round("distance", FLOAT_DIGITS).alias("distance"), "rank", taken["compared"])


def _near_sketched(rows: DataFrame, block, k: int, bits: int, seed: int, slack: float, step: int = 64) -> DataFrame:
    ids, q = block
    signs = np.packbits(q @ hyperplanes(q.shape[1], bits, seed) > 0, axis=1)
    shared = rows.sparkSession.sparkContext.broadcast((ids, q, np.ascontiguousarray(signs).view(np.uint64)))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        ids, q, own = shared.value
        best, compared = _Best(len(ids), k), np.zeros(len(ids), np.int64)
        sizes = np.linalg.norm(q, axis=1)
        for batch in batches:
            if not batch.num_rows:
                continue
            v, names = _matrix(batch.column(1)), batch.column(0).to_numpy()
            norms = np.linalg.norm(v, axis=1)
            words = batch.column(2).flatten().to_numpy().view(np.uint64).reshape(len(names), -1)
            for a in range(0, len(ids), step):
                part = slice(a, min(a + step, len(ids)))
                apart = np.bitwise_count(own[part, None] ^ words[None]).sum(axis=2, dtype=np.int32)
                worst = best.d[part, -1] if best.d.shape[1] == k else np.full(len(apart), np.inf)
                for i in range(len(apart)):
                    exact = lambda at: 1 - v[at] @ q[a + i] / (norms[at] * sizes[a + i] + V.EPSILON)  # noqa: B023, E731
                    first = np.argpartition(apart[i], min(PROBES * k, len(names)) - 1)[: PROBES * k]
                    bound = min(worst[i], np.partition(exact(first), k - 1)[k - 1] if len(first) >= k else np.inf)
                    at = np.flatnonzero(apart[i] <= most_bits(np.array(bound if np.isfinite(bound) else 2.0), bits, slack))
                    compared[a + i] += len(np.union1d(at, first))
                    best.add(a + i, exact(at)[None], names[at][None])
        found = best.rows(ids)
        at = np.searchsorted(np.sort(ids), found.column(0).to_numpy())
        count = compared[np.argsort(ids)][at]
        task = np.full(found.num_rows, TaskContext.get().partitionId(), np.int64)
        yield pa.RecordBatch.from_arrays([*found.columns, pa.array(count), pa.array(task)], names=["query_id", "vec_id", "distance", "compared", "task"])

    same = rows.filter(F.size("embedding") == q.shape[1])
    return same.select(F.col("vec_id").cast("long"), "embedding", "sketch").mapInArrow(run, "query_id long, vec_id long, distance double, compared long, task long")


def latest(log: DataFrame, key: str = "vec_id", order: str = "created") -> DataFrame:
    """The last write of each key by ``order``, nulls first; a newer row also undeletes (D17).

    Rows of one key and order are ordered by their other columns.
    """
    rest = [c for c in log.columns if c != key and not log.schema[c].dataType.simpleString().startswith("map")]
    by = F.struct(*[F.col(c) for c in ([order] if order in log.columns else []) + rest])
    last = log.groupBy(key).agg(F.max_by(F.struct(*[c for c in log.columns if c != key]), by).alias("r"))
    return last.select(key, "r.*").select(*log.columns)


def upsert(vectors: DataFrame, rows: DataFrame, config: Config, order: str = "created") -> DataFrame:
    """The table with rows inserted or replaced, all of the configured dimension.

    Of several rows of one id the last by ``order`` counts.
    """
    bad = rows.filter(F.col("embedding").isNull() | (F.size("embedding") != config.dimension)).select("vec_id").limit(1).collect()
    if bad:
        raise DimensionError(f"vector {bad[0][0]} does not have {config.dimension} components")
    rows = latest(rows, order=order)
    kept = vectors.join(rows.select("vec_id"), "vec_id", "left_anti")
    return kept.unionByName(rows, allowMissingColumns=True)


def delete(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """Marks ids (vec_id) as deleted; deleting twice changes nothing."""
    gone = ids.select("vec_id", F.lit(True).alias("_gone")).distinct()
    rows = vectors if "deleted" in vectors.columns else vectors.withColumn("deleted", F.lit(False))
    return rows.join(gone, "vec_id", "left").withColumn("deleted", F.coalesce("deleted", F.lit(False)) | F.coalesce("_gone", F.lit(False))).drop("_gone")
