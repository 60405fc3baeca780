"""Near-duplicate documents: banded MinHash, odd sketches, exact verification.

1. A text's word shingles are hashed; texts with the same shingle set form one class, so
   exact copies cost one row from here on.
   A set's hashes are 64-bit: two different shingles of the corpus share one with a
   probability of about 3e-8 in a million, and then count as one.
2. Each class gets ``BANDS`` bands of ``ROWS`` MinHash samples.  All samples are folded
   into an odd sketch, a bitmap that keeps the parity of the samples that fall on each bit.
   The population count of the XOR of two sketches estimates how many samples differ,
   and pairs far below the threshold are dropped before anything is fetched for them.
   A second odd sketch folds the whole shingle set: each shingle that only one of two sets
   has flips one bit, so the XOR never has more bits than the sets differ by, and a pair
   with more than the threshold allows is ruled out for certain.
3. Candidates come in stars, not in all pairs: each band bucket links its members to one
   pivot, which is linear in the bucket.  Verified links are contracted to components.
   A second round takes other pivots for the buckets that still hold several components.
4. What is left is exhaustive: in a bucket with several components, the members outside
   its most common component are compared with all members, in blocks of ``BLOCK`` rows
   of sketches, and the pairs that may reach the threshold are verified.
5. Links are confirmed on the full shingle sets by integer arithmetic.

With 24 bands of 4 rows a pair of similarity 0.8 shares no bucket with probability 3e-6,
one of 0.9 with 1e-11.  Null texts and texts without a word have no shingles and are linked
with nothing.  Ids are integers.  Repeated rows share one result.  A component is named by its smallest id;
one whose ids are all null has no name and its rows are kept.  Other columns of the input
are not read, so their names cannot clash.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, prepare, release, row_key, slices, table, utf8_buffers
from .graph_links import components

SHINGLE_WORDS = 5
PERCENT = 80
BANDS = 24
ROWS = 4
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
BLOCK = 128
STAR_ROUNDS = 2
#: Bytes of text whose shingles are hashed together, and shingles sampled together.
CHUNK = 1 << 20
SAMPLED = 1 << 14
#: Nodes of classes without an id lie above this.
NAMELESS = 1 << 62

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _seeds(n: int, salt: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))


_BYTE = _seeds(256, 11)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_A = _seeds(SAMPLES, 21) | np.uint64(1)
_B = _seeds(SAMPLES, 22)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's k-word shingles.

    A word's hash comes from prefix sums of its bytes times powers of an odd base; a
    shingle's from its words' hashes.  A text of fewer words is one shingle of them all.
    """
    out = []
    for a, b in slices(np.diff(offsets), CHUNK):
        at = offsets[a : b + 1]
        raw = _LOWER[data[at[0] : at[-1]]]
        at = at - at[0]
        inside = ~_SPACE[raw]
        # A text boundary also ends a word.
        edge = np.zeros(len(raw) + 1, bool)
        edge[at] = True
        before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1] if len(raw) else np.zeros(0, bool)
        start = np.flatnonzero(inside & ~before)
        after = np.concatenate([inside[1:], [False]]) & ~edge[1:] if len(raw) else np.zeros(0, bool)
        end = np.flatnonzero(inside & ~after) + 1
        prefix = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[raw] * _powers(_BASE, len(raw)), dtype=np.uint64)])
        words = _mix((prefix[end] - prefix[start]) * _powers(_INVERSE, len(raw) + 1)[start] + (end - start).astype(np.uint64))
        first = np.searchsorted(start, at)
        for i in range(b - a):
            w = words[first[i] : first[i + 1]]
            if not len(w):
                out.append(w)
                continue
            n = min(k, len(w))
            h = np.full(len(w) - n + 1, np.uint64(n))
            for j in range(n):
                h = _mix(h * _BASE + w[j : len(w) - n + 1 + j])
            out.append(np.unique(h))
    return out


def samples(shingles: np.ndarray) -> np.ndarray:
    """The smallest hash of the set under each of SAMPLES functions."""
    low = np.full(SAMPLES, np.uint64(2**64 - 1))
    for p in range(0, len(shingles), SAMPLED):
        part = shingles[p : p + SAMPLED]
        for i in range(SAMPLES):
            x = part * _A[i] + _B[i]
            low[i] = min(low[i], (x ^ (x >> np.uint64(32))).min())
    return _mix(low + _B)


def bands(low: np.ndarray) -> np.ndarray:
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = _mix(key * _BASE + low[j::ROWS])
    return key.view(np.int64)


def odd_sketch(low: np.ndarray) -> bytes:
    """A bit is set if an odd number of samples falls on it."""
    spots = (_mix(low ^ _A) % np.uint64(SKETCH_BITS)).astype(np.int64)
    return np.packbits(np.bincount(spots, minlength=SKETCH_BITS) & 1).tobytes()


def parity(shingles: np.ndarray) -> bytes:
    """The odd sketch of the whole set, in a power of two of bits that is twice its size or more."""
    bits = 1 << max(8, int(2 * len(shingles) - 1).bit_length())
    spots = (shingles & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(spots, minlength=bits) & 1).tobytes()


def _halved(sketches: np.ndarray) -> np.ndarray:
    """The sketches in half as many bits."""
    half = sketches.shape[1] // 2
    return sketches[:, :half] ^ sketches[:, half:]


def possible(x: list[bytes], y: list[bytes], sizes: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int, step: int = 4096) -> np.ndarray:
    """Which pairs (x[i], y[j]), with the sum of their set sizes, the whole-set sketches allow."""
    out = np.zeros(len(i), bool)
    nx, ny = np.array([len(b) for b in x], np.int64)[i], np.array([len(b) for b in y], np.int64)[j]
    for a, b in set(zip(nx.tolist(), ny.tolist(), strict=True)):
        rows = np.flatnonzero((nx == a) & (ny == b))
        for p in range(0, len(rows), max(1, step * 64 // max(a, b))):
            at = rows[p : p + max(1, step * 64 // max(a, b))]
            left = np.frombuffer(b"".join([x[k] for k in i[at]]), np.uint64).reshape(len(at), -1)
            right = np.frombuffer(b"".join([y[k] for k in j[at]]), np.uint64).reshape(len(at), -1)
            while left.shape[1] > right.shape[1]:
                left = _halved(left)
            while right.shape[1] > left.shape[1]:
                right = _halved(right)
            bits = np.bitwise_count(left ^ right).sum(axis=1, dtype=np.int64)
            out[at] = (100 + percent) * bits <= (100 - percent) * sizes[at]
    return out


def most_odd_bits(percent: int = PERCENT) -> int:
    """XOR bits that a pair at the threshold exceeds with a probability below 1e-8.

    The differing samples are binomial; the largest count that is likely enough sets the
    expected number of odd bits, and four deviations of the bits' own noise are added.
    """
    p, tail, n = 1 - percent / 100, 0.0, SAMPLES
    while n and tail < 1e-9:
        tail += math.comb(SAMPLES, n) * p**n * (1 - p) ** (SAMPLES - n)
        n -= 1
    half = SKETCH_BITS / 2
    bits = half * (1 - math.exp(-2 * (n + 1) / half))
    return math.ceil(bits + 4 * math.sqrt(2 * (n + 1) - bits + 1))


def describe(docs: DataFrame, shingle_words: int) -> DataFrame:
    """doc_id, key, n_shingles, digest, bands and sketches of each row of (doc_id, text, key)."""
    import hashlib

    import pyarrow as pa

    names = ["doc_id", "key", "n_shingles", "digest", "bands", "sketch", "parity"]

    def run(batches):
        for batch in batches:
            data, offsets = utf8_buffers(batch.column(1))
            for a, b in slices(np.diff(offsets), CHUNK):
                size, digest, keys, sketches, whole = [], [], [], [], []
                for s in shingle_sets(data, offsets[a : b + 1], shingle_words):
                    size.append(len(s))
                    if not len(s):
                        digest.append(None), keys.append(None), sketches.append(None), whole.append(None)
                        continue
                    low = samples(s)
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    keys.append(bands(low))
                    sketches.append(odd_sketch(low))
                    whole.append(parity(s))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(whole, pa.binary())],
                    names=names,
                )

    return docs.mapInArrow(run, "doc_id long, key binary, n_shingles long, digest binary, bands array<long>, sketch binary, parity binary")


def _close(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes and odd sketches allow the threshold."""
    import pyarrow as pa

    limit = most_odd_bits(percent)
    sized = pairs.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b", "sa", "sb", "pa", "pb", (F.col("na") + F.col("nb")).alias("size"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for i in (2, 3))
                ok = np.bitwise_count(x ^ y).sum(axis=1) <= limit
                at = np.flatnonzero(ok)
                ok[at] = possible(batch.column(4).to_pylist(), batch.column(5).to_pylist(), batch.column(6).to_numpy()[at], at, at, percent)
                ok = pa.array(ok)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

    return sized.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of those pairs, confirmed on full sets."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                ok.append(100 * same >= percent * (len(both) - same))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _with_sketches(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    one = classes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"), F.col("parity").alias("pa"))
    two = classes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"), F.col("parity").alias("pb"))
    return pairs.join(one, "a").join(two, "b")


def _ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _by_bucket(members: DataFrame, marked: DataFrame) -> DataFrame:
    """Members with what is known of their bucket.

    The bucket is joined in another form than ``marked`` was grouped by, so that both sides
    are shuffled for the join and Spark can split the members of a hot bucket.
    """
    left = members.withColumn("_b", F.struct("bucket"))
    right = marked.select(F.struct("bucket").alias("_b"), *[c for c in marked.columns if c != "bucket"])
    return left.join(right, "_b").drop("_b")


def _labelled(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members (bucket, node) of buckets with several components, and their components."""
    own = members.join(found, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    mixed = own.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("bucket")
    return _by_bucket(own, mixed)


def _stars(members: DataFrame, turn: int) -> DataFrame:
    """Pairs of each bucket's pivot with its other members; components tell them apart."""
    key = F.struct((F.xxhash64(F.lit(turn), "node") if turn else F.col("node")).alias("order"), "node", "component")
    pivots = members.groupBy("bucket").agg(F.min(key).alias("p")).select("bucket", F.col("p.node").alias("pivot"), F.col("p.component").alias("other"))
    pairs = _by_bucket(members, pivots).filter("node <> pivot and component <> other")
    return _ordered(pairs, "node", "pivot")


def _exhaustive(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Close pairs of different components in one bucket, from blocks of sketches."""
    import pyarrow as pa

    limit = most_odd_bits(percent)
    counts = members.groupBy("bucket", "component").count()
    shape = counts.groupBy("bucket").agg(F.max_by("component", F.struct("count", "component")).alias("usual"), F.max("count").alias("most"), F.sum("count").alias("all"))
    shape = shape.select(
        "bucket",
        "usual",
        F.ceil(F.col("all") / BLOCK).cast("int").alias("columns"),
        F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int").alias("rows"),
    )
    d = _by_bucket(members, shape).join(classes.select("node", "n", "sketch", "parity"), "node")
    spot = F.xxhash64(F.lit("block"), "node")
    outside = d.filter("component <> usual").withColumn("i", F.pmod(spot, "rows")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("columns") - 1)))
    every = d.withColumn("j", F.pmod(spot, "columns")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
    names = ["bucket", "i", "j", "side", "node", "component", "n", "sketch", "parity"]
    both = outside.withColumn("side", F.lit(0)).select(names).union(every.withColumn("side", F.lit(1)).select(names))
    blocks = both.groupBy("bucket", "i", "j").agg(
        F.collect_list(F.when(F.col("side") == 0, F.struct("node", "component", "n", "sketch", "parity"))).alias("x"),
        F.collect_list(F.when(F.col("side") == 1, F.struct("node", "component", "n", "sketch", "parity"))).alias("y"),
    )

    def unpack(members):
        node, component, n = (np.array([m[k] for m in members], np.int64) for k in ("node", "component", "n"))
        return node, component, n, np.frombuffer(b"".join(m["sketch"] for m in members), np.uint64).reshape(len(members), -1)

    def run(batches):
        for batch in batches:
            a, b = [], []
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not x or not y:
                    continue
                xn, xc, xs, xk = unpack(x)
                yn, yc, ys, yk = unpack(y)
                sized = 100 * np.minimum(xs[:, None], ys) >= percent * np.maximum(xs[:, None], ys)
                i, j = np.nonzero(sized & (xc[:, None] != yc))
                ok = np.bitwise_count(xk[i] ^ yk[j]).sum(axis=1) <= limit
                i, j = i[ok], j[ok]
                ok = possible([m["parity"] for m in x], [m["parity"] for m in y], xs[i] + ys[j], i, j, percent)
                a.append(np.minimum(xn[i[ok]], yn[j[ok]]))
                b.append(np.maximum(xn[i[ok]], yn[j[ok]]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return blocks.select("x", "y").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, n_shingles, component_id and kept of each row.

    ``key`` is common.row_key of the id and text, for joining back to the input.
    """
    import pyarrow as pa

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    d = d.withColumn("key", F.unhex(row_key(F.col("doc_id"), F.col("text"))))
    rows = cut(describe(d.select("doc_id", "text", "key"), shingle_words))

    nameless = F.shiftrightunsigned(F.xxhash64("digest"), 3) + F.lit(NAMELESS)
    classes = rows.filter("n_shingles > 0").groupBy("digest").agg(
        F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("first"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("parity").alias("parity")
    )
    classes = cut(classes.select(F.coalesce("least", nameless).alias("node"), F.col("first.key").alias("key"), "digest", "n", "bands", "sketch", "parity"))

    members = classes.select("node", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("c")).filter("c > 1").select("bucket")
    members = cut(members.join(shared, "bucket").select("bucket", "node"))

    wanted = members.select("node").distinct().join(classes.select("node", "key"), "node")

    def packed(batches):
        for batch in batches:
            data, offsets = utf8_buffers(batch.column(1))
            for a, b in slices(np.diff(offsets), CHUNK):
                found = [s.tobytes() for s in shingle_sets(data, offsets[a : b + 1], shingle_words)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(found, pa.binary())], names=["node", "shingles"])

    texts = d.select("key", "text").join(wanted, "key").select("node", "text").dropDuplicates(["node"])
    sets = cut(texts.mapInArrow(packed, "node long, shingles binary"))
    release(sets.sparkSession)

    links = None
    found = classes.select("node", F.col("node").alias("component")).limit(0)
    left = members.withColumn("component", F.col("node"))
    for turn in range(STAR_ROUNDS + 1):
        if turn:
            left = cut(_labelled(members, found))
            if left.isEmpty():
                break
        if turn < STAR_ROUNDS:
            close = _close(_with_sketches(_stars(left, turn), classes), percent)
        else:
            close = _exhaustive(left, classes, percent)
        fresh = _verified(close, sets, percent)
        links = cut(fresh if links is None else links.union(fresh))
        found = cut(components(links))
        release(found.sparkSession)

    named = classes.join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    out = rows.join(named, "digest", "left").select("doc_id", "key", "n_shingles", F.coalesce("component", "doc_id").alias("component"))
    out = out.withColumn("component_id", F.when(F.col("component") < NAMELESS, F.col("component")))
    return out.select("doc_id", "key", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2).drop("key")


def oracle() -> str:
    """The rows of op4_near_dup in DuckDB SQL, from all pairs that share a shingle."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, case when len(ws) = 1 then ws[1] else ws[i] || ' ' || ws[i + 1] end as g
  from (select *, unnest(range(1, greatest(len(ws), 2))) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
links as (select a, b from p join n x on a = x.doc_id join n y on b = y.doc_id where 100 * c >= {PERCENT} * (x.n + y.n - c)),
reach as (select doc_id, doc_id as r from n union select reach.doc_id, links.b from reach join links on links.a = reach.r),
least as (select doc_id, min(r) as component_id from reach group by doc_id)
select doc_id, coalesce(n.n, 0) as n_shingles, coalesce(component_id, doc_id) as component_id, coalesce(component_id, doc_id) = doc_id as kept
from documents left join n using (doc_id) left join least using (doc_id)"""
