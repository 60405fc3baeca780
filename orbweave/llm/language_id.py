"""Language identification by the nearest of several centroids per language.

A text becomes the TF-IDF vector of its hashed character n-grams (one to three characters
of its lower-cased letters, words bounded by a space), with logarithmic counts and unit
length.  Each language's sampled vectors are clustered by spherical k-means, and a text is
given the language of the centroid with the largest cosine.  A best cosine below the
language's distance limit, which the training texts set, marks the text ``rejected``; its
nearest language is still reported.

Fitting takes at most about ``TRAIN_PER_LANGUAGE`` labelled texts of each language, drawn by
a hash of their ids; nothing is learnt from other rows, and language, source and id are no
inputs of a prediction.  A null text or one without a letter is ``und`` with score 0, as is
every text when nothing was learnt.  Ids may be null or repeated; other columns of the
input are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, slices, table

BUCKETS = 4096
TRAIN_PER_LANGUAGE = 600
CLUSTERS = 3
#: Share of the training texts whose own cosine may lie below the distance limit.
REJECTED_SHARE = 0.005
UNKNOWN = "und"
#: Characters that are turned into n-grams together, and texts that share a count table.
CHUNK = 1 << 18
ROWS = 256


def _letters(code: np.ndarray) -> np.ndarray:
    """Whether each code point is a letter."""
    out = ((code >= 97) & (code <= 122)) | ((code >= 65) & (code <= 90))
    high = np.flatnonzero(code > 127)
    if len(high):
        distinct, back = np.unique(code[high], return_inverse=True)
        out[high] = np.array([chr(c).isalpha() for c in distinct])[back]
    return out


def _count_into(table: np.ndarray, rows: np.ndarray, code: np.ndarray, fresh: np.ndarray) -> None:
    """Add the 1- to 3-gram buckets of code points (each with its row) that end on a fresh one to table."""
    c = code.astype(np.uint64)
    width = table.shape[1]
    gram = c.copy()
    for n in (1, 2, 3):
        if n > 1:
            gram = gram[:-1] * np.uint64(1_000_003) + c[n - 1 :]
        x = (gram + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        bucket = (x >> np.uint64(64 - 12)).astype(np.int64) % width
        own = rows[: len(bucket)]
        inside = (own == rows[n - 1 :]) & fresh[n - 1 :]
        table += np.bincount(own[inside] * width + bucket[inside], minlength=table.size).reshape(table.shape)


def count_ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x BUCKETS) counts, and which texts have a letter."""
    counts = np.zeros((len(texts), BUCKETS), np.float32)
    lettered = np.zeros(len(texts), bool)
    sizes = [len(t) if t else 0 for t in texts]
    for a, b in slices(sizes, CHUNK):
        for c, d in slices([1] * (b - a), ROWS):
            rows, codes, fresh = [], [], []
            part = np.zeros((d - c, BUCKETS), np.float32)

            def flush(rows=rows, codes=codes, fresh=fresh, part=part):
                if codes:
                    _count_into(part, *map(np.concatenate, (rows, codes, fresh)))
                    rows.clear(), codes.clear(), fresh.clear()

            for i in range(a + c, a + d):
                # The last two code points of a piece are carried into the next, and counted once.
                text, tail = texts[i] or "", np.array([32], np.uint32)
                known = 0
                for p in range(0, max(len(text), 1), CHUNK):
                    code = np.frombuffer(text[p : p + CHUNK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
                    letter = _letters(code)
                    lettered[i] |= bool(letter.any())
                    code = np.where(letter, code, 32)
                    if p + CHUNK >= len(text):
                        code = np.concatenate([code, [32]])
                    code = code[(code != 32) | (np.concatenate([tail[-1:], code[:-1]]) != 32)]
                    piece = np.concatenate([tail, code])
                    codes.append(piece)
                    rows.append(np.full(len(piece), i - a - c))
                    fresh.append(np.arange(len(piece)) >= known)
                    tail = piece[-2:]
                    known = len(tail)
                    if sum(map(len, codes)) > CHUNK:
                        flush()
            flush()
            counts[a + c : a + d] = part
    return counts, lettered


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF rows."""
    v = np.log1p(counts) * idf
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm > 0, norm, 1)


def cluster(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, started from the rows farthest from one another."""
    centroids = [v.mean(axis=0)]
    centroids[0] /= max(np.linalg.norm(centroids[0]), 1e-12)
    for _ in range(min(k, len(v)) - 1):
        centroids.append(v[np.argmin((v @ np.array(centroids).T).max(axis=1))])
    c = np.array(centroids)
    for _ in range(rounds):
        own = (v @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (own == j).any():
                m = v[own == j].sum(axis=0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return c


def fit(labelled: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> dict:
    """The model from rows of (doc_id, text, lang); null languages and texts are left out."""
    import pyarrow as pa

    rows = labelled.filter("lang is not null and text is not null")
    sizes = dict(rows.groupBy("lang").count().collect())
    if not sizes:
        return {"languages": []}
    shares = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / n))])
    drawn = (F.xxhash64(F.lit("draw"), F.col("doc_id")) / F.lit(2.0**64)) + 0.5
    sample = rows.filter(drawn < shares[F.col("lang")]).select("text", "lang")

    def run(batches):
        for batch in batches:
            for a, b in slices([1] * batch.num_rows, 64):
                counts, lettered = count_ngrams(batch.column(0).slice(a, b - a).to_pylist())
                at = [np.flatnonzero(c).astype(np.int32) for c in counts]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1).slice(a, b - a),
                        pa.array(lettered),
                        pa.array(at, pa.list_(pa.int32())),
                        pa.array([c[i].astype(np.float32) for c, i in zip(counts, at, strict=True)], pa.list_(pa.float32())),
                    ],
                    names=["lang", "lettered", "bucket", "n"],
                )

    found = [
        (r["lang"], np.array(r["bucket"]), np.array(r["n"], np.float32))
        for r in sample.mapInArrow(run, "lang string, lettered boolean, bucket array<int>, n array<float>").filter("lettered").toLocalIterator()
    ]
    found.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes(), r[2].tobytes()))
    if not found:
        return {"languages": []}
    seen = np.zeros(BUCKETS)
    for _, at, _ in found:
        seen[at] += 1
    idf = (np.log((1 + len(found)) / (1 + seen)) + 1).astype(np.float32)
    languages, owner, centroids, limits = sorted({r[0] for r in found}), [], [], []
    for k, lang in enumerate(languages):
        own = [r for r in found if r[0] == lang]
        v = np.zeros((len(own), BUCKETS), np.float32)
        for i, (_, at, n) in enumerate(own):
            v[i, at] = n
        v = weigh(v, idf)
        c = cluster(v, CLUSTERS)
        centroids.append(c)
        owner += [k] * len(c)
        limits.append(float(np.quantile((v @ c.T).max(axis=1), REJECTED_SHARE)))
    return {"languages": languages, "owner": np.array(owner), "centroids": np.concatenate(centroids).astype(np.float32), "limits": np.array(limits), "idf": idf}


def classify(model: dict, texts: list[str | None]) -> list[tuple[str, float, bool]]:
    """(language, cosine, rejected) of each text."""
    counts, lettered = count_ngrams(texts)
    if not model["languages"]:
        return [(UNKNOWN, 0.0, True)] * len(texts)
    cosines = weigh(counts, model["idf"]) @ model["centroids"].T
    best = cosines.argmax(axis=1)
    score = np.clip(cosines[np.arange(len(texts)), best], 0, 1)
    own = model["owner"][best]
    return [
        (model["languages"][k], float(s), bool(s < model["limits"][k])) if ok else (UNKNOWN, 0.0, True)
        for k, s, ok in zip(own, score.astype(float).round(6), lettered, strict=True)
    ]


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and rejected of each row."""
    import pyarrow as pa

    # The model is a few hundred KB whatever the input: languages x CLUSTERS x BUCKETS.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for a, b in slices([1] * batch.num_rows, ROWS):
                found = classify(shared.value, batch.column(1).slice(a, b - a).to_pylist())
                lang, score, rejected = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                    names=["doc_id", "lang_pred", "score", "rejected"],
                )

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    found = predict(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
