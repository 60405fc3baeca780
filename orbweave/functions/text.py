"""Tokenizers, token estimates and text embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the hash embedding: its width, the FNV-1a constants and the fold of a hash.
DIMENSIONS = 384
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
FOLD = 2000
BYTE_DIMENSIONS = 128

EMBEDDING_TOKEN = r"([\p{IsAlphabetic}\p{N}']+|[^\p{IsWhite_Space}])"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: A run without white space, from its first letter or digit to its last.
INDEX_TERM = r"[\p{IsAlphabetic}\p{N}](?:[^\p{IsWhite_Space}]*[\p{IsAlphabetic}\p{N}])?"


def index_terms(text: Column) -> Column:
    """Lower-cased words without outer punctuation, of two bytes or more."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(INDEX_TERM), F.lit(0)), lambda w: F.octet_length(w) >= 2)


def counted(values: Column) -> Column:
    """value and n of the distinct values of an array, in order: the runs of the sorted array."""

    def runs(s: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))

        def measured(h: Column) -> Column:
            return F.transform(h, lambda at, k: F.struct(F.get(s, at).alias("value"), (F.coalesce(F.get(h, k + 1), F.size(s)) - at).cast("long").alias("n")))

        return let(heads, measured)

    none = F.array().cast("array<struct<value:string,n:bigint>>")
    return F.when(F.size(values) == 0, none).otherwise(let(F.array_sort(values), runs))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, even where body repeats it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def embedding_tokens(text: Column) -> Column:
    """Words in ASCII lower case and single marks."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(EMBEDDING_TOKEN), F.lit(1))


def bpe_tokens(tokens: Column, vocabulary_size: int) -> Column:
    """Tokens as they are if short for the vocabulary, else in chunks of two characters."""

    def split(t: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(1), F.length(t), F.lit(2)), lambda i: F.substring(t, i, F.lit(2)))
        whole = (F.octet_length(t) <= 2) | (F.length(t) - 1 <= vocabulary_size // 2)
        return F.when(whole, F.array(t)).otherwise(pieces)

    return F.flatten(F.transform(tokens, split))


def token_estimate(text: Column) -> Column:
    return (F.floor(F.octet_length(text) / 4) + 1).cast("long")


def shortened(text: Column, most: int = 50) -> Column:
    """The first characters and an ellipsis (D29: never cut inside a character)."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit("...")))


def safe_key(key: Column) -> Column:
    """A key as a file name: slashes as underscores, no NUL."""
    return F.replace(F.regexp_replace(key, r"[/\\]", "_"), F.lit("\x00"), F.lit(""))


def fnv1a(tokens: list[str], start: np.ndarray | None = None) -> np.ndarray:
    """64-bit FNV-1a of each token, all tokens together byte by byte."""
    raw = [t.encode() for t in tokens]
    size = np.array([len(r) for r in raw], np.int64)
    out = np.full(len(raw), FNV_OFFSET, np.uint64) if start is None else start.copy()
    for j in range(int(size.max(initial=0))):
        live = np.flatnonzero(size > j)
        byte = np.array([raw[i][j] for i in live], np.uint64)
        out[live] = (out[live] ^ byte) * np.uint64(FNV_PRIME)
    return out


def token_matrix(tokens: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """(tokens x dimensions) thousandths in [-1000, 1000) from the hash of "token_component"."""
    states = np.repeat(fnv1a([t + "_" for t in tokens])[:, None], dimensions, axis=1)
    digits = [str(j).encode() for j in range(dimensions)]
    for k in range(max(map(len, digits))):
        live = np.array([len(d) > k for d in digits])
        byte = np.array([d[k] for d in digits if len(d) > k], np.uint64)
        states[:, live] = (states[:, live] ^ byte) * np.uint64(FNV_PRIME)
    return ((states % np.uint64(FOLD)).astype(np.int64) - 1000).astype(np.int16)


class TokenVectors:
    """Vectors of tokens, each made once and kept; the store starts anew beyond ``most`` tokens."""

    def __init__(self, dimensions: int = DIMENSIONS, most: int = 1 << 16, block: int = 1024):
        self.dimensions, self.most, self.block = dimensions, most, block
        self.at: dict[str, int] = {}
        self.rows = np.zeros((0, dimensions), np.int16)

    def places(self, tokens: list[str]) -> np.ndarray:
        """Rows of distinct tokens."""
        fresh = [t for t in tokens if t not in self.at]
        if fresh and len(self.at) + len(fresh) > self.most:
            self.at, self.rows, fresh = {}, np.zeros((0, self.dimensions), np.int16), tokens
        if fresh:
            need = len(self.at) + len(fresh)
            if need > len(self.rows):
                grown = np.zeros((max(need, 2 * len(self.rows)), self.dimensions), np.int16)
                grown[: len(self.rows)] = self.rows
                self.rows = grown
            for a in range(0, len(fresh), self.block):
                part, at = fresh[a : a + self.block], len(self.at)
                self.rows[at : at + len(part)] = token_matrix(part, self.dimensions)
                self.at.update((t, at + i) for i, t in enumerate(part))
        return np.fromiter((self.at[t] for t in tokens), np.int64, len(tokens))


_vectors: dict[int, TokenVectors] = {}


def hash_embeddings(token_lists, dimensions: int = DIMENSIONS) -> list[np.ndarray]:
    """Unit vectors of token lists; each list has a vocabulary of its own (D20), no token gives zeros."""
    known, out = _vectors.setdefault(dimensions, TokenVectors(dimensions)), []
    for tokens in token_lists:
        ids: dict[str, int] = {}
        at = np.array([ids.setdefault(t, len(ids)) for t in (tokens if tokens is not None else [])], np.int64)
        v = np.zeros(dimensions)
        if len(at):
            counts = np.bincount(at, minlength=len(ids))
            weights = counts / counts.max() * (np.log((len(ids) + 1) / (np.arange(len(ids)) + 2)) + 1)
            words = list(ids)
            for a in range(0, len(words), known.most):
                part = words[a : a + known.most]
                places = known.places(part)
                for b in range(0, len(part), known.block):
                    v += weights[a + b : a + b + known.block][: len(part) - b] @ known.rows[places[b : b + known.block]].astype(np.float64)
        size = np.linalg.norm(v)
        out.append((v / size if size > 0 else v).astype(np.float32))
    return out


def byte_embedding(text: str | None) -> list[float]:
    """Bytes folded onto BYTE_DIMENSIONS components, as a unit vector."""
    raw = np.frombuffer((text or "").encode(), np.uint8) / 255.0
    v = np.bincount(np.arange(len(raw)) % BYTE_DIMENSIONS, weights=raw, minlength=BYTE_DIMENSIONS)
    size = np.linalg.norm(v)
    return (v / size if size > 0 else v).astype(np.float32).tolist()


def embed_text(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Hash embeddings of a text column, an Arrow batch at a time."""

    @F.arrow_udf("array<float>")
    def run(tokens: pa.Array) -> pa.Array:
        return pa.array(hash_embeddings((t.as_py() for t in tokens), dimensions), pa.list_(pa.float32()))

    return run(embedding_tokens(text))


def embed_bytes(text: Column) -> Column:
    @F.arrow_udf("array<float>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([byte_embedding(t.as_py()) for t in texts], pa.list_(pa.float32()))

    return run(text)
