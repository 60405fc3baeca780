"""Media columns: texts as 8-bit WAV, spectra and peak-pair fingerprints.

A text's UTF-8 bytes, padded with zeros to a positive multiple of 64, are written by the
wave module as unsigned 8-bit mono samples and read back from the stored bytes.  The
samples pass through a short-time Fourier transform in blocks of frames; each frame's
strongest local peak is an anchor and is paired with the peaks of the following frames.
A pair is stored as a hash (anchor bin, target bin, distance in frames) with the anchor's
frame as its time code, in two arrays of the same length, ordered by time.

A null text is empty and gives 64 zero bytes; silence has no peaks and so an empty
fingerprint.  Equal texts give equal values.  Ids may be null or repeated; other columns
are not read.  Every row is handled by itself, in blocks of ``BLOCK`` frames, so memory is
bounded by the longest text and nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, slices, table

RATE = 8000
FRAME = 256
HOP = 128
BLOCK = 2048
#: Following frames that an anchor is paired with.
FAN = 3
#: Decimals of a magnitude, so that rounding noise cannot decide between peaks.
DECIMALS = 3
PAD = 64
#: Characters of text whose media are returned together.
CHUNK = 1 << 20


def payload(text: str | None) -> tuple[bytes, int]:
    """Padded bytes and the length before padding."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % PAD if raw else PAD), len(raw)


def to_wav(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not 8-bit mono")
        return w.readframes(w.getnframes())


def peaks(samples: bytes) -> np.ndarray:
    """The strongest local peak bin of each frame, -1 where a frame has none."""
    x = np.frombuffer(samples, np.uint8)
    if len(x) < FRAME:
        x = np.concatenate([x, np.zeros(FRAME - len(x), np.uint8)])
    n = 1 + -(-(len(x) - FRAME) // HOP)
    if (n - 1) * HOP + FRAME > len(x):
        x = np.concatenate([x, np.zeros((n - 1) * HOP + FRAME - len(x), np.uint8)])
    window = np.hanning(FRAME).astype(np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    out = np.empty(n, np.int32)
    for a in range(0, n, BLOCK):
        f = frames[a : a + BLOCK].astype(np.float32)
        f -= f.mean(axis=1, keepdims=True)
        m = np.round(np.abs(np.fft.rfft(f * window, axis=1)), DECIMALS)
        inner = m[:, 1:-1]
        local = np.where((inner > m[:, :-2]) & (inner >= m[:, 2:]), inner, 0)
        best = local.argmax(axis=1)
        strength = np.take_along_axis(local, best[:, None], 1)[:, 0]
        out[a : a + BLOCK] = np.where(strength > 0, best + 1, -1)
    return out


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Time codes (int32) and pair hashes (int32), ordered by time, then distance."""
    p = peaks(samples)
    times, hashes = [], []
    for d in range(1, FAN + 1):
        a, b = p[:-d], p[d:]
        t = np.flatnonzero((a >= 0) & (b >= 0))
        times.append(t)
        hashes.append((a[t] << 16) | (b[t] << 4) | d)
    t, h = np.concatenate(times), np.concatenate(hashes)
    order = np.lexsort((h & 15, t))
    return t[order].astype(np.int32), h[order].astype(np.int32)


def _describe(text: str | None) -> tuple[bytes, bytes, int, np.ndarray, np.ndarray]:
    """(stored media, payload read back, unpadded length, time codes, hashes)."""
    data, n = payload(text)
    media = to_wav(data)
    back = from_wav(media)
    return media, back, n, *fingerprint(back)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (WAV bytes), fp_time and fp_hash of each row."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices([len(t or "") for t in texts], CHUNK):
                media, _, n, t, h = zip(*map(_describe, texts[a:b]), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(media, pa.binary()), pa.array(t, pa.list_(pa.int32())), pa.array(h, pa.list_(pa.int32()))],
                    names=["doc_id", "n_bytes", "media", "fp_time", "fp_hash"],
                )

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary, fp_time array<int>, fp_hash array<int>")


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The figures of media_columns() with the stored bytes as digests.

    ``feature`` is frames:pairs:sha256 over the little-endian time codes and hashes.
    """
    import pyarrow as pa

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def row(text):
        media, back, n, t, h = _describe(text)
        shape = 1 + max(0, -(-(len(back) - FRAME) // HOP))
        digest = hashlib.sha256(t.astype("<i4").tobytes() + h.astype("<i4").tobytes()).hexdigest()
        return (
            n,
            len(back),
            hashlib.sha256(back).hexdigest(),
            zlib.crc32(back[-PAD:]),
            len(media),
            hashlib.sha256(media).hexdigest(),
            f"{shape}:{len(t)}:{digest}",
        )

    def run(batches):
        for batch in batches:
            rows = [row(t) for t in batch.column(1).to_pylist()]
            cols = [pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", *names])

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(
        run,
        f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return media_digests(table(spark, sf_dir, "documents"))
