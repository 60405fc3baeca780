"""Token counts: pieces are counted once per distinct pre-token.

1. Texts become per-document pre-token frequencies.  A block of documents (about ``BLOCK``
   characters) names each of its distinct pre-tokens once, and keeps the frequencies as
   compressed (pre-token, frequency) rows per document.
2. The pre-tokens of all blocks are dealt by pre-token and sorted, so each distinct one of
   the corpus comes in one run, and its pieces are counted once.
3. The counts are joined back to the blocks, and a document's tokens are the sum of
   frequency x pieces.  No id is ever materialised.

A pre-token has one row per block that holds it, however often it occurs, so a word of all
documents weighs no more than any other of the same blocks.  A block is the most that a task
holds at once; a longer text is a block of its own.

A null text counts as empty.  Ids may be null or repeated: each row is counted by itself.
Only the id and text columns are read, so other names cannot clash.
"""

from __future__ import annotations

import pickle
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table
from .word_pieces import WordVocabulary, vocabulary

LIMIT = 2048
#: Characters of text whose documents share a block.
BLOCK = 16 << 20


def frequencies(vocab: WordVocabulary, text: str) -> tuple[Counter, int]:
    """How often each pre-token (byte-mapped) occurs in a text, and the special strings."""
    found: Counter = Counter()
    special = 0
    for token, part in vocab.segments(text):
        if token is not None:
            special += 1
            continue
        words, mapped = vocab.pre_tokens(part)
        counted = Counter(words)
        if mapped:
            found.update(counted)
        else:
            for word, n in counted.items():
                found[vocab.mapped(word)] += n
    return found, special


def n_pieces(vocab: WordVocabulary, word: str) -> int:
    return len(vocab.tokenizer.model.tokenize(word))


def _planes(values: np.ndarray) -> bytes:
    """32-bit values by byte significance, which compresses better."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _values(planes: bytes) -> np.ndarray:
    return np.frombuffer(planes, np.uint8).reshape(4, -1).T.copy().view("<u4")[:, 0].astype(np.int64)


class Block:
    """Documents whose frequencies share one list of distinct pre-tokens."""

    def __init__(self, vocab: WordVocabulary):
        self.vocab, self.characters = vocab, 0
        self.words: dict[str, int] = {}
        self.special: list[int] = []
        self.sizes: list[int] = []
        self.steps: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, text: str) -> None:
        found, special = frequencies(self.vocab, text)
        words = self.words
        at = np.fromiter((words.setdefault(w, len(words)) for w in found), np.int64, len(found))
        order = np.argsort(at)
        self.steps.append(np.diff(at[order], prepend=0))
        self.times.append(np.fromiter(found.values(), np.int64, len(found))[order])
        self.sizes.append(len(found))
        self.special.append(special)
        self.characters += len(text)

    def packed(self, rows: bytes) -> bytes:
        """The block as one value; ``rows`` is what the caller keeps about its documents."""
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        joined = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
        # No pre-token holds a line break.
        sections = ["\n".join(self.words).encode(), rows, *[_planes(np.asarray(x, np.int64)) for x in (self.sizes, self.special, joined(self.steps), joined(self.times))]]
        return pickle.dumps([pack(s) for s in sections])


def block_words(packed: bytes) -> list[str]:
    import zstandard

    joined = zstandard.ZstdDecompressor().decompress(pickle.loads(packed)[0]).decode()
    return joined.split("\n") if joined else []


def block_totals(packed: bytes, pieces: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The caller's rows and the tokens of each document, given the pieces of each of the block's words."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    _, rows, *rest = map(unpack, pickle.loads(packed))
    sizes, special, steps, times = map(_values, rest)
    ends = np.cumsum(sizes)
    # Steps start anew with every document.
    run = np.concatenate([[0], np.cumsum(steps)])
    at = run[1:] - np.repeat(run[ends - sizes], sizes)
    sums = np.concatenate([[0], np.cumsum(pieces[at] * times)])
    return rows, sums[ends] - sums[ends - sizes] + special


def blocks(docs: DataFrame, tokenizer: str, size: int = BLOCK) -> DataFrame:
    """block (an id) and packed of (doc_id, text, n_bytes)."""
    import pyarrow as pa

    def run(batches):
        vocab = vocabulary(tokenizer)
        block, ids, n_bytes = Block(vocab), [], []

        def close():
            rows = pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.concat_arrays(n_bytes)], names=["doc_id", "n_bytes"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as w:
                w.write_batch(rows)
            return pa.RecordBatch.from_arrays([pa.array([block.packed(sink.getvalue().to_pybytes())], pa.binary())], names=["packed"])

        for batch in batches:
            start = 0
            for i, text in enumerate(batch.column(1).to_pylist()):
                block.add(text or "")
                if block.characters >= size or i + 1 == batch.num_rows:
                    ids.append(batch.column(0).slice(start, i + 1 - start))
                    n_bytes.append(batch.column(2).slice(start, i + 1 - start))
                    start = i + 1
                if block.characters >= size:
                    yield close()
                    block, ids, n_bytes = Block(vocab), [], []
        if ids:
            yield close()

    return docs.select("doc_id", "text", "n_bytes").mapInArrow(run, "packed binary").withColumn("block", F.monotonically_increasing_id())


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of each row."""
    import pyarrow as pa

    d = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes")
    )
    # Both uses of the blocks read all their columns, and so one shuffle.
    dealt = blocks(d, tokenizer, size).repartition("block")

    def spread(batches):
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = block_words(packed)
                for a in range(0, len(words), 1 << 16):
                    part = words[a : a + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([block] * len(part), pa.int64()), pa.array(range(a, a + len(part)), pa.int32())], names=["word", "block", "at"])

    def count(batches):
        vocab = vocabulary(tokenizer)
        last, n = None, 0
        for batch in batches:
            pieces = []
            for word in batch.column(0).to_pylist():
                if word != last:
                    last, n = word, n_pieces(vocab, word)
                pieces.append(n)
            found = (batch.column(2).to_numpy().astype(np.int64) << 32) | np.array(pieces, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found)], names=["block", "found"])

    words = dealt.select("block", "packed").mapInArrow(spread, "word string, block long, at int")
    counted = words.repartition("word").sortWithinPartitions("word").mapInArrow(count, "block long, found long")
    # A block's words are bounded by its size; all blocks' together are not, so nothing is broadcast.
    counted = counted.groupBy("block").agg(F.collect_list("found").alias("found")).hint("merge")

    def total(batches):
        for batch in batches:
            for packed, found in zip(batch.column(0), batch.column(1), strict=True):
                found = found.values.to_numpy() if found.is_valid else np.zeros(0, np.int64)
                pieces = np.zeros(len(found), np.int64)
                pieces[found >> 32] = found & 0xFFFFFFFF
                rows, totals = block_totals(packed.as_py(), pieces)
                for own in pa.ipc.open_stream(rows):
                    yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(totals, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    kind = d.schema["doc_id"].dataType.simpleString()
    return dealt.join(counted, "block", "left").select("packed", "found").mapInArrow(total, f"doc_id {kind}, n_bytes long, n_tokens long")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    prepare(spark)
    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
