"""Mixture-controlled packing of documents into sequences of fixed length.

Every source is a queue of its documents' tokens, served by deficit round-robin.  A round
is one window of ``LENGTH`` tokens, in which a source earns ``LENGTH`` x its target share;
what it does not spend is carried to the next window.  A document is served in packets of
at most ``PACKET`` tokens.  Because a backlogged queue's deficit only depends on how much
it has sent, the window that serves a packet has a closed form,

    floor((tokens of the queue before the packet + phase x its length) / (LENGTH x share)),

where the phase, a hash of the source, spreads queues that are shorter than their quantum
over all windows.  Deficits so carry across windows and partitions without a sequential
pass: the positions in a queue and in the whole order are prefix sums, taken in two levels.
A partition's own sums are taken while it is tokenised, so a source with most of all rows
is not gathered; the order's groups hold a few hundred windows each.  Packets are cut where a sequence is full, so that all sequences but the
last hold exactly ``LENGTH`` tokens.

By default the target shares are those of the tokens of each source.  A null text is the
empty text (one end id); null sources are a queue of their own; ids may be null or
repeated, each row is packed by itself; other columns of the input are not read.  An empty
table gives no pieces.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, prepare, slices, table
from .word_pieces import PLAIN_TEXT, byte_alphabet

LENGTH = 2048
PACKET = 512
END_ID = 1
#: Windows whose packets are put in order together, and such groups that are summed together.
GROUP = 256
GROUPS = 1024
#: Rows (source, partition) that may be broadcast.
BROADCAST_PARTS = 100_000
#: Fixed value: the pattern that byte-level vocabularies split texts with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK = 1 << 20


class ByteVocabulary:
    """Ids of texts as the tokenizers library gives them for a byte-level BPE file.

    Texts of plain Latin characters take a faster library with the same ranks; any other
    text, and the special strings, take the tokenizers library itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {c: b for b, c in enumerate(byte_alphabet())}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        self.size = max(max(ranks.values()), *(x["id"] for x in spec["added_tokens"])) + 1
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        self._blank = re.compile(r"\s{2000}")

    def encode(self, text: str) -> list[int]:
        plain = PLAIN_TEXT.fullmatch(text) and not any(s in text for s in self.special) and not self._blank.search(text)
        return self.fast.encode_ordinary(text) if plain else self.exact.encode(text, add_special_tokens=False).ids


@functools.lru_cache(maxsize=2)
def byte_vocabulary(path: str) -> ByteVocabulary:
    return ByteVocabulary(path)


def tokenise(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source key, n (with the end id), the tokens of the source before it in its partition, and compressed ids of each row."""
    import pyarrow as pa

    def run(batches):
        import zstandard

        vocab = byte_vocabulary(tokenizer)
        kind = "H" if vocab.size <= 1 << 16 else "I"
        pack = zstandard.ZstdCompressor(level=1).compress
        totals: dict[str, int] = {}
        for batch in batches:
            n, before, packed = [], [], []
            for text, queue in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ids = array(kind, vocab.encode(text) if text else [])
                ids.append(END_ID)
                n.append(len(ids))
                before.append(totals.get(queue, 0))
                totals[queue] = before[-1] + len(ids)
                packed.append(pack(ids.tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(before, pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "queue", "n", "before", "packed"])

    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("-"))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), key.alias("queue"))
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, queue string, n long, before long, packed binary")


def _before(of: str, *by: str, order: list[str]):
    """Sum of ``of`` over the rows before this one."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(of).over(w), F.lit(0))


def deal(tokens: DataFrame, length: int = LENGTH, packet: int = PACKET, shares: dict[str, float] | None = None) -> DataFrame:
    """uid, start, length, sequence_id and offset of every piece of (uid, queue, n, before).

    ``uid`` holds the input partition above its lowest 33 bits, ``before`` the tokens of the
    queue in the rows of that partition with smaller uids.  ``shares`` gives target
    shares by source; sources without one keep their share of the tokens.
    """
    d = tokens.select("uid", "queue", "n", "before", F.shiftright("uid", 33).alias("part"))
    parts = d.groupBy("queue", "part").agg(F.sum("n").alias("tokens"))
    queue = F.sum("tokens").over(Window.partitionBy("queue"))
    total = tokens.agg(F.sum("n")).first()[0] or 1
    share = F.col("own") / F.lit(float(total))
    if shares:
        given = F.create_map(*[F.lit(x) for s, v in shares.items() for x in ("=" + s, float(v))])
        share = F.coalesce(given[F.col("queue")], share)
    parts = parts.select("queue", "part", queue.alias("own"), _before("tokens", "queue", order=["part"]).alias("base")).withColumn("share", share)

    # One row for each source of each partition: the documents need no exchange to find theirs.
    d = d.join(F.broadcast(parts) if parts.count() <= BROADCAST_PARTS else parts, ["queue", "part"])
    d = d.select("uid", "queue", "n", "share", (F.col("base") + F.col("before")).alias("at"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(packet).cast("long"))).alias("start"))
    d = d.withColumn("size", F.least(F.lit(packet).cast("long"), F.col("n") - F.col("start"))).withColumn("at", F.col("at") + F.col("start"))
    phase = F.xxhash64(F.lit("phase"), "queue") / F.lit(2.0**64) + 0.5
    d = d.withColumn("turn", F.floor((F.col("at") + phase * F.col("size")) / (F.lit(float(length)) * F.col("share"))))
    d = cut(d.select("uid", "queue", "start", "size", "at", "turn", F.floor(F.col("turn") / GROUP).alias("g")))

    groups = d.groupBy("g").agg(F.sum("size").alias("tokens")).withColumn("h", F.floor(F.col("g") / GROUPS))
    tops = groups.groupBy("h").agg(F.sum("tokens").alias("t"))
    tops = tops.select("h", _before("t", order=["h"]).alias("top"))
    groups = groups.withColumn("low", _before("tokens", "h", order=["g"])).join(tops, "h").select("g", (F.col("top") + F.col("low")).alias("first"))
    d = d.withColumn("inner", _before("size", "g", order=["turn", "queue", "at"])).join(groups, "g")
    d = d.select("uid", "start", "size", (F.col("first") + F.col("inner")).alias("place"))

    room = F.lit(length) - F.pmod("place", F.lit(length))
    head = F.struct(F.col("start"), F.least("size", room).alias("length"), F.col("place"))
    tail = F.struct((F.col("start") + room).alias("start"), (F.col("size") - room).alias("length"), (F.col("place") + room).alias("place"))
    d = d.select("uid", F.inline(F.when(F.col("size") > room, F.array(head, tail)).otherwise(F.array(head))))
    return d.select("uid", "start", "length", F.floor(F.col("place") / length).alias("sequence_id"), F.pmod("place", F.lit(length)).alias("offset"))


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, packet: int = PACKET, shares: dict[str, float] | None = None, with_ids: bool = False, **columns) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32 (or ids), doc_tokens, sequence_id, offset."""
    import pyarrow as pa

    tokens = cut(tokenise(docs, tokenizer, **columns).withColumn("uid", F.monotonically_increasing_id()))
    pieces = deal(tokens, length, packet, shares).groupBy("uid").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))

    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        kind = "<u2" if byte_vocabulary(tokenizer).size <= 1 << 16 else "<u4"
        for batch in batches:
            sizes = batch.column(1).to_pylist()
            for a, b in slices(sizes, CHUNK):
                at, rows = [], []
                for i in range(a, b):
                    ids = np.frombuffer(unpack(batch.column(2)[i].as_py()), kind).astype("<u4")
                    for p in sorted(batch.column(3)[i].as_py(), key=lambda p: p["start"]):
                        own = ids[p["start"] : p["start"] + p["length"]]
                        at.append(i)
                        rows.append((p["start"], p["length"], own.astype(np.int32) if with_ids else zlib.crc32(own.tobytes()), len(ids), p["sequence_id"], p["offset"]))
                kinds = [pa.list_(pa.int32()) if with_ids and k == 2 else pa.int64() for k in range(6)]
                cols = [pa.array([r[k] for r in rows], kinds[k]) for k in range(6)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *cols], names=["doc_id", *names])

    own = "ids array<int>" if with_ids else "ids_crc32 long"
    if with_ids:
        names[2] = "ids"
    kind = tokens.schema["doc_id"].dataType.simpleString()
    joined = tokens.select("uid", "doc_id", "n", "packed").join(pieces, "uid").select("doc_id", "n", "packed", "pieces")
    return joined.mapInArrow(run, f"doc_id {kind}, start long, length long, {own}, doc_tokens long, sequence_id long, offset long")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    prepare(spark)
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
