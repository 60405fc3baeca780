"""BPE encoding and decoding by speculation.

For the distinct pre-tokens of a batch, greedy longest match proposes tokens.  A proposal
is the exact encoding when every adjacent pair of its tokens is compatible, that is when
merging the two tokens' own symbols gives back just that pair (and a lone token gives back
itself).  The pairs of all proposals are tested together against a sorted table of
verdicts; only words with an incompatible pair undergo exact merging.  Documents are then
assembled from their words' packed ids.

Decoding takes ids only: a table of all tokens, joined by spaces as the vocabulary's file
asks for.  Ids that the vocabulary does not have are left out.

A null text is encoded as the empty text, null ids are decoded to null.  Ids may be null or repeated; other columns are
not read.  The caches of words and pairs are bounded, so memory does not grow with the
corpus; nothing is shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, slices, table
from .word_pieces import WordVocabulary, vocabulary

WORDS_KEPT = 300_000
PAIRS_KEPT = 2_000_000
#: Characters of text that are assembled together.
CHUNK = 1 << 20


class PairTable:
    """Verdicts on token pairs as two sorted arrays."""

    def __init__(self, vocab: WordVocabulary):
        self.vocab, self.width = vocab, max(vocab.tokens) + 1
        self.keys, self.verdicts = np.zeros(0, np.int64), np.zeros(0, bool)

    def compatible(self, pairs: np.ndarray) -> np.ndarray:
        """For keys a * width + b (a = width - 1 for a lone b), whether merging keeps the pair."""
        distinct, back = np.unique(pairs, return_inverse=True)
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == distinct[inside]
        if not known.all():
            fresh = distinct[~known]
            found = np.array([self._test(int(k)) for k in fresh], bool)
            if len(self.keys) > PAIRS_KEPT:
                self.keys, self.verdicts = distinct[known], self.verdicts[at[known]]
            keys = np.concatenate([self.keys, fresh])
            order = np.argsort(keys)
            self.keys, self.verdicts = keys[order], np.concatenate([self.verdicts, found])[order]
            at = np.searchsorted(self.keys, distinct)
        return self.verdicts[at][back]

    def _test(self, key: int) -> bool:
        a, b = divmod(key, self.width)
        vocab = self.vocab
        wanted = [vocab.tokens[b]] if a == self.width - 1 else [vocab.tokens[a], vocab.tokens[b]]
        symbols: list[str] = []
        for t in wanted:
            end = t.endswith(vocab.suffix) and len(t) > len(vocab.suffix)
            body = t[: -len(vocab.suffix)] if end else t
            symbols += [*body[:-1], body[-1] + vocab.suffix] if end else [*body]
        return vocab.merge(symbols) == wanted


class Encoder:
    """Exact encodings of words, speculated and verified a batch at a time."""

    def __init__(self, vocab: WordVocabulary):
        self.vocab, self.pairs = vocab, PairTable(vocab)
        self.known: dict[tuple[bool, str] | str, bytes] = {}
        self.merged = self.proposed = 0

    def greedy(self, word: str) -> list[int] | None:
        """Longest match from the left; only the last token carries the suffix."""
        ids, suffix, most = self.vocab.ids, self.vocab.suffix, self.vocab.longest
        out, p, n = [], 0, len(word)
        while True:
            if n - p <= most and (i := ids.get(word[p:] + suffix)) is not None:
                out.append(i)
                return out
            for q in range(min(n - 1, p + most), p, -1):
                if (i := ids.get(word[p:q])) is not None:
                    out.append(i)
                    p = q
                    break
            else:
                return None

    def learn(self, words: list[str], mapped: bool) -> None:
        """Add the encodings of words that are not known yet."""
        vocab = self.vocab
        shown = words if mapped else [vocab.mapped(w) for w in words]
        proposals = [self.greedy(w) for w in shown]
        sizes = np.array([len(p) if p else 0 for p in proposals], np.int64)
        flat = np.array([i for p in proposals if p for i in p], np.int64)
        if len(flat):
            last = np.cumsum(sizes[sizes > 0]) - 1
            owner = np.repeat(np.arange(len(words)), sizes)
            keys = flat[:-1] * self.pairs.width + flat[1:]
            inner = owner[:-1] == owner[1:]
            alone = last[sizes[sizes > 0] == 1]
            keys = np.concatenate([keys[inner], (self.pairs.width - 1) * self.pairs.width + flat[alone]])
            whose = np.concatenate([owner[:-1][inner], owner[alone]])
            failed = np.zeros(len(words), bool)
            failed[whose[~self.pairs.compatible(keys)]] = True
        else:
            failed = np.ones(len(words), bool)
        self.proposed += len(words)
        for word, text, ids, bad in zip(words, shown, proposals, failed, strict=True):
            if bad or ids is None:
                self.merged += 1
                ids = [t.id for t in vocab.tokenizer.model.tokenize(text)]
            self.known[(True, word) if mapped else word] = np.array(ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        parsed = []
        missing: dict[bool, set[str]] = {False: set(), True: set()}
        for text in texts:
            parts = []
            for special, part in self.vocab.segments(text):
                if special is not None:
                    parts.append((special, None, False))
                    continue
                words, mapped = self.vocab.pre_tokens(part)
                keys = [(True, w) for w in words] if mapped else words
                parts.append((None, keys, mapped))
                missing[mapped].update(w[1] if mapped else w for w in set(keys) if w not in self.known)
            parsed.append(parts)
        for mapped, words in missing.items():
            if words:
                self.learn(sorted(words), mapped)
        out = []
        for parts in parsed:
            ids = []
            for special, keys, _ in parts:
                if special is not None:
                    ids.append(np.array([special], "<u4").tobytes())
                else:
                    ids += map(self.known.__getitem__, keys)
            out.append(b"".join(ids))
        return out


class Decoder:
    """Texts of ids."""

    def __init__(self, vocab: WordVocabulary):
        self.table = [vocab.tokens.get(i) for i in range(max(vocab.tokens) + 1)]
        self.whole = None not in self.table

    def decode(self, ids) -> str:
        ids = np.asarray(ids, np.int64)
        known = (ids >= 0) & (ids < len(self.table))
        found = map(self.table.__getitem__, (ids if known.all() else ids[known]).tolist())
        return " ".join(found if self.whole else (t for t in found if t is not None))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(vocabulary(path))
    return _encoders[path]


_decoders: dict[str, Decoder] = {}


def decoder(path: str) -> Decoder:
    if path not in _decoders:
        _decoders[path] = Decoder(vocabulary(path))
    return _decoders[path]


def _each(batch, path: str):
    """Packed ids of each text of a batch, a bounded chunk at a time."""
    texts = [t or "" for t in batch.column(1).to_pylist()]
    own = encoder(path)
    for a, b in slices([len(t) for t in texts], CHUNK):
        yield from own.encode(texts[a:b])


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of each row."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            ids = pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i in _each(batch, tokenizer)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(rows: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text of each row of ids."""
    import pyarrow as pa

    def run(batches):
        own = decoder(tokenizer)
        for batch in batches:
            texts = [own.decode(ids.values.to_numpy(zero_copy_only=False)) if ids.is_valid else None for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    d = rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, text string")


def encode_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text that they are decoded to."""
    import pyarrow as pa

    def run(batches):
        back = decoder(tokenizer)
        for batch in batches:
            n, ids, decoded = [], [], []
            for packed in _each(batch, tokenizer):
                n.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(back.decode(np.frombuffer(packed, "<u4")).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    prepare(spark)
    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
