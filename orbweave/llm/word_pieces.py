"""Pre-tokens and merges of the lower-casing word BPE vocabulary.

``WordVocabulary`` loads a tokenizers file once per worker process and offers what the
counting and encoding operators share: the library's own pre-tokens for any text, and
exact merging of one pre-token.
"""

from __future__ import annotations

import functools
import heapq
import json
import re

#: Letters whose lower case and composition need no context; other texts take the library's path.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿĀ-įı-ňŊ-ž"
PLAIN_TEXT = re.compile(rf"[\t\n\r -~¡¿«»–—‘’“”…{LETTERS}]*")
PRE_TOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\s0-9{LETTERS}]+")


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte, by the usual byte-level rule."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(extra)
            extra += 1
    return [out[b] for b in range(256)]


class WordVocabulary:
    """Ids, merge ranks and pre-tokens of one tokenizers BPE file with an end-of-word suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.path = path
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.suffix = self.tokenizer.model.end_of_word_suffix
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.by_byte = byte_alphabet()
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")

    # What only some operators need is made when it is first asked for.

    @functools.cached_property
    def ids(self) -> dict[str, int]:
        return self.tokenizer.get_vocab(with_added_tokens=False)

    @functools.cached_property
    def tokens(self) -> dict[int, str]:
        return {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}

    @functools.cached_property
    def longest(self) -> int:
        return max(map(len, self.ids))

    @functools.cached_property
    def ranks(self) -> dict[tuple[str, str], int]:
        with open(self.path, encoding="utf-8") as f:
            return {tuple(m): r for r, m in enumerate(json.load(f)["model"]["merges"])}

    def mapped(self, word: str) -> str:
        return word if word.isascii() else "".join(self.by_byte[b] for b in word.encode())

    def segments(self, text: str):
        """(special id, None) and (None, text) in order, as the library splits a text."""
        if "<|" not in text:
            yield None, text
            return
        for part in self._special.split(text):
            if part in self.special:
                yield self.special[part], None
            elif part:
                yield None, part

    def pre_tokens(self, text: str) -> tuple[list[str], bool]:
        """Pre-tokens of a text without special strings; whether they are byte-mapped already."""
        if PLAIN_TEXT.fullmatch(text):
            return PRE_TOKEN.findall(text.lower()), False
        own = self.tokenizer
        return [t for t, _ in own.pre_tokenizer.pre_tokenize_str(own.normalizer.normalize_str(text))], True

    def symbols(self, mapped: str) -> list[str]:
        return [*mapped[:-1], mapped[-1] + self.suffix]

    def merge(self, symbols: list[str]) -> list[str]:
        """Exact merging: lowest rank first, then leftmost."""
        ranks = self.ranks
        if len(symbols) < 48:
            while len(symbols) > 1:
                best = min(((ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False))))
                if best[0] == 1 << 60:
                    break
                i = best[1]
                symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]
            return symbols
        s: list[str | None] = list(symbols)
        after, before = [*range(1, len(s)), -1], list(range(-1, len(s) - 1))
        heap = [(r, i, s[i], s[i + 1]) for i in range(len(s) - 1) if (r := ranks.get((s[i], s[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if s[i] is not None else -1
            if s[i] != a or j < 0 or s[j] != b:
                continue
            s[i], s[j] = a + b, None
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := ranks.get((s[i], s[k]))) is not None:
                    heapq.heappush(heap, (r, i, s[i], s[k]))
            if (h := before[i]) >= 0 and (r := ranks.get((s[h], s[i]))) is not None:
                heapq.heappush(heap, (r, h, s[h], s[i]))
        return [x for x in s if x is not None]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> WordVocabulary:
    return WordVocabulary(path)
