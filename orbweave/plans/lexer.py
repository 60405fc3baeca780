"""Tokens of the pattern language."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import QuerySyntaxError

#: The reserved words, in any case.
KEYWORDS = "MATCH WHERE RETURN ORDER BY LIMIT INSERT DELETE SELECT AND OR AS ASC DESC CREATE SET ON TO FROM EDGE NODE".split()

SYMBOLS = ["<-->", "<->", "-->", "<--", "->", "=>", "<-", "<=", ">=", "!=", "=", "<", ">", "(", ")", "[", "]", "{", "}", ":", ",", ".", "-", "*", "+", "/"]
ESCAPES = {"n": "\n", "t": "\t"}

TOKEN = re.compile(
    r"(?P<space>\s+)|(?P<string>\"(?:[^\"\\]|\\.)*\")|(?P<number>\d+(?:\.\d+)*)|(?P<name>[^\W\d]\w*)|(?P<symbol>" + "|".join(map(re.escape, SYMBOLS)) + r")",
    re.DOTALL,
)


@dataclass(frozen=True)
class Token:
    kind: str
    """keyword, name, string, number, symbol or end"""
    value: object
    at: int


def tokenize(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise QuerySyntaxError(f"unexpected {text[at]!r} at {at}")
        kind, value = m.lastgroup, m.group()
        if kind == "string":
            out.append(Token("string", re.sub(r"\\(.)", lambda e: ESCAPES.get(e[1], e[1]), value[1:-1], flags=re.DOTALL), at))
        elif kind == "number":
            if value.count(".") > 1:
                raise QuerySyntaxError(f"bad number {value} at {at}")
            out.append(Token("number", float(value) if "." in value else int(value), at))
        elif kind == "name":
            word = value.upper() in KEYWORDS
            out.append(Token("keyword" if word else "name", value.upper() if word else value, at))
        elif kind == "symbol":
            out.append(Token("symbol", value, at))
        at = m.end()
    return [*out, Token("end", None, len(text))]
