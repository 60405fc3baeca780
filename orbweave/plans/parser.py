"""Statements of the pattern language.

    match   := MATCH node [link node] [WHERE expr] [RETURN items] [ORDER BY field [ASC|DESC]] [LIMIT int]
    node    := "(" [name] [":" label] ")"
    link    := "-" ["[" edge "]"] ("->" | "=>" | "-->" | "<-" | "-" | nothing), or "<-" "[" edge "]" "-", or an arrow
    edge    := name ":" [name] | ":" name | name (a relation)
    insert  := INSERT "(" label ["{" {key ":" value [","]} "}"] ")"
    delete  := DELETE "(" name [":" label] ")"
    expr    := and {OR and};  and := term {AND term};  term := "(" expr ")" | field op value
    field   := name {"." name};  op := = | != | < | > | <= | >=

A keyword can be a label if it is quoted.  Anything after a statement is an error (D33).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from ..errors import QuerySyntaxError
from .lexer import Token, tokenize


@dataclass
class Node:
    alias: str | None
    label: str | None


@dataclass
class Edge:
    alias: str | None
    relation: str | None
    direction: str


@dataclass
class Compare:
    field: str
    op: str
    value: object


@dataclass
class Logic:
    op: str
    left: object
    right: object


@dataclass
class Match:
    start: Node
    edge: Edge | None = None
    end: Node | None = None
    where: object = None
    items: list[tuple[str, str | None]] = field(default_factory=list)
    order: tuple[str, bool] | None = None
    limit: int | None = None


@dataclass
class Insert:
    label: str
    properties: dict[str, object]


@dataclass
class Delete:
    alias: str
    label: str | None


class Parser:
    def __init__(self, text: str, strict_logic: bool = False):
        self.tokens, self.i, self.strict_logic = tokenize(text), 0, strict_logic

    @property
    def here(self) -> Token:
        return self.tokens[self.i]

    def fail(self, wanted: str):
        raise QuerySyntaxError(f"expected {wanted} at {self.here.at}, found {self.here.value!r}")

    def accept(self, *values: str) -> str | None:
        if self.here.kind in ("symbol", "keyword") and self.here.value in values:
            self.i += 1
            return self.tokens[self.i - 1].value
        return None

    def expect(self, value: str) -> None:
        if not self.accept(value):
            self.fail(value)

    def take(self, *kinds: str):
        if self.here.kind not in kinds:
            self.fail(" or ".join(kinds))
        self.i += 1
        return self.tokens[self.i - 1].value

    def statement(self):
        kind = self.accept("MATCH", "INSERT", "DELETE")
        if not kind:
            self.fail("MATCH, INSERT or DELETE")
        out = {"MATCH": self.match, "INSERT": self.insert, "DELETE": self.delete}[kind]()
        if self.here.kind != "end":
            self.fail("the end")
        return out

    def node(self) -> Node:
        self.expect("(")
        alias = self.take("name") if self.here.kind == "name" else None
        label = self.take("name", "string") if self.accept(":") else None
        self.expect(")")
        return Node(alias, label)

    def inside(self) -> tuple[str | None, str | None]:
        """Alias and relation between brackets."""
        alias = relation = None
        if self.here.kind == "name":
            alias = self.take("name")
            if not self.accept(":"):
                alias, relation = None, alias
            elif self.here.kind in ("name", "string"):
                relation = self.take("name", "string")
        elif self.accept(":"):
            relation = self.take("name", "string")
        self.expect("]")
        return alias, relation

    def link(self) -> Edge | None:
        if self.here.kind == "symbol" and self.here.value in ("->", "=>", "-->", "<--", "<->", "<-->"):
            arrow = self.accept("->", "=>", "-->", "<--", "<->", "<-->")
            return Edge(None, None, {"<--": "backward", "<->": "both", "<-->": "both"}.get(arrow, "forward"))
        left = self.accept("<-")
        if not left and not self.accept("-"):
            return None
        alias, relation = self.inside() if self.accept("[") else (None, None)
        if left:
            self.accept("-")
            return Edge(alias, relation, "backward")
        if self.accept("->", "=>", "-->"):
            return Edge(alias, relation, "forward")
        if self.accept("<-", "<--"):
            return Edge(alias, relation, "backward")
        self.accept("-")
        return Edge(alias, relation, "both")

    def match(self) -> Match:
        out = Match(self.node())
        out.edge = self.link()
        if out.edge:
            out.end = self.node()
        if self.accept("WHERE"):
            out.where = self.strict() if self.strict_logic else self.either()
        if self.accept("RETURN"):
            while True:
                name = "*" if self.accept("*") else self.dotted()
                out.items.append((name, self.take("name") if self.accept("AS") else None))
                if not self.accept(","):
                    break
        if self.accept("ORDER"):
            self.expect("BY")
            name = self.dotted()
            out.order = (name, self.accept("ASC", "DESC") != "DESC")
        if self.accept("LIMIT"):
            out.limit = self.take("number")
            if not isinstance(out.limit, int):
                raise QuerySyntaxError("LIMIT needs a whole number")
        return out

    def dotted(self) -> str:
        parts = [self.take("name")]
        while self.accept("."):
            parts.append(self.take("name"))
        return ".".join(parts)

    def either(self):
        out = self.both()
        while self.accept("OR"):
            out = Logic("OR", out, self.both())
        return out

    def both(self):
        out = self.term()
        while self.accept("AND"):
            out = Logic("AND", out, self.term())
        return out

    def strict(self):
        """AND and OR with one precedence, grouped to the right (D8)."""
        left = self.term()
        op = self.accept("AND", "OR")
        return Logic(op, left, self.strict()) if op else left

    def term(self):
        if self.accept("("):
            out = self.strict() if self.strict_logic else self.either()
            self.expect(")")
            return out
        name = self.dotted()
        op = self.accept("=", "!=", "<=", ">=", "<", ">")
        if not op:
            self.fail("a comparison")
        return Compare(name, op, self.value())

    def value(self):
        if self.accept("-"):
            return -self.take("number")
        return self.take("string", "number", "name")

    def insert(self) -> Insert:
        self.expect("(")
        label, properties = self.take("name", "string"), {}
        if self.accept("{"):
            while not self.accept("}"):
                key = self.take("name", "string")
                self.expect(":")
                properties[key] = self.value()
                self.accept(",")
        self.expect(")")
        return Insert(label, properties)

    def delete(self) -> Delete:
        node = self.node()
        if not node.alias:
            self.fail("a name")
        return Delete(node.alias, node.label)


def parse(text: str, strict_logic: bool = False):
    return Parser(text, strict_logic).statement()
