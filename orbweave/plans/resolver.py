"""From parsed patterns to DataFrames; Catalyst does the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QuerySyntaxError
from ..operators import graph
from .parser import Compare, Logic, Match

NODE_FIELDS = ("node_id", "label", "created")
EDGE_FIELDS = ("edge_id", "from_node", "to_node", "relation", "weight", "created")
#: Output of a pattern without RETURN.
DEFAULT = (("from_id", "a.node_id"), ("to_id", "b.node_id"), ("weight", "e.weight"))


class Scope:
    """Columns behind the aliases of one pattern."""

    def __init__(self, match: Match, nodes: DataFrame, edges: DataFrame):
        self.match, self.nodes, self.edges = match, nodes, edges
        self.structs = {match.start.alias: "a"} if match.start.alias else {}
        if match.edge:
            self.structs |= {x.alias: c for x, c in ((match.edge, "e"), (match.end, "b")) if x.alias}

    def column(self, name: str) -> Column:
        head, _, rest = name.partition(".")
        if head in self.structs:
            struct = self.structs[head]
            if not rest:
                return F.col({"a": "a.node_id", "b": "b.node_id", "e": "e.relation"}[struct])
            known, frame = (EDGE_FIELDS, self.edges) if struct == "e" else (NODE_FIELDS, self.nodes)
            if rest in known and rest in frame.columns:
                return F.col(f"{struct}.{rest}")
            if struct == "e":
                raise QuerySyntaxError(f"edges have no field {rest}")
            return F.col(f"{struct}.properties")[rest]
        if not rest and self.match.edge:
            named = dict(DEFAULT)
            if head in named:
                return F.col(named[head])
        if not rest and not self.match.edge and head in NODE_FIELDS:
            return F.col(f"a.{head}")
        raise QuerySyntaxError(f"unknown name {name}")

    def compare(self, c: Compare) -> Column:
        """Numbers are compared as numbers where both sides are (D7), else as strings."""
        left = self.column(c.field)
        ops = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}
        op = ops[c.op]
        try:
            number = float(c.value)
        except ValueError:
            return op(left.cast("string"), F.lit(str(c.value)))
        if c.field.rpartition(".")[2] in ("weight", "node_id", "edge_id", "from_node", "to_node", "from_id", "to_id"):
            return op(left, F.lit(c.value if isinstance(c.value, int) else number))
        as_number = left.try_cast("double")
        return F.when(as_number.isNotNull(), op(as_number, F.lit(number))).otherwise(op(left.cast("string"), F.lit(str(c.value))))

    def condition(self, e) -> Column:
        if isinstance(e, Compare):
            return self.compare(e)
        assert isinstance(e, Logic)
        left, right = self.condition(e.left), self.condition(e.right)
        return left & right if e.op == "AND" else left | right


def resolve(match: Match, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    scope = Scope(match, nodes, edges)
    if match.edge:
        d = graph.hop(nodes, edges, match.start.label, match.edge.relation, match.end.label, match.edge.direction)
    else:
        d = (nodes if match.start.label is None else graph.nodes_by_label(nodes, match.start.label)).select(F.struct("*").alias("a"))
    if match.where is not None:
        d = d.filter(scope.condition(match.where))
    outputs: list[tuple[str, Column]] = []
    whole = [(n, F.col(c)) for n, c in DEFAULT] if match.edge else [(n, F.col(f"a.{n}")) for n in NODE_FIELDS if n in nodes.columns]
    for name, alias in match.items or [("*", None)]:
        outputs += whole if name == "*" else [(alias or name.replace(".", "_"), scope.column(name))]
    if match.order:
        name, up = match.order
        chosen = dict(outputs)
        key = chosen[name] if name in chosen else scope.column(name)
        ties = [F.col("a.node_id")] + ([F.col("b.node_id"), F.col("e.weight")] if match.edge else [])
        d = d.orderBy(key.asc() if up else key.desc(), *ties)
    if match.limit is not None:
        d = d.limit(match.limit)
    return d.select(*[c.alias(n) for n, c in outputs])
