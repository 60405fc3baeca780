"""Traversals, integrity and changes of node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nodes_by_label(nodes: DataFrame, label: str) -> DataFrame:
    return nodes.filter(F.col("label") == label)


def hop(nodes: DataFrame, edges: DataFrame, from_label: str | None = None, relation: str | None = None, to_label: str | None = None, direction: str = "forward") -> DataFrame:
    """One step as structs a (start node), e (edge) and b (end node), duplicates of a multigraph kept.

    Labels and relation filter below the joins.  ``backward`` follows edges from their end;
    ``both`` is the union of the two (D2); no relation means any (D3).
    """
    e = edges if relation is None else edges.filter(F.col("relation") == relation)
    forward = e.select(F.struct("*").alias("e"), F.col("from_node").alias("a_id"), F.col("to_node").alias("b_id"))
    backward = e.select(F.struct("*").alias("e"), F.col("to_node").alias("a_id"), F.col("from_node").alias("b_id"))
    steps = {"forward": forward, "backward": backward, "both": forward.unionByName(backward)}[direction]
    a = nodes if from_label is None else nodes_by_label(nodes, from_label)
    b = nodes if to_label is None else nodes_by_label(nodes, to_label)
    a = a.select(F.col("node_id").alias("a_id"), F.struct("*").alias("a"))
    b = b.select(F.col("node_id").alias("b_id"), F.struct("*").alias("b"))
    return steps.join(a, "a_id").join(b, "b_id").select("a", "e", "b")


def traverse(nodes: DataFrame, edges: DataFrame, from_label: str, relation: str | None, to_label: str) -> DataFrame:
    return hop(nodes, edges, from_label, relation, to_label).select(F.col("a.node_id").alias("from_id"), F.col("b.node_id").alias("to_id"), F.col("e.weight").alias("weight"))


def neighbors(edges: DataFrame, node_id: int, relation: str | None = None) -> DataFrame:
    out = edges.filter(F.col("from_node") == node_id)
    if relation is not None:
        out = out.filter(F.col("relation") == relation)
    return out.select("to_node", "relation", "weight")


def edges_with_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose two ends exist."""
    ids = nodes.select("node_id")
    return edges.join(ids, edges.from_node == ids.node_id, "left_semi").join(ids, edges.to_node == ids.node_id, "left_semi")


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that miss an end."""
    from_ids, to_ids = nodes.select(F.col("node_id").alias("f")), nodes.select(F.col("node_id").alias("t"))
    marked = edges.join(from_ids, edges.from_node == F.col("f"), "left").join(to_ids, edges.to_node == F.col("t"), "left")
    return marked.filter("f is null or t is null").select(*edges.columns)


def remove_nodes(nodes: DataFrame, edges: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the doomed nodes (node_id) and every edge at them."""
    ids = doomed.select(F.col("node_id").alias("_doomed")).distinct()
    left = nodes.join(ids, nodes.node_id == F.col("_doomed"), "left_anti")
    edges = edges.join(ids, edges.from_node == F.col("_doomed"), "left_anti")
    return left, edges.join(ids, edges.to_node == F.col("_doomed"), "left_anti")
