"""Point-in-time and range queries, differences and history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidQuery
from ..functions.temporal import OPEN, is_current_at, is_valid_at, is_valid_during
from ..model import Graph
from .filters import not_expired


def _from(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("node_id").alias("src")), "src", "left_semi").select(*edges.columns)


def at(graph: Graph, ts: int, nodes: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) at a moment; edges are those of surviving source nodes."""
    alive = graph.nodes.where(not_expired(ts))
    if nodes is not None:
        alive = alive.where(F.col("node_id").isin(*nodes))
    return alive, _from(alive, graph.edges.where(is_valid_at(ts)))


def during(graph: Graph, start: int, end: int, nodes: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) that were valid at some moment of [start, end)."""
    alive = graph.nodes.where((F.coalesce(F.col("tx_from"), F.lit(0)) < end) & (F.coalesce(F.col("ttl_expires_at"), F.lit(OPEN)) > start))
    if nodes is not None:
        alive = alive.where(F.col("node_id").isin(*nodes))
    return alive, _from(alive, graph.edges.where(is_valid_during(start, end)))


def _changes(rows: DataFrame, live, start: int, end: int) -> DataFrame:
    within = lambda c: F.sum(F.when((F.col(c) >= start) & (F.col(c) < end), 1).otherwise(0))
    return rows.agg(F.coalesce(within("tx_from"), F.lit(0)).alias("added"), F.coalesce(within("tx_until"), F.lit(0)).alias("removed"), F.coalesce(F.sum(live(start).cast("long")), F.lit(0)).alias("active_before"), F.coalesce(F.sum(live(end).cast("long")), F.lit(0)).alias("active_after"))


def diff(graph: Graph, start: int, end: int) -> DataFrame:
    """(kind, added, removed, active_before, active_after) for nodes and edges, tombstones included."""
    if start >= end:
        raise InvalidQuery("a difference needs from < to")
    nodes = _changes(graph.nodes, lambda t: is_current_at(t) & (F.coalesce(F.col("ttl_expires_at"), F.lit(OPEN)) > t), start, end)
    edges = _changes(graph.edges, lambda t: is_valid_at(t) & is_current_at(t), start, end)
    order = ["kind", "added", "removed", "active_before", "active_after"]
    return nodes.withColumn("kind", F.lit("node")).select(*order).unionAll(edges.withColumn("kind", F.lit("edge")).select(*order))


def history(graph: Graph, node_id: int) -> DataFrame:
    """All edges of a node with their four moments, and whether they are active."""
    touched = graph.edges.where((F.col("src") == node_id) | (F.col("dst") == node_id))
    active = F.col("valid_until").isNull() & F.col("tx_until").isNull()
    return touched.select("edge_id", "src", "dst", "label", "weight", "valid_from", "valid_until", "tx_from", "tx_until", active.alias("active")).orderBy("edge_id")
