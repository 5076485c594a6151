"""Expiry: what a sweep at a moment removes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Graph


def expired_nodes(graph: Graph, now: int) -> DataFrame:
    return graph.nodes.where(F.col("ttl_expires_at") <= now)


def expired_edges(graph: Graph, now: int) -> DataFrame:
    """Edges whose validity has ended, invalidated ones too."""
    return graph.edges.where(F.col("valid_until") <= now)


def sweep(graph: Graph, now: int) -> Graph:
    """The graph as a reader sees it after a sweep; stored history stays."""
    gone = expired_nodes(graph, now).select("node_id")
    nodes = graph.nodes.join(gone, "node_id", "left_anti")
    edges = graph.edges.where(F.coalesce(F.col("valid_until") > now, F.lit(True)))
    edges = edges.join(gone, edges["src"] == gone["node_id"], "left_anti").join(gone, edges["dst"] == gone["node_id"], "left_anti")
    return Graph(nodes, edges, graph.embeddings, graph.name, graph.settings)


def expiry(created: int, ttl_ms: int | None, default_ms: int | None) -> int | None:
    ttl = ttl_ms if ttl_ms is not None else default_ms
    return None if ttl is None else created + ttl
