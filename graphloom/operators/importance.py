"""Node importance, condensing and eviction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import CapacityExceeded
from ..functions.values import importance as score_of
from ..model import Graph
from .aggregates import degrees


def importance(graph: Graph, now: int, access: DataFrame | None = None) -> DataFrame:
    """(node_id, importance): by degree, recency and last access (node_id, accessed_at)."""
    d = degrees(graph)
    most = d.agg(F.max("degree").alias("most"))
    rows = graph.nodes.select("node_id", "created_at").join(d, "node_id").crossJoin(F.broadcast(most))
    rows = rows.join(access.groupBy("node_id").agg(F.max("accessed_at").alias("accessed_at")), "node_id", "left") if access is not None else rows.withColumn("accessed_at", F.lit(None).cast("long"))
    return rows.select("node_id", score_of(F.col("degree"), F.col("most"), F.col("created_at"), F.coalesce("accessed_at", F.lit(0)), now).alias("importance"))


def most_important(graph: Graph, now: int, n: int = 10, access: DataFrame | None = None) -> DataFrame:
    return importance(graph, now, access).orderBy(F.desc("importance"), "node_id").limit(n)


def condense(graph: Graph, now: int, threshold: float, access: DataFrame | None = None) -> Graph:
    """The graph without nodes of less importance, and without their edges."""
    keep = importance(graph, now, access).where(F.col("importance") >= threshold).select("node_id")
    nodes = graph.nodes.join(keep, "node_id", "left_semi")
    edges = graph.edges.join(keep.select(F.col("node_id").alias("src")), "src", "left_semi").join(keep.select(F.col("node_id").alias("dst")), "dst", "left_semi").select(*graph.edges.columns)
    vectors = None if graph.embeddings is None else graph.embeddings.join(keep, "node_id", "left_semi")
    return Graph(nodes, edges, vectors, graph.name, graph.settings)


def evictable(graph: Graph, access: DataFrame, adding: int = 1) -> DataFrame:
    """(node_id): those that must go for so many to be added, by last access, never first, then id."""
    most = graph.settings.max_nodes
    if most is None:
        return graph.nodes.select("node_id").where(F.lit(False))
    over = graph.nodes.count() + adding - most
    if over > 0 and graph.settings.eviction != "lru":
        raise CapacityExceeded(f"the graph may have {most} nodes")
    last = access.groupBy("node_id").agg(F.max("accessed_at").alias("at"))
    return graph.nodes.select("node_id").join(last, "node_id", "left").orderBy(F.coalesce("at", F.lit(0)), "node_id").limit(max(0, over)).select("node_id")
