"""Edge, node and property filters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.temporal import OPEN, is_valid_at, is_valid_during
from ..functions.values import permission
from ..model import Graph

RANK = {"none": 0, "read": 1, "write": 2, "readwrite": 3, "admin": 4}


@dataclass(frozen=True)
class EdgeFilter:
    labels: tuple[str, ...] | None = None
    min_weight: float | None = None
    valid_at: int | None = None
    valid_during: tuple[int, int] | None = None
    max_age_ms: int | None = None
    min_confidence: float | None = None
    now: int | None = None

    def condition(self) -> Column:
        ok = F.lit(True)
        if self.labels:
            ok &= F.col("label").isin(*self.labels)
        if self.min_weight is not None:
            ok &= F.col("weight") >= self.min_weight
        if self.valid_at is not None:
            ok &= is_valid_at(self.valid_at)
        if self.valid_during is not None:
            ok &= is_valid_during(*self.valid_during)
        if self.max_age_ms is not None:
            if self.now is None:
                raise ValueError("max_age_ms needs now")
            ok &= F.greatest(F.lit(self.now) - F.col("tx_from"), F.lit(0)) <= self.max_age_ms
        if self.min_confidence is not None:  # edges without provenance fail
            ok &= F.coalesce(F.col("prov.confidence") >= self.min_confidence, F.lit(False))
        return ok

    def __call__(self, edges: DataFrame) -> DataFrame:
        return edges.where(self.condition())


@dataclass(frozen=True)
class NodeFilter:
    labels: tuple[str, ...] | None = None
    has_properties: tuple[str, ...] = ()
    valid_at: int | None = None

    def __call__(self, graph: Graph, nodes: DataFrame | None = None) -> DataFrame:
        found = graph.nodes if nodes is None else nodes
        if self.labels:
            found = found.where(F.col("label").isin(*self.labels))
        for key in self.has_properties:
            found = found.where(F.col("props")[key].isNotNull())
        if self.valid_at is not None:  # some incident edge is valid
            live = graph.edges.where(is_valid_at(self.valid_at))
            ends = live.select(F.col("src").alias("node_id")).union(live.select(F.col("dst").alias("node_id")))
            found = found.join(ends, "node_id", "left_semi")
        return found


def all_nodes(graph: Graph) -> DataFrame:
    return graph.nodes


def all_edges(graph: Graph) -> DataFrame:
    return graph.edges


def node_by_id(graph: Graph, node_id: int) -> DataFrame:
    return graph.nodes.where(F.col("node_id") == node_id)


def node_by_key(graph: Graph, key: str) -> DataFrame:
    return graph.nodes.where(F.col("entity_key") == key).orderBy("node_id").limit(1)


def edge_by_id(graph: Graph, edge_id: int) -> DataFrame:
    return graph.edges.where(F.col("edge_id") == edge_id)


def nodes_with_property(graph: Graph, key: str) -> DataFrame:
    return graph.nodes.where(F.col("props")[key].isNotNull())


def nodes_where(graph: Graph, key: str, test) -> DataFrame:
    """Nodes that have the property and pass test, a function of its column."""
    return graph.nodes.where(F.col("props")[key].isNotNull() & test(F.col("props")[key]))


def edges_where(graph: Graph, key: str, test) -> DataFrame:
    return graph.edges.where(F.col("props")[key].isNotNull() & test(F.col("props")[key]))


def search_property(graph: Graph, key: str, value: str, limit: int = 100) -> DataFrame:
    """Nodes whose property, as text, equals value; total is their number before the limit."""
    found = graph.nodes.where(F.col("props")[key] == value)
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy("node_id").limit(limit).crossJoin(F.broadcast(total))


def not_expired(at: int) -> Column:
    """Written by the moment and not expired at it."""
    return (F.coalesce(F.col("tx_from"), F.lit(0)) <= at) & (F.coalesce(F.col("ttl_expires_at"), F.lit(OPEN)) > at)


def visible(props: Column) -> Column:
    """Properties without reserved ones, whose names begin with an underscore."""
    return F.map_filter(props, lambda k, v: ~k.startswith("_"))


def content(props: Column) -> Column:
    """'key: value' lines of the visible properties, in order of their keys."""
    entries = F.array_sort(F.map_entries(visible(props)))
    kept = F.filter(entries, lambda e: e["value"].isNotNull())
    return F.array_join(F.transform(kept, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def allowed(df: DataFrame, rules: list[tuple[str, str]], need: str = "read", graph: str = "graph") -> DataFrame:
    """Rows of graphs on which rules give at least a permission."""
    enough = [k for k, v in RANK.items() if v >= RANK[need] or (need in ("read", "write") and k in ("readwrite", "admin"))]
    enough = [k for k in enough if not (need == "read" and k == "write")]
    return df.where(permission(F.col(graph), rules).isin(*enough))
