"""Joins that the graph model implies: neighbours, patterns, membership, integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.temporal import is_valid_at
from ..functions.text import trigrams
from ..model import Graph
from ..runtime import portioned, rewritten


def neighbors(graph: Graph, of: DataFrame, direction: str = "out", label: str | None = None, at: int | None = None) -> DataFrame:
    """(node_id, neighbor, edge_id, label, weight) of the nodes in `of`; both directions keep duplicates, an unknown label finds none."""
    edges = graph.edges
    if label is not None:
        edges = edges.where(F.col("label") == label)
    if at is not None:
        edges = edges.where(is_valid_at(at))
    out = edges.select(F.col("src").alias("node_id"), F.col("dst").alias("neighbor"), "edge_id", "label", "weight")
    back = edges.select(F.col("dst").alias("node_id"), F.col("src").alias("neighbor"), "edge_id", "label", "weight")
    found = {"out": out, "in": back, "both": out.unionAll(back)}[direction]
    return found.join(of.select("node_id").distinct(), "node_id")


def edge_between(graph: Graph, src: int, dst: int) -> DataFrame:
    return graph.edges.where((F.col("src") == src) & (F.col("dst") == dst)).orderBy("edge_id").limit(1)


def edge_history(graph: Graph, src: int, dst: int) -> DataFrame:
    return graph.edges.where((F.col("src") == src) & (F.col("dst") == dst))


def pattern(graph: Graph, left: str | None = None, edge: str | None = None, right: str | None = None) -> DataFrame:
    """(a)-[r]->(b): structs a, r, b for each match."""

    def side(name: str, label: str | None) -> DataFrame:
        nodes = graph.nodes if label is None else graph.nodes.where(F.col("label") == label)
        return nodes.select(F.col("node_id").alias(f"{name}_id"), F.struct("node_id", "label", "entity_key", "props").alias(name))

    edges = graph.edges if edge is None else graph.edges.where(F.col("label") == edge)
    edges = edges.select(F.struct("edge_id", "src", "dst", "label", "weight", "props").alias("r"))
    a, b = side("a", left), side("b", right)
    return edges.join(a, F.col("r.src") == F.col("a_id")).join(b, F.col("r.dst") == F.col("b_id")).select("a", "r", "b")


def members(df: DataFrame, of: DataFrame, key: str = "node_id") -> DataFrame:
    return df.join(of.select(key).distinct(), key, "left_semi")


def common_neighbors(graph: Graph) -> DataFrame:
    """(a, b, c) with a < b: each common neighbour c of each pair that has one."""
    simple = graph.simple()
    left = simple.select(F.col("b").alias("c"), "a")
    right = simple.select(F.col("b").alias("c"), F.col("a").alias("b"))
    return left.join(right, "c").where("a < b").select("a", "b", "c")


def open_pairs(graph: Graph) -> DataFrame:
    """(a, b, c) of pairs with common neighbours that aren't neighbours."""
    linked = graph.simple().where("a < b")
    return common_neighbors(graph).join(linked, ["a", "b"], "left_anti")


def trigram_candidates(names: DataFrame, queries: DataFrame, least: int = 1, cap: int | None = None) -> DataFrame:
    """(query_id, node_id, shared): names with at least so many distinct trigrams of a query, most first.

    names has node_id and name, queries has query_id and name.  Trigrams are posted as distinct pairs, so the
    join's work is that of the shared trigrams; a cap keeps so many a query, ties by node_id.
    """
    left = names.select("node_id", F.explode(F.array_distinct(trigrams("name"))).alias("t"))
    right = queries.select("query_id", F.explode(F.array_distinct(trigrams("name"))).alias("t"))
    found = left.join(right, "t").groupBy("query_id", "node_id").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    if cap is None:
        return found
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("shared"), "node_id"))
    return found.withColumn("_rank", rank).where(F.col("_rank") <= cap).drop("_rank")


def endpoint_labels(graph: Graph) -> DataFrame:
    """Distinct (label, src_label, dst_label) of edges."""
    src = graph.nodes.select(F.col("node_id").alias("src"), F.col("label").alias("src_label"))
    dst = graph.nodes.select(F.col("node_id").alias("dst"), F.col("label").alias("dst_label"))
    return graph.edges.join(src, "src").join(dst, "dst").select("label", "src_label", "dst_label").distinct()


def conflicts(chunks: DataFrame) -> DataFrame:
    """Within a label, each visible property in which two chunks differ; kept is the one of the higher score, then lower id.

    chunks has node_id, label, score and props.
    """
    flat = chunks.select("label", "node_id", "score", F.explode("props").alias("key", "value")).where(~F.col("key").startswith("_") & F.col("value").isNotNull())
    a = flat.select("label", "key", F.col("node_id").alias("node_a"), F.col("value").alias("value_a"), F.col("score").alias("score_a"))
    b = flat.select("label", "key", F.col("node_id").alias("node_b"), F.col("value").alias("value_b"), F.col("score").alias("score_b"))
    pairs = a.join(b, ["label", "key"]).where("node_a < node_b AND value_a <> value_b")
    return pairs.withColumn("kept", F.when(F.col("score_b") > F.col("score_a"), F.col("node_b")).otherwise(F.col("node_a")))


def induced(graph: Graph, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends are in nodes, each once."""
    ids = nodes.select("node_id").distinct()
    inside = graph.edges.join(ids.select(F.col("node_id").alias("src")), "src", "left_semi").join(ids.select(F.col("node_id").alias("dst")), "dst", "left_semi")
    return inside.dropDuplicates(["edge_id"])


def dangling(graph: Graph) -> DataFrame:
    """Edges with an end that is no node: edge_id, src, dst, missing."""
    edges = rewritten(graph.edges.select("edge_id", "src", "dst"))  # made once, and counted from its footers
    rows = edges.count()
    ids = portioned(graph.nodes.select("node_id"), rows, "node_id")

    def without(end: str) -> DataFrame:
        return portioned(edges, rows, end).join(ids, F.col(end) == F.col("node_id"), "left_anti").select("edge_id", "src", "dst", F.lit(end).alias("missing"))

    return without("src").unionAll(without("dst"))
