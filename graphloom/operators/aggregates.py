"""Aggregates over node properties, and graph statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import search_tokens
from ..functions.values import number
from ..model import Graph
from ..runtime import sized


def aggregate(kind: str, value: Column | None = None, distinct: bool = False) -> Column:
    """count, sum, avg, min, max or collect of a property; sums and the like skip what is no number."""
    kind = kind.lower()
    if kind == "count":
        return F.count("*") if value is None else F.count_distinct(value) if distinct else F.count(value)
    if value is None:
        raise ValueError(f"{kind} needs a property")
    if kind == "sum":
        return F.coalesce(F.sum(number(value)), F.lit(0.0))
    if kind == "avg":
        return F.avg(number(value))
    if kind in ("min", "max"):
        return getattr(F, kind)(number(value))
    if kind == "collect":  # in order of node ids
        pairs = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(F.col("node_id"), value.alias("v")))))
        return F.transform(pairs, lambda p: p["v"])
    raise ValueError(f"no aggregate {kind}")


def label_counts(graph: Graph) -> DataFrame:
    return graph.nodes.groupBy("label").agg(F.count("*").alias("n"))


def edge_label_counts(graph: Graph) -> DataFrame:
    return graph.edges.groupBy("label").agg(F.count("*").alias("n"))


def degrees(graph: Graph) -> DataFrame:
    """(node_id, degree): incident edges, a self-loop twice; 0 for isolated nodes."""
    found = graph.both().groupBy(F.col("a").alias("node_id")).agg(F.count("*").alias("degree"))
    return graph.nodes.select("node_id").join(found, "node_id", "left").select("node_id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def degree_distribution(graph: Graph) -> DataFrame:
    """min, max, avg and nearest-rank percentiles of the degree: ranks n/2, floor(0.95 n), floor(0.99 n) from 0.

    The degrees are counted first, so that what is ordered is one row a distinct degree and not one a node.
    """
    counts = degrees(graph).groupBy("degree").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("degree"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    ranked = counts.select("degree", "n", upto.alias("upto"), total.alias("total"))

    def at(share: float) -> Column:
        rank = F.least(F.floor(F.col("total") * share), F.col("total") - 1)
        return F.min(F.when(F.col("upto") > rank, F.col("degree")))

    return ranked.agg(
        F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"), F.round(F.sum(F.col("degree") * F.col("n")) / F.sum("n"), 6).alias("avg_degree"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99")
    )


def text_statistics(docs: DataFrame, key: str = "node_id", text: str = "text", terms: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(postings: key, term, tf, dl; corpus: n, avgdl) of documents that have a token; postings only of `terms` (term), if given.

    Other terms are dropped before anything is counted or shuffled.
    """
    words = docs.select(F.col(key).alias("node_id"), search_tokens(text).alias("w")).where(F.size("w") > 0)
    corpus = words.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("avgdl"))
    flat = words.select("node_id", F.size("w").alias("dl"), F.explode("w").alias("term"))
    if terms is not None:
        flat = flat.join(sized(terms, terms.count(), 100), "term", "left_semi")
    postings = flat.groupBy("node_id", "term", "dl").agg(F.count("*").alias("tf"))
    return postings, corpus
