"""Statistics, integrity, schema discovery and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import csv_type
from ..model import Graph
from .aggregates import degree_distribution, edge_label_counts, label_counts, text_statistics
from .joins import dangling, endpoint_labels

BYTES = {"node": 64, "edge": 96, "term": 128}


def stats(graph: Graph) -> DataFrame:
    """(nodes, edges, avg_degree)."""
    n = graph.nodes.agg(F.count("*").alias("nodes"))
    e = graph.edges.agg(F.count("*").alias("edges"))
    return n.crossJoin(e).select("nodes", "edges", F.round(F.when(F.col("nodes") > 0, 2 * F.col("edges") / F.col("nodes")).otherwise(F.lit(0.0)), 6).alias("avg_degree"))


def detailed_stats(graph: Graph) -> DataFrame:
    """One row: counts, degree distribution, nodes by label and edges by type ("label=n, ..."), and a memory estimate in bytes."""
    from .search import node_documents

    def listed(counts: DataFrame, name: str) -> DataFrame:
        pairs = F.array_sort(F.collect_list(F.struct("label", "n")))
        return counts.agg(F.array_join(F.transform(pairs, lambda p: F.concat(F.coalesce(p["label"], F.lit("unknown")), F.lit("="), p["n"].cast("string"))), ", ").alias(name))

    vectors = graph.embeddings.agg(F.count("*").alias("vectors"), F.coalesce(F.sum(F.size("vec")), F.lit(0)).alias("_floats")) if graph.embeddings is not None else graph.spark.createDataFrame([(0, 0)], "vectors long, _floats long")
    postings, corpus = text_statistics(node_documents(graph))
    terms = postings.agg(F.count_distinct("term").alias("terms"))
    temporal = graph.nodes.agg(F.count(F.when(F.col("tx_from") > 0, 1)).alias("temporal_nodes"))
    row = stats(graph).crossJoin(degree_distribution(graph).drop("avg_degree"))
    for part in (vectors, corpus.select(F.col("n").alias("text_indexed")), terms, temporal, listed(label_counts(graph), "labels"), listed(edge_label_counts(graph), "edge_types")):
        row = row.crossJoin(part)
    memory = BYTES["node"] * F.col("nodes") + BYTES["edge"] * F.col("edges") + 4 * F.col("_floats") + BYTES["term"] * F.col("terms")
    return row.withColumn("memory_bytes", memory).drop("_floats")


def check(graph: Graph) -> DataFrame:
    """Dangling edges; none in a sound graph."""
    return dangling(graph)


def properties(graph: Graph) -> DataFrame:
    """(label, key, n): how many nodes of a label have a visible property."""
    return graph.nodes.select("label", F.explode(F.map_keys("props")).alias("key")).where(~F.col("key").startswith("_")).groupBy("label", "key").agg(F.count("*").alias("n"))


def edge_types(graph: Graph) -> DataFrame:
    return endpoint_labels(graph)


def infer_schema(graph: Graph) -> DataFrame:
    """(label, key, type, present, null_rate, distinct, required, unique, index): the type is the one of the least node that has the property."""
    total = graph.nodes.groupBy("label").agg(F.count("*").alias("total"))
    flat = graph.nodes.select("node_id", "label", F.explode("props").alias("key", "value")).where(~F.col("key").startswith("_") & F.col("value").isNotNull())
    found = flat.groupBy("label", "key").agg(F.count("*").alias("present"), F.count_distinct("value").alias("distinct"), F.min_by(F.coalesce(csv_type(F.col("value")), F.lit("string")), "node_id").alias("type"))
    out = found.join(F.broadcast(total), "label")
    required, unique = F.col("present") == F.col("total"), F.col("present") == F.col("distinct")
    return out.select("label", "key", "type", "present", F.round(1 - F.col("present") / F.col("total"), 3).alias("null_rate"), "distinct", required.alias("required"), unique.alias("unique"), (required & unique).alias("index"))


def violations(graph: Graph, constraints: list[tuple[str, str, str, str, str | None]] | None = None) -> DataFrame:
    """(target, id, label, constraint, property) of each violation of (target, label, constraint, property, type) rows.

    Constraints are type (null passes), required (null fails) and unique (within a label, nulls ignored).
    """
    out = None
    for target, label, constraint, key, kind in graph.settings.schema if constraints is None else constraints:
        rows = graph.nodes.select(F.col("node_id").alias("id"), "label", "props") if target == "node" else graph.edges.select(F.col("edge_id").alias("id"), "label", "props")
        rows, value = rows.where(F.col("label") == label), F.col("props")[key]
        if constraint == "type":
            ok = {"string": F.lit(True), "float": csv_type(value).isin("int", "float")}.get(kind, csv_type(value) == kind)
            bad = rows.where(value.isNotNull() & ~F.coalesce(ok, F.lit(False)))
        elif constraint == "required":
            bad = rows.where(value.isNull())
        else:
            twice = rows.where(value.isNotNull()).groupBy(value.alias("_v")).agg(F.count("*").alias("n")).where("n > 1")
            bad = rows.join(twice, value == F.col("_v"), "left_semi")
        bad = bad.select(F.lit(target).alias("target"), "id", "label", F.lit(constraint).alias("constraint"), F.lit(key).alias("property"))
        out = bad if out is None else out.unionByName(bad)
    return out if out is not None else graph.spark.createDataFrame([], "target string, id long, label string, constraint string, property string")
