"""Change events: replay, live tail, and folding to bi-temporal tables, in batch and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..model import EDGE, NODE, Graph, shaped
from ..operators.filters import allowed

EVENT = "sequence long, graph string, timestamp_ms long, kind string, payload_json string"
KINDS = ("node_created", "node_updated", "node_deleted", "edge_created", "edge_deleted", "edge_invalidated", "graph_created", "graph_dropped")
RING = 10_000
_PAYLOAD = "id long, src long, dst long, label string, entity_key string, weight double, props map<string,string>, ttl_expires_at long"


def replay(events: DataFrame, since: int = 0, graph: str | None = None, limit: int = 0, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """Events after a sequence, the newest `limit` (0: RING) of them, in order."""
    found = events.where(F.col("sequence") > since)
    if graph is not None:
        found = found.where(F.col("graph") == graph)
    if rules:
        found = allowed(found, rules)
    return found.orderBy(F.desc("sequence")).limit(limit or RING).orderBy("sequence")


def stream(spark: SparkSession, path: str, since: int = 0, rules: list[tuple[str, str]] | None = None, files_a_trigger: int = 100) -> DataFrame:
    """Backlog and live events of a log folder as one stream; its checkpoint keeps the place, so none is lost or repeated."""
    found = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_a_trigger).json(path).where(F.col("sequence") > since)
    return allowed(found, rules) if rules else found


def parsed(events: DataFrame) -> DataFrame:
    return events.withColumn("p", F.from_json("payload_json", _PAYLOAD))


def lifetimes(events: DataFrame) -> DataFrame:
    """(graph, entity, id, opened, closed): when each node and edge was created, and the least moment that ended it.

    Entities end when deleted or invalidated, or at their TTL; order doesn't matter, so events may come late.
    """
    e = parsed(events).where(F.col("p.id").isNotNull() & (F.col("kind").startswith("node_") | F.col("kind").startswith("edge_")))
    entity = F.split_part("kind", F.lit("_"), F.lit(1))
    made = F.min(F.when(F.col("kind").endswith("_created"), F.col("timestamp_ms")))
    ended = F.min(F.when(F.col("kind").endswith("_deleted") | F.col("kind").endswith("_invalidated"), F.col("timestamp_ms")))
    return e.groupBy("graph", entity.alias("entity"), F.col("p.id").alias("id")).agg(made.alias("opened"), F.least(ended, F.min("p.ttl_expires_at")).alias("closed"))


def apply_events(graph: Graph, events: DataFrame) -> Graph:
    """The graph after events: created rows come in, updates merge properties by sequence, deleted ones go, invalidated edges close."""
    e = parsed(events)
    entity = F.split_part("kind", F.lit("_"), F.lit(1))
    e = e.withColumn("entity", entity)
    last = e.where("p.id IS NOT NULL").groupBy("entity", F.col("p.id").alias("id")).agg(
        F.max_by(F.struct("timestamp_ms", "p"), F.when(F.col("kind").endswith("_created"), F.col("sequence"))).alias("made"),
        F.max(F.when(F.col("kind").endswith("_deleted"), F.col("sequence"))).alias("gone"),
        F.min(F.when(F.col("kind").endswith("_invalidated"), F.col("timestamp_ms"))).alias("closed"),
        F.array_sort(F.collect_list(F.when(F.col("kind").endswith("_updated"), F.struct("sequence", F.map_entries("p.props").alias("props"))))).alias("updates"),
    )
    empty = F.create_map().cast("map<string,string>")
    merged = lambda base, updates: F.aggregate(updates, F.coalesce(base, empty), lambda m, u: F.map_zip_with(m, F.coalesce(F.map_from_entries(u["props"]), empty), lambda k, a, b: F.coalesce(b, a)))
    nodes = last.where("entity = 'node'")
    fresh = shaped(nodes.where("made IS NOT NULL").select(F.col("id").alias("node_id"), "made.p.label", "made.p.entity_key", "made.p.props", F.col("made.timestamp_ms").alias("created_at"), F.col("made.timestamp_ms").alias("tx_from"), "made.p.ttl_expires_at"), NODE)
    every = graph.nodes.join(fresh.select("node_id"), "node_id", "left_anti").unionByName(fresh)
    changed = every.join(nodes.select(F.col("id").alias("node_id"), "updates", "gone"), "node_id", "left").where("gone IS NULL")
    new_nodes = changed.withColumn("props", F.when(F.size("updates") > 0, merged(F.col("props"), F.col("updates"))).otherwise(F.col("props"))).select(*graph.nodes.columns)
    edges = last.where("entity = 'edge'")
    made = shaped(edges.where("made IS NOT NULL").select(F.col("id").alias("edge_id"), "made.p.src", "made.p.dst", "made.p.label", F.coalesce("made.p.weight", F.lit(1.0)).alias("weight"), "made.p.props", F.col("made.timestamp_ms").alias("valid_from"), F.col("made.p.ttl_expires_at").alias("valid_until"), F.col("made.timestamp_ms").alias("tx_from")), EDGE)
    every = graph.edges.join(made.select("edge_id"), "edge_id", "left_anti").unionByName(made)
    gone = nodes.where("gone IS NOT NULL").select(F.col("id").alias("_n"))
    kept = every.join(edges.select(F.col("id").alias("edge_id"), "gone", "closed"), "edge_id", "left").where("gone IS NULL")
    kept = kept.join(gone, kept["src"] == gone["_n"], "left_anti").join(gone, kept["dst"] == gone["_n"], "left_anti")
    new_edges = kept.withColumn("valid_until", F.least("valid_until", "closed")).withColumn("tx_until", F.least("tx_until", "closed")).select(*graph.edges.columns)
    return Graph(new_nodes, new_edges, graph.embeddings, graph.name, graph.settings)


def _fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    opened, closed = state.get if state.exists else (None, None)
    before = (opened, closed)
    for p in parts:
        for kind, ts, ttl in zip(p["kind"], p["timestamp_ms"], p["ttl"]):
            if kind.endswith("_created"):
                opened = ts if opened is None else min(opened, ts)
            elif kind.endswith(("_deleted", "_invalidated")):
                closed = ts if closed is None else min(closed, ts)
            if ttl == ttl and ttl is not None:
                closed = int(ttl) if closed is None else min(closed, int(ttl))
    state.update((opened, closed))
    if (opened, closed) != before:
        yield pd.DataFrame({"graph": [key[0]], "entity": [key[1]], "id": [key[2]], "opened": [opened], "closed": [closed]}).astype({"opened": "Int64", "closed": "Int64"})


def lifetimes_stream(events: DataFrame) -> DataFrame:
    """lifetimes() as a stream: a row whenever an entity's lifetime changes; the latest row counts."""
    rows = parsed(events).where(F.col("p.id").isNotNull()).select("graph", F.split_part("kind", F.lit("_"), F.lit(1)).alias("entity"), F.col("p.id").alias("id"), "kind", "timestamp_ms", F.col("p.ttl_expires_at").cast("double").alias("ttl"))
    return rows.groupBy("graph", "entity", "id").applyInPandasWithState(_fold, "graph string, entity string, id long, opened long, closed long", "opened long, closed long", "update", GroupStateTimeout.NoTimeout)


def kind_counts(events: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """(window, graph, kind, n) of an event stream or table, with a watermark for late events."""
    timed = events.withColumn("ts", F.timestamp_millis("timestamp_ms")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "graph", "kind").agg(F.count("*").alias("n"))
