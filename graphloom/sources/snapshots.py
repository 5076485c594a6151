"""Snapshots as versioned Parquet, the event log as append-only JSON, and recovery from both."""

from __future__ import annotations

import json
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import NotFound
from ..model import Graph

EVENT = "sequence long, graph string, timestamp_ms long, kind string, payload_json string"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def save(graph: Graph, root: str, sequence: int = 0) -> str:
    """Write a snapshot named by the log's sequence; the marker is written last, so a snapshot without it isn't one."""
    at = f"{root}/snapshot-{sequence:020d}"
    graph.nodes.write.mode("overwrite").parquet(f"{at}/nodes")
    graph.edges.write.mode("overwrite").parquet(f"{at}/edges")
    if graph.embeddings is not None:
        graph.embeddings.write.mode("overwrite").parquet(f"{at}/embeddings")
    graph.spark.createDataFrame([(graph.name, sequence, graph.embeddings is not None)], "name string, sequence long, vectors boolean").coalesce(1).write.mode("overwrite").json(f"{at}/meta")
    return at


def listed(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(sequence, path) of complete snapshots, oldest first."""
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return []
    out = []
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        marker = spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "meta/_SUCCESS")
        if name.startswith("snapshot-") and fs.exists(marker):
            out.append((int(name[9:]), f"{root}/{name}"))
    return sorted(out)


def load(spark: SparkSession, path: str) -> Graph:
    meta = spark.read.schema("name string, sequence long, vectors boolean").json(f"{path}/meta").first()
    vectors = spark.read.parquet(f"{path}/embeddings") if meta["vectors"] else None
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"), vectors, meta["name"])


def cleanup(spark: SparkSession, root: str, keep: int = 3) -> list[str]:
    """Delete all but the newest snapshots."""
    old = [path for _, path in listed(spark, root)[:-keep]] if keep else [path for _, path in listed(spark, root)]
    for path in old:
        fs, p = _fs(spark, path)
        fs.delete(p, True)
    return old


def checksum(payload: str) -> int:
    return zlib.crc32(payload.encode())


def append_events(spark: SparkSession, root: str, events: list[tuple]) -> None:
    """Append (sequence, graph, timestamp_ms, kind, payload) to the log, each with its checksum."""
    rows = [(s, g, t, k, p if isinstance(p, str) else json.dumps(p)) for s, g, t, k, p in events]
    spark.createDataFrame(rows, EVENT).withColumn("crc", F.crc32("payload_json")).coalesce(1).write.mode("append").json(root)


def read_events(spark: SparkSession, root: str, after: int = 0) -> tuple[DataFrame, DataFrame]:
    """(events after a sequence, damaged ones)."""
    log = spark.read.schema(EVENT + ", crc long").json(root)
    sound = F.coalesce(F.col("crc") == F.crc32("payload_json"), F.lit(False))
    return log.where(sound & (F.col("sequence") > after)).drop("crc"), log.where(~sound)


def recover(spark: SparkSession, root: str, log: str | None = None) -> Graph:
    """The latest snapshot with the events after it folded in."""
    from ..streaming.cdc import apply_events

    found = listed(spark, root)
    if not found:
        raise NotFound(f"no snapshot in {root}")
    sequence, path = found[-1]
    graph = load(spark, path)
    return graph if log is None else apply_events(graph, read_events(spark, log, sequence)[0])


def compact(spark: SparkSession, log: str, upto: int) -> None:
    """Drop events that a snapshot has: the rest is written beside the log, then takes its place."""
    rest, _ = read_events(spark, log, upto)
    rest.withColumn("crc", F.crc32("payload_json")).write.mode("overwrite").json(log + ".new")
    fs, p = _fs(spark, log)
    fs.delete(p, True)
    fs.rename(spark._jvm.org.apache.hadoop.fs.Path(log + ".new"), p)


def backup(graph: Graph, root: str, label: str, sequence: int = 0) -> str:
    return save(graph, f"{root}/backup-{label}", sequence)
