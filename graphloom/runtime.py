"""Lineage cuts in the shared folder, sized broadcasts, and bounded single-task steps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only while rows * bytes a row stay below this.
BROADCAST_BYTES = 64 << 20
#: Rows that an inherently sequential algorithm may gather in one task.
SEQUENTIAL_ROWS = 5_000_000
#: Rows that a task of an exchange of known size takes.
TASK_ROWS = 1 << 19


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, as in tests on one machine, one of our own, set for the session."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not at:
        option = sc._jsc.sc().getCheckpointDir()
        at = option.get() if option.isDefined() else None
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df behind a reliable checkpoint, which outlives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def rewritten(df: DataFrame) -> DataFrame:
    """df behind a table in the shared folder. A checkpoint keeps the plan's constraints, which may grow with each round; a table has none."""
    path = new_path(df.sparkSession, "round")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def sized(df: DataFrame, rows: int, bytes_a_row: int = 64) -> DataFrame:
    return F.broadcast(df) if rows * bytes_a_row <= BROADCAST_BYTES else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df cut and hashed by keys into the session's number of partitions, so that a loop's joins on them move only the other side."""
    conf = df.sparkSession.conf
    adaptive, name = conf.get("spark.sql.adaptive.enabled"), "spark.sql.adaptive.enabled"
    conf.set(name, "false")  # an adaptive plan doesn't tell a checkpoint how it is partitioned
    try:
        return cut(df.repartition(int(conf.get("spark.sql.shuffle.partitions")), *keys))
    finally:
        conf.set(name, adaptive)


def portioned(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df of so many rows hashed by keys into partitions of about TASK_ROWS; adaptive execution doesn't merge them, so that a task's memory doesn't grow with the table."""
    parts = -(-rows // TASK_ROWS)
    return df.repartition(parts, *keys) if parts > 1 else df


def numbered(df: DataFrame, order: list[Column | str], name: str, start: int = 1) -> DataFrame:
    """df with a number by a total order, from `start` on: sorted by range, and numbered with the offsets of the partitions."""
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    placed = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys))  # keeps its partitions and their order
    placed = placed.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at"))
    counts = sorted(placed.groupBy("_part").count().collect())  # a row a partition
    offsets, total = [], start
    for part, n in counts:
        offsets.append((part, total))
        total += n
    table = F.broadcast(df.sparkSession.createDataFrame(offsets, "_part int, _offset long"))
    return placed.join(table, "_part").withColumn(name, F.col("_at") + F.col("_offset")).drop("_part", "_at", "_offset")


def in_one_task(df: DataFrame, step: Callable[[pd.DataFrame], pd.DataFrame], schema: str, most: int = SEQUENTIAL_ROWS) -> DataFrame:
    """Run an inherently sequential step over all of df in one task; an error if df is larger than such a step may be."""
    df = cut(df)  # computed once, in parallel
    rows = df.count()
    if rows > most:
        raise ValueError(f"a sequential step over more than {most} rows; take a subgraph or raise the bound")
    columns = df.columns
    return df.repartition(1).mapInPandas(lambda parts: _gathered(parts, step, columns), schema)


def _gathered(parts, step, columns):
    found = list(parts)
    yield step(pd.concat(found, ignore_index=True) if found else pd.DataFrame(columns=columns))
