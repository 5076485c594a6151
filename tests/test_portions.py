"""Exchanges whose tasks take a bounded number of rows, whatever the table."""

import pytest
from pyspark.sql import functions as F

from graphloom import runtime
from graphloom.model import Graph
from graphloom.operators import joins
from graphloom.sources import tables


@pytest.fixture
def small(spark, monkeypatch):
    monkeypatch.setattr(runtime, "TASK_ROWS", 500)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_dangling_edges_are_found_by_tasks_of_bounded_size(spark, small):
    nodes = spark.range(0, 3000).where("id % 100 <> 7").select(F.col("id").alias("node_id"))
    edges = spark.range(0, 20000).select((F.col("id") % 3000).alias("src"), (F.col("id") * 7 % 3001).alias("dst"), F.col("id").alias("edge_id"))
    gone = lambda x: x % 100 == 7 or x >= 3000
    ends = [(i, i % 3000, i * 7 % 3001) for i in range(20000)]
    want = sorted([(i, a, b, "src") for i, a, b in ends if gone(a)] + [(i, a, b, "dst") for i, a, b in ends if gone(b)])
    found = joins.dangling(Graph.of(nodes, edges))
    assert sorted(tuple(r) for r in found.collect()) == want
    assert found.rdd.getNumPartitions() >= 2 * 20000 // 500
    assert joins.dangling(Graph.of(nodes, edges.limit(0))).collect() == []


def test_lines_are_summed_by_tasks_of_bounded_size(spark, sf_dir, small):
    lines = tables.table(spark, sf_dir, "lineitem")
    edges = tables.knowledge(spark, sf_dir).edges.where("label = 'contains'")
    assert f", {-(-lines.count() // 500)}), REPARTITION_BY_NUM" in edges._jdf.queryExecution().executedPlan().toString()
    assert edges.count() == lines.select("l_orderkey", "l_partkey").distinct().count()
