"""The driver's relational tables as property graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import EMBEDDING, Graph, shaped
from ..runtime import cut, portioned

#: Ids of a table's nodes begin at its number times this.
SPAN = 1_000_000_000_000
CODES = {"region": 0, "nation": 1, "customer": 2, "supplier": 3, "part": 4, "orders": 5}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(ts: str) -> Column:
    """Milliseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ)) DIV 1000")


def node_id(name: str, key: str) -> Column:
    return (F.col(key).cast("long") + CODES[name] * SPAN).cast("long")


def _props(**columns: Column) -> Column:
    return F.create_map(*[x for k, c in columns.items() for x in (F.lit(k), c.cast("string"))])


def knowledge(spark: SparkSession, sf_dir: str) -> Graph:
    """Regions, nations, customers, suppliers, parts and orders, and what links them; orders are valid from their date on."""
    t = lambda name: table(spark, sf_dir, name)
    nodes = [
        t("region").select(node_id("region", "r_regionkey").alias("node_id"), F.lit("region").alias("label"), F.col("r_name").alias("entity_key"), _props(name=F.col("r_name")).alias("props"), F.lit(0).cast("long").alias("tx_from")),
        t("nation").select(node_id("nation", "n_nationkey"), F.lit("nation"), F.col("n_name"), _props(name=F.col("n_name")), F.lit(0).cast("long")),
        t("customer").select(node_id("customer", "c_custkey"), F.lit("customer"), F.col("c_name"), _props(name=F.col("c_name"), segment=F.col("c_mktsegment")), F.lit(0).cast("long")),
        t("supplier").select(node_id("supplier", "s_suppkey"), F.lit("supplier"), F.col("s_name"), _props(name=F.col("s_name")), F.lit(0).cast("long")),
        t("part").select(node_id("part", "p_partkey"), F.lit("part"), F.lit(None).cast("string"), _props(name=F.col("p_name"), brand=F.col("p_brand"), size=F.col("p_size")), F.lit(0).cast("long")),
        t("orders").select(node_id("orders", "o_orderkey"), F.lit("orders"), F.lit(None).cast("string"), _props(status=F.col("o_orderstatus"), priority=F.col("o_orderpriority")), millis("o_orderdate")),
    ]
    n = nodes[0]
    for x in nodes[1:]:
        n = n.union(x)
    one, zero = F.lit(1.0), F.lit(0).cast("long")
    lines = t("lineitem")
    line = portioned(lines, lines.count(), "l_orderkey", "l_partkey").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("w"), F.min(millis("l_shipdate")).alias("vf"))
    edges = [
        t("nation").select(node_id("nation", "n_nationkey").alias("src"), node_id("region", "n_regionkey").alias("dst"), F.lit("in_region").alias("label"), one.alias("weight"), zero.alias("valid_from")),
        t("customer").select(node_id("customer", "c_custkey"), node_id("nation", "c_nationkey"), F.lit("located_in"), one, zero),
        t("supplier").select(node_id("supplier", "s_suppkey"), node_id("nation", "s_nationkey"), F.lit("located_in"), one, zero),
        t("orders").select(node_id("orders", "o_orderkey"), node_id("customer", "o_custkey"), F.lit("placed_by"), one, millis("o_orderdate")),
        line.select(node_id("orders", "l_orderkey"), node_id("part", "l_partkey"), F.lit("contains"), F.col("w"), F.col("vf")),
    ]
    e = edges[0]
    for x in edges[1:]:
        e = e.union(x)
    # one edge a pair of nodes, so the pair gives the id
    e = e.withColumn("edge_id", F.xxhash64("src", "dst")).withColumn("tx_from", F.col("valid_from"))
    return Graph.of(n.withColumn("created_at", F.col("tx_from")), e, name="knowledge")


def traffic(spark: SparkSession, sf_dir: str) -> Graph:
    """Users, and an edge from each event's user to that of the next event, weighted by how often that was so."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("event_id"), F.col("user_id").cast("long").alias("user"))
    after = e.select((F.col("event_id") - 1).alias("event_id"), F.col("user").alias("next"))
    pairs = e.join(after, "event_id").groupBy(F.col("user").alias("src"), F.col("next").alias("dst")).agg(F.count("*").cast("double").alias("weight"))
    edges = pairs.withColumn("label", F.lit("follows")).withColumn("edge_id", F.col("src") * 1_000_000_000 + F.col("dst"))
    name = F.concat(F.lit("user-"), F.col("user").cast("string"))
    nodes = e.select("user").distinct().select(F.col("user").alias("node_id"), F.lit("user").alias("label"), name.alias("entity_key"), _props(name=name).alias("props"))
    g = Graph.of(nodes, edges, name="traffic")
    return Graph(cut(g.nodes), cut(g.edges), None, "traffic")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("node_id"), "text", "lang", "source")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("node_id"), F.col("embedding").alias("vec")), EMBEDDING)


def library(spark: SparkSession, sf_dir: str) -> Graph:
    """Documents by source: a node a document, and edges along each source in order of ids."""
    docs = documents(spark, sf_dir)
    nodes = docs.select("node_id", F.lit("document").alias("label"), F.concat(F.lit("doc-"), F.col("node_id").cast("string")).alias("entity_key"), _props(text=F.col("text"), lang=F.col("lang"), source=F.col("source")).alias("props"))
    after = docs.select("node_id", F.lead("node_id").over(Window.partitionBy("source").orderBy("node_id")).alias("next")).where("next IS NOT NULL")
    edges = after.select(F.col("node_id").alias("src"), F.col("next").alias("dst"), F.lit("next").alias("label"), F.lit(1.0).alias("weight"), F.col("node_id").alias("edge_id"))
    return Graph.of(nodes, edges, embeddings(spark, sf_dir), name="library")


KIND_OF = {"signup": "node_created", "view": "node_updated", "click": "edge_created", "purchase": "edge_invalidated", "error": "node_deleted"}


def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a change log: a graph a user, an entity a value's whole part."""
    kind = F.lit(None).cast("string")
    for name, what in KIND_OF.items():
        kind = F.when(F.col("event_type") == name, what).otherwise(kind)
    body = F.to_json(F.struct((F.col("event_id") % 97).alias("id")))
    return table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("sequence"), F.concat(F.lit("user-"), (F.col("user_id") % 10).cast("string")).alias("graph"), millis("ts").alias("timestamp_ms"), kind.alias("kind"), body.alias("payload_json"))
