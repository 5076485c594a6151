"""A property graph as a bundle of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

PROPS = S.MapType(S.StringType(), S.StringType())
PROVENANCE = S.StructType([S.StructField("source", S.StringType()), S.StructField("confidence", S.DoubleType()), S.StructField("method", S.StringType())])
NODE = S.StructType(
    [
        S.StructField("node_id", S.LongType()),
        S.StructField("label", S.StringType()),
        S.StructField("entity_key", S.StringType()),
        S.StructField("props", PROPS),
        S.StructField("created_at", S.LongType()),
        S.StructField("tx_from", S.LongType()),
        S.StructField("ttl_expires_at", S.LongType()),
        S.StructField("tx_until", S.LongType()),
    ]
)
EDGE = S.StructType(
    [
        S.StructField("edge_id", S.LongType()),
        S.StructField("src", S.LongType()),
        S.StructField("dst", S.LongType()),
        S.StructField("label", S.StringType()),
        S.StructField("weight", S.DoubleType()),
        S.StructField("props", PROPS),
        S.StructField("prov", PROVENANCE),
        S.StructField("valid_from", S.LongType()),
        S.StructField("valid_until", S.LongType()),
        S.StructField("tx_from", S.LongType()),
        S.StructField("tx_until", S.LongType()),
    ]
)
EMBEDDING = S.StructType([S.StructField("node_id", S.LongType()), S.StructField("vec", S.ArrayType(S.FloatType()))])


def shaped(df: DataFrame, schema: S.StructType, **defaults: object) -> DataFrame:
    """df with exactly the columns of schema; absent ones are null or a default."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in schema])


@dataclass(frozen=True)
class Settings:
    """Options of a graph."""

    max_nodes: int | None = None
    max_edges: int | None = None
    default_ttl_ms: int | None = None
    vector_dimensions: int = 1536
    eviction: str = "none"  # none, lru or relevance_decay
    schema: tuple[tuple[str, str, str, str, str | None], ...] = field(default=())  # target, label, constraint, property, type


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    embeddings: DataFrame | None = None
    name: str = "graph"
    settings: Settings = Settings()

    @classmethod
    def of(cls, nodes: DataFrame, edges: DataFrame, embeddings: DataFrame | None = None, **more) -> Graph:
        """A graph of tables that have at least node_id, and src and dst."""
        e = edges if "edge_id" in edges.columns else edges.withColumn("edge_id", F.xxhash64(*edges.columns))
        return cls(shaped(nodes, NODE, label="node", tx_from=0, created_at=0), shaped(e, EDGE, label="edge", weight=1.0, valid_from=0, tx_from=0), None if embeddings is None else shaped(embeddings, EMBEDDING), **more)

    @classmethod
    def local(cls, spark: SparkSession, nodes: list[dict], edges: list[dict], embeddings: list[dict] | None = None, **more) -> Graph:
        """A small graph of dictionaries, for tests and examples."""

        def rows(items: list[dict], schema: S.StructType, **defaults) -> DataFrame:
            return spark.createDataFrame([tuple(x.get(f.name, defaults.get(f.name)) for f in schema) for x in items], schema)

        numbered = [{"edge_id": i + 1, **e} for i, e in enumerate(edges)]
        return cls(
            rows(nodes, NODE, label="node", tx_from=1000, created_at=1000),
            rows(numbered, EDGE, label="edge", weight=1.0, valid_from=1000, tx_from=1000),
            None if embeddings is None else rows(embeddings, EMBEDDING),
            **more,
        )

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def with_edges(self, edges: DataFrame) -> Graph:
        return replace(self, edges=edges)

    def with_nodes(self, nodes: DataFrame) -> Graph:
        return replace(self, nodes=nodes)

    # views of the adjacency
    def out(self) -> DataFrame:
        """(a, b, weight, edge_id): directed edges."""
        return self.edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "weight", "edge_id")

    def both(self) -> DataFrame:
        """(a, b, weight, edge_id): each edge in both directions, parallel edges and self-loops kept."""
        out = self.out()
        return out.unionAll(out.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight", "edge_id"))

    def simple(self) -> DataFrame:
        """(a, b): unique undirected neighbours in both orders, without self-loops."""
        return self.both().where("a <> b").select("a", "b").distinct()
