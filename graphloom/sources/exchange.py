"""Graph exchange: JSON, CSV and DOT, and document sources."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import csv_type
from ..model import EDGE, EMBEDDING, NODE, Graph, shaped
from ..operators.filters import visible
from ..runtime import numbered



def _props():
    return F.coalesce("props", F.create_map().cast("map<string,string>"))


def to_json(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges), each one JSON string a row in column value; reserved properties are left out."""
    nodes = graph.nodes
    nodes = nodes.join(graph.embeddings, "node_id", "left") if graph.embeddings is not None else nodes.withColumn("vec", F.lit(None).cast("array<float>"))
    n = nodes.select(F.to_json(F.struct(F.col("node_id").alias("id"), "label", "entity_key", visible(_props()).alias("properties"), F.col("vec").alias("embedding"))).alias("value"))
    e = graph.edges.select(F.to_json(F.struct(F.col("edge_id").alias("id"), F.col("src").alias("source"), F.col("dst").alias("target"), "label", "weight", visible(_props()).alias("properties"), "valid_from", "valid_until")).alias("value"))
    return n, e


def write_json(graph: Graph, path: str) -> None:
    nodes, edges = to_json(graph)
    nodes.write.mode("overwrite").text(f"{path}/nodes")
    edges.write.mode("overwrite").text(f"{path}/edges")


_NODE_JSON = "id long, label string, entity_key string, properties map<string,string>, embedding array<float>, _bad string"
_EDGE_JSON = "id long, source long, target long, label string, weight double, properties map<string,string>, valid_from long, valid_until long, _bad string"


def _json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The fields of a JSON object a line, _bad if it is none, and _raw, the line."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    return lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("x"), F.col("value").alias("_raw")).select("x.*", "_raw")


def read_json(spark: SparkSession, path: str, into: Graph | None = None, now: int = 0) -> tuple[Graph, DataFrame]:
    """(graph, rejects): ids are given anew after those of `into`, edges follow; rejects has kind, value and error."""
    n, e = _json_rows(spark, f"{path}/nodes", _NODE_JSON), _json_rows(spark, f"{path}/edges", _EDGE_JSON)
    top = into.nodes.agg(F.coalesce(F.max("node_id"), F.lit(0))).first()[0] if into else 0
    top_edge = into.edges.agg(F.coalesce(F.max("edge_id"), F.lit(0))).first()[0] if into else 0
    good = n.where("_bad IS NULL AND id IS NOT NULL AND label IS NOT NULL")
    placed = numbered(good, ["id"], "node_id", top + 1)
    ids = placed.select(F.col("id").alias("old"), F.col("node_id").alias("new"))
    linked = e.where("_bad IS NULL").join(ids.select(F.col("old").alias("source"), F.col("new").alias("src")), "source", "left").join(ids.select(F.col("old").alias("target"), F.col("new").alias("dst")), "target", "left")
    edges = numbered(linked.where("src IS NOT NULL AND dst IS NOT NULL"), ["id", "src", "dst"], "edge_id", top_edge + 1).withColumnRenamed("properties", "props").withColumn("weight", F.coalesce("weight", F.lit(1.0))).withColumn("valid_from", F.coalesce("valid_from", F.lit(now)))
    rejects = n.where("_bad IS NOT NULL OR id IS NULL OR label IS NULL").select(F.lit("node").alias("kind"), F.col("_raw").alias("value"), F.lit("a node needs an id and a label").alias("error"))
    rejects = rejects.unionAll(e.where("_bad IS NOT NULL").select(F.lit("edge"), "_raw", F.lit("no JSON")))
    rejects = rejects.unionAll(linked.where("src IS NULL OR dst IS NULL").select(F.lit("edge"), "_raw", F.lit("an end is missing")))
    nodes = shaped(placed.withColumnRenamed("properties", "props"), NODE, tx_from=now, created_at=now)
    vectors = shaped(placed.where("embedding IS NOT NULL").withColumnRenamed("embedding", "vec"), EMBEDDING)
    edges = shaped(edges, EDGE, tx_from=now)
    if into is None:
        return Graph(nodes, edges, vectors), rejects
    every = vectors if into.embeddings is None else into.embeddings.unionByName(vectors)
    return Graph(into.nodes.unionByName(nodes), into.edges.unionByName(edges), every, into.name, into.settings), rejects


def read_csv(spark: SparkSession, path: str, start: int = 1, now: int = 0) -> tuple[DataFrame, DataFrame]:
    """(nodes, types): a column _label is needed, _id is ignored, empty cells are absent properties; types has key, type, n."""
    raw = spark.read.option("header", True).csv(path)
    if "_label" not in raw.columns:
        raise ValueError("a CSV of nodes needs a column _label")
    keys = [c for c in raw.columns if c not in ("_label", "_id")]
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"`{k}`").alias("value")) for k in keys]) if keys else F.array().cast("array<struct<key:string,value:string>>")
    filled = raw.where("_label IS NOT NULL").withColumn("_pairs", F.filter(pairs, lambda p: p["value"].isNotNull() & (p["value"] != "")))
    placed = numbered(filled.withColumn("_line", F.monotonically_increasing_id()), ["_line"], "_number", start)
    nodes = shaped(placed.select(F.col("_number").alias("node_id"), F.col("_label").alias("label"), F.map_from_entries("_pairs").alias("props")), NODE, tx_from=now, created_at=now)
    types = filled.select(F.explode("_pairs").alias("p")).select("p.key", csv_type(F.col("p.value")).alias("type")).groupBy("key", "type").agg(F.count("*").alias("n"))
    return nodes, types


def csv_rows(graph: Graph) -> DataFrame:
    """A row a node: _label and the sorted union of visible keys."""
    keys = [r[0] for r in graph.nodes.select(F.explode(F.map_keys("props")).alias("k")).where(~F.col("k").startswith("_")).distinct().orderBy("k").collect()]  # column names
    return graph.nodes.select(F.col("label").alias("_label"), *[F.col("props")[k].alias(k) for k in keys])


def write_csv(graph: Graph, path: str) -> None:
    csv_rows(graph).write.mode("overwrite").option("header", True).csv(path)


def dot_lines(graph: Graph) -> DataFrame:
    """(part, id, line): a digraph in DOT; ordered by part and id they are the file."""
    quote = lambda c: F.regexp_replace(c, r'(["\\])', r"\\$1")
    name = F.coalesce(F.col("props")["name"], "entity_key", F.col("node_id").cast("string"))
    head = graph.spark.createDataFrame([(0, 0, f'digraph "{graph.name}" {{'), (3, 0, "}")], "part int, id long, line string")
    nodes = graph.nodes.select(F.lit(1).alias("part"), F.col("node_id").alias("id"), F.concat(F.lit("  n"), F.col("node_id").cast("string"), F.lit(' [label="'), quote(F.concat("label", F.lit(": "), name)), F.lit('"];')).alias("line"))
    edges = graph.edges.select(F.lit(2).alias("part"), F.col("edge_id").alias("id"), F.concat(F.lit("  n"), F.col("src").cast("string"), F.lit(" -> n"), F.col("dst").cast("string"), F.lit(' [label="'), quote(F.col("label")), F.lit('"];')).alias("line"))
    return head.unionByName(nodes).unionByName(edges)


def write_dot(graph: Graph, path: str) -> None:
    dot_lines(graph).orderBy("part", "id").select("line").coalesce(1).write.mode("overwrite").text(path)


def document_text(name: str, data: bytes) -> str:
    """Text of a document by its name: plain text, CSV (rows as 'header: value' sentences), DOCX; PDF if a reader is installed."""
    kind = name.lower().rpartition(".")[2]
    if kind == "csv":
        import csv

        rows = list(csv.reader(io.StringIO(data.decode("utf-8", "replace"))))
        return "\n".join(", ".join(f"{h}: {v}" for h, v in zip(rows[0], r)) + "." for r in rows[1:]) if rows else ""
    if kind == "docx":
        space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
        return "\n".join("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p"))
    if kind == "pdf":
        try:
            from pypdf import PdfReader
        except ImportError as e:
            raise NotImplementedError("PDF needs the package pypdf") from e
        return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages)
    return data.decode("utf-8", "replace")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, error) of the files under a path."""

    def convert(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for name, data in zip(p["path"], p["content"]):
                try:
                    out.append((name, document_text(name, data), None))
                except Exception as e:  # one unreadable document is a row with its error
                    out.append((name, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "text", "error"])

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content").mapInPandas(convert, "path string, text string, error string")
