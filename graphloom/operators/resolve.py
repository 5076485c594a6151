"""Entity resolution, merging and document ingest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaro_winkler, same_name
from ..model import EDGE, NODE, Graph, shaped
from ..runtime import numbered
from .joins import trigram_candidates
from .search import nearest

NAME_THRESHOLD, VECTOR_THRESHOLD, LINK_THRESHOLD, LINK_CAP = 0.85, 0.92, 0.92, 8


def _best(found: DataFrame, score: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "node_id"))
    return found.withColumn("_r", rank).where("_r = 1").drop("_r")


def match_key(graph: Graph, queries: DataFrame) -> DataFrame:
    """(query_id, node_id): the first node of the same entity_key as each query (query_id, entity_key)."""
    return graph.nodes.where("entity_key IS NOT NULL").join(queries, "entity_key").groupBy("query_id").agg(F.min("node_id").alias("node_id"))


def match_name(graph: Graph, queries: DataFrame, threshold: float = NAME_THRESHOLD, same_label: bool = True, key: str = "name") -> DataFrame:
    """(query_id, node_id, score): the best node by Jaro-Winkler, case-sensitive, for queries (query_id, name, label).

    Every node of the label is compared, as any pair may qualify; resolve_blocked compares those with a common trigram.
    """
    names = graph.nodes.select("node_id", F.col("label").alias("node_label"), F.col("props")[key].alias("node_name")).where("node_name IS NOT NULL")
    on = (names["node_label"] == queries["label"]) if same_label else F.lit(True)
    found = names.join(queries, on).withColumn("score", jaro_winkler("node_name", "name")).where(F.col("score") >= threshold)
    return _best(found.select("query_id", "node_id", "score"), "score")


def match_blocked(names: DataFrame, queries: DataFrame, threshold: float = NAME_THRESHOLD, cap: int | None = None, case_sensitive: bool = True) -> DataFrame:
    """(query_id, node_id, score): the best of the nodes (node_id, name) that share a trigram with a query (query_id, name)."""
    pairs = trigram_candidates(names, queries, 1, cap).join(names, "node_id").join(queries.withColumnRenamed("name", "query_name"), "query_id")
    a, b = (F.col("name"), F.col("query_name")) if case_sensitive else (F.lower("name"), F.lower("query_name"))
    return _best(pairs.withColumn("score", jaro_winkler(a, b)).where(F.col("score") >= threshold).select("query_id", "node_id", "score"), "score")


def match_vector(graph: Graph, queries: DataFrame, threshold: float = VECTOR_THRESHOLD, among: int = 5) -> DataFrame:
    """(query_id, node_id, score): the nearest of five by cosine similarity, if that is over the threshold."""
    found = nearest(graph.embeddings, queries, among).withColumn("score", 1 - F.col("distance"))
    return _best(found.where(F.col("score") > threshold).select("query_id", "node_id", "score"), "score")


def fuzzy_equal(a: Column, b: Column, threshold: float = NAME_THRESHOLD) -> Column:
    return same_name(a, b, threshold)


def merged_properties(old: Column, new: Column, policy: str = "last_write_wins") -> Column:
    """Properties of both; of a conflict the new value, or with reject the old one."""
    keep = (lambda k, a, b: F.coalesce(a, b)) if policy == "reject" else (lambda k, a, b: F.coalesce(b, a))
    return F.map_zip_with(old, new, keep)


def property_conflicts(old: Column, new: Column) -> Column:
    """(key, old, new) of properties that both have and that differ, by key."""
    both = F.map_filter(F.map_zip_with(old, new, lambda k, a, b: F.struct(a.alias("old"), b.alias("new"))), lambda k, v: v["old"].isNotNull() & v["new"].isNotNull() & (v["old"] != v["new"]))
    return F.transform(F.array_sort(F.map_entries(both)), lambda e: F.struct(e["key"].alias("key"), e["value"]["old"].alias("old"), e["value"]["new"].alias("new")))


def merge_nodes(graph: Graph, source: int, target: int, policy: str = "keep_target") -> Graph:
    """source merged into target: absent properties copied, conflicts by policy, edges relinked with new ids, self-loops dropped."""
    if policy not in ("keep_target", "keep_source", "merge"):
        raise ValueError(f"no policy {policy}")
    given = graph.nodes.where(F.col("node_id") == source).select(F.col("props").alias("_p"))
    old, new = F.coalesce("props", F.create_map().cast("map<string,string>")), F.coalesce("_p", F.create_map().cast("map<string,string>"))
    pick = merged_properties(old, new, "last_write_wins" if policy == "keep_source" else "reject")
    nodes = graph.nodes.where(F.col("node_id") != source).join(F.broadcast(given), F.col("node_id") == target, "left").withColumn("props", F.when(F.col("node_id") == target, pick).otherwise(F.col("props"))).select(*graph.nodes.columns)
    touched = (F.col("src") == source) | (F.col("dst") == source)
    top = graph.edges.agg(F.coalesce(F.max("edge_id"), F.lit(0)).alias("_top"))
    move = lambda c: F.when(F.col(c) == source, F.lit(target)).otherwise(F.col(c)).cast("long")
    moved = graph.edges.where(touched).withColumn("src", move("src")).withColumn("dst", move("dst")).where("src <> dst")
    moved = numbered(moved, ["edge_id"], "_number").crossJoin(F.broadcast(top)).withColumn("edge_id", F.col("_top") + F.col("_number")).select(*graph.edges.columns)
    edges = graph.edges.where(~touched).unionByName(moved)
    vectors = graph.embeddings
    if vectors is not None:
        own = vectors.where(F.col("node_id") == target)
        copied = vectors.where(F.col("node_id") == source).withColumn("node_id", F.lit(target).cast("long")).join(own.select("node_id"), "node_id", "left_anti")
        vectors = vectors.where(F.col("node_id") != source).unionByName(copied.select(*vectors.columns))
    return Graph(nodes, edges, vectors, graph.name, graph.settings)


def split_text(text: str, size: int) -> list[tuple[int, int]]:
    """(start, end) of chunks of at most size characters, at paragraph, sentence, word or no boundary, whichever is widest; chunks are trimmed."""
    out, at, n = [], 0, len(text)
    while at < n:
        while at < n and text[at].isspace():
            at += 1
        if at >= n:
            break
        end = min(n, at + size)
        if end < n:
            part = text[at : end + 1]
            for mark, keep in (("\n\n", 0), ("\n", 0), (". ", 1), ("! ", 1), ("? ", 1), (" ", 0)):
                cut = part.rfind(mark)
                if cut > 0:
                    end = at + cut + keep
                    break
        stop = end
        while stop > at and text[stop - 1].isspace():
            stop -= 1
        if stop > at:
            out.append((at, stop))
        at = max(end, at + 1)
    return out


def chunk(docs: DataFrame, size: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, chunk, start, end, content, tokens): chunks by characters, without overlap, with UTF-8 byte offsets."""

    def cut_up(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for i, t in zip(p["k"], p["t"]):
                at = before = 0
                for j, (a, b) in enumerate(split_text(t, size) if t else []):
                    at += len(t[before:a].encode())
                    end = at + len(t[a:b].encode())
                    rows.append((i, j, at, end, t[a:b], -(-(end - at) // 4)))
                    at, before = end, b
            yield pd.DataFrame(rows, columns=["doc_id", "chunk", "start", "end", "content", "tokens"])

    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInPandas(cut_up, "doc_id long, chunk int, start long, end long, content string, tokens long")


def resolve_aliases(names: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """names with canonical: aliases followed to their end; a cycle ends where it closes."""
    final = {}
    for a in aliases:
        seen, at = {a}, aliases[a]
        while at in aliases and at not in seen:
            seen.add(at)
            at = aliases[at]
        final[a] = at
    table = names.sparkSession.createDataFrame(list(final.items()) or [("", "")], "name string, _to string")
    return names.join(F.broadcast(table), "name", "left").withColumn("canonical", F.coalesce("_to", "name")).drop("_to")


def dedup_entities(entities: DataFrame, threshold: float = NAME_THRESHOLD) -> DataFrame:
    """(name, label, confidence, kept): each entity's representative, the first in order of names it is fuzzily equal to; confidence its group's largest.

    Pairs are those of a label that share a trigram; representatives are the first of their connected group.
    """
    from .paths import least_labels

    table = numbered(entities.groupBy("name", "label").agg(F.max("confidence").alias("confidence")), ["label", "name"], "id")
    names = table.select(F.col("id").alias("node_id"), F.lower("name").alias("name"))
    pairs = trigram_candidates(names, names.select(F.col("node_id").alias("query_id"), "name")).where("node_id < query_id")
    l, r = table.select(F.col("id").alias("node_id"), F.col("name").alias("n1"), F.col("label").alias("l1")), table.select(F.col("id").alias("query_id"), F.col("name").alias("n2"), F.col("label").alias("l2"))
    alike = pairs.join(l, "node_id").join(r, "query_id").where("l1 = l2").where(same_name(F.col("n1"), F.col("n2"), threshold))
    roots = least_labels(alike.select(F.col("node_id").alias("a"), F.col("query_id").alias("b")), table.select(F.col("id").alias("node_id")))
    joined = table.join(roots, table["id"] == roots["node_id"])
    first = joined.groupBy("root").agg(F.min_by("name", "id").alias("kept"), F.max("confidence").alias("top"))
    return joined.join(first, "root").select("name", "label", F.col("top").alias("confidence"), "kept")


def dedup_relations(relations: DataFrame) -> DataFrame:
    """One relation of each lower-case (source, target, type), the one of most confidence."""
    rank = F.row_number().over(Window.partitionBy(F.lower("source"), F.lower("target"), F.lower("type")).orderBy(F.desc("confidence"), "source", "target"))
    return relations.withColumn("_r", rank).where("_r = 1").drop("_r")


Extractor = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
ENTITIES = "doc_id long, name string, label string, description string, confidence double"
RELATIONS = "doc_id long, source string, target string, type string, confidence double"


def ingest(graph: Graph, docs: DataFrame, extract_entities: Extractor | None = None, extract_relations: Extractor | None = None, aliases: dict[str, str] | None = None, size: int = 512, now: int = 0) -> Graph:
    """Chunks as nodes, and what pluggable extractors (over chunks, by mapInPandas) find: entities resolved against the graph, relations as edges."""
    chunks = chunk(docs, size)
    start = graph.nodes.agg(F.coalesce(F.max("node_id"), F.lit(0))).first()[0]
    chunks = numbered(chunks, ["doc_id", "chunk"], "_number", start + 1)
    props = F.create_map(F.lit("content"), "content", F.lit("doc_id"), F.col("doc_id").cast("string"), F.lit("chunk"), F.col("chunk").cast("string"))
    nodes = graph.nodes.unionByName(shaped(chunks.select(F.col("_number").alias("node_id"), F.lit("chunk").alias("label"), props.alias("props")), NODE, tx_from=now, created_at=now))
    if extract_entities is None:
        return Graph(nodes, graph.edges, graph.embeddings, graph.name, graph.settings)
    found = resolve_aliases(chunks.mapInPandas(extract_entities, ENTITIES), aliases or {}).withColumn("name", F.col("canonical")).drop("canonical")
    kept = dedup_entities(found).select("label", "confidence", F.col("kept").alias("name")).distinct().groupBy("name").agg(F.min("label").alias("label"), F.max("confidence").alias("confidence"))
    described = found.groupBy("name").agg(F.min("description").alias("description"))
    wanted = numbered(kept.join(described, "name", "left"), ["name"], "query_id")
    by_key = match_key(graph, wanted.select("query_id", F.lower("name").alias("entity_key")))
    names = graph.nodes.select("node_id", F.col("props")["name"].alias("name"), "label").where("name IS NOT NULL")
    near = match_blocked(names.select("node_id", "name"), wanted.select("query_id", "name"), LINK_THRESHOLD, LINK_CAP, False).join(names.select("node_id", F.col("label").alias("nl")), "node_id").join(wanted.select("query_id", "label"), "query_id").where("nl = label").select("query_id", F.col("node_id").alias("near"))
    linked = wanted.join(by_key.withColumnRenamed("node_id", "own"), "query_id", "left").join(near, "query_id", "left").withColumn("linked", F.coalesce("own", "near"))
    top = nodes.agg(F.max("node_id")).first()[0] or 0
    placed = linked.withColumn("node_id", F.coalesce("linked", (F.col("query_id") + top)))
    fresh = placed.where("linked IS NULL").select("node_id", "label", F.lower("name").alias("entity_key"), F.create_map(F.lit("name"), "name", F.lit("description"), F.coalesce("description", F.lit("")), F.lit("confidence"), F.col("confidence").cast("string")).alias("props"))
    nodes = nodes.unionByName(shaped(fresh, NODE, tx_from=now, created_at=now))
    edges = graph.edges
    if extract_relations is not None:
        ids = placed.select(F.lower("name").alias("k"), "node_id")
        r = dedup_relations(chunks.mapInPandas(extract_relations, RELATIONS)).join(ids.select(F.col("k").alias("ks"), F.col("node_id").alias("src")), F.lower("source") == F.col("ks")).join(ids.select(F.col("k").alias("kt"), F.col("node_id").alias("dst")), F.lower("target") == F.col("kt"))
        last = edges.agg(F.coalesce(F.max("edge_id"), F.lit(0))).first()[0]
        new = numbered(r, ["src", "dst", "type"], "edge_id", last + 1).select("edge_id", "src", "dst", F.col("type").alias("label"), F.struct(F.lit("ingest").alias("source"), F.col("confidence").alias("confidence"), F.lit("llm_extracted").alias("method")).alias("prov"))
        edges = edges.unionByName(shaped(new, EDGE, weight=1.0, valid_from=now, tx_from=now))
    return Graph(nodes, edges, graph.embeddings, graph.name, graph.settings)
