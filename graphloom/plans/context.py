"""The context query: seeds, flow, text, fusion, time, reranking and a token budget, as one DataFrame plan.

Stages, in this order: seeds by vector or key; flow scores from them over out-edges;
BM25; reciprocal rank fusion; chunks; conflicts (reported only); temporal filter;
decay; rerank; limit; budget; relationships; order.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidQuery
from ..functions import decay
from ..functions.text import char_tokens
from ..model import Graph
from ..operators import budget as budgets
from ..operators.filters import EdgeFilter, content, not_expired
from ..operators.joins import conflicts, induced
from ..operators.ranking import context_order, fuse, rerank, top
from ..operators.search import bm25_over, nearest, node_documents
from ..operators.traversal import flow_scores
from ..runtime import cut, sized

SUMMARY = "_community_summary"
ALPHA, THETA = 0.5, 0.01
TEXT_LIMIT = 500


@dataclass(frozen=True)
class ContextQuery:
    text: str | None = None
    vector: list[float] | None = None
    top_k: int = 10
    keys: tuple[str, ...] = ()
    depth: int = 2
    mode: str = "local"  # local, global or hybrid
    budget: budgets.Budget | None = None
    rerank_weight: float | None = None
    rerank_candidates: int = 50
    edge_filter: EdgeFilter | None = None
    apply_edge_filter: bool = False
    decay: tuple[str, object] | None = None
    now: int | None = None
    at: int | None = None
    limit: int | None = None
    sort: tuple[str, bool] = ("relevance", False)  # by, ascending
    extra: dict = field(default_factory=dict)


@dataclass
class ContextResult:
    chunks: DataFrame
    conflicts: DataFrame
    considered: DataFrame

    def totals(self) -> DataFrame:
        """(chunks, tokens)."""
        return self.chunks.agg(F.count("*").alias("chunks"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))

    def subgraph(self, graph: Graph) -> tuple[DataFrame, DataFrame]:
        return self.chunks.select("node_id", "label"), induced(graph, self.chunks)


def explain(q: ContextQuery) -> list[str]:
    """The steps that a query would take, without taking them."""
    steps = []
    if q.vector is not None:
        steps.append(f"vector search: top {q.top_k}")
    if q.keys:
        steps.append(f"seeds by entity key: {len(q.keys)}")
    if q.mode in ("local", "hybrid"):
        steps.append(f"flow scores: alpha {ALPHA}, theta {THETA}, depth {q.depth}")
        if q.text:
            steps.append("full-text search and rank fusion")
    if q.mode in ("global", "hybrid"):
        steps.append("community summaries")
    if q.at is not None:
        steps.append(f"temporal filter: at {q.at}")
    if q.decay:
        steps.append(f"decay: {q.decay[0]}")
    if q.rerank_weight is not None:
        steps.append(f"rerank: weight {q.rerank_weight}, {q.rerank_candidates} candidates")
    steps.append("conflict detection")
    if q.limit is not None:
        steps.append(f"limit: {q.limit}")
    if q.budget:
        steps.append(f"budget: {q.budget.tokens} tokens, {q.budget.allocation}")
    steps.append(f"order by {q.sort[0]}")
    return [f"{i}. {s}" for i, s in enumerate(steps, 1)]


def seeds(graph: Graph, q: ContextQuery) -> tuple[DataFrame | None, DataFrame | None]:
    """(vector seeds, all seeds) as (node_id, score); a node that is both keeps its better score."""
    spark = graph.spark
    by_vector = by_key = None
    if q.vector is not None and graph.embeddings is not None:
        one = spark.createDataFrame([(0, [float(x) for x in q.vector])], "query_id long, vec array<float>")
        by_vector = nearest(graph.embeddings, one, q.top_k).select("node_id", (1 / (1 + F.col("distance"))).alias("score"))
    if q.keys:
        by_key = graph.nodes.where(F.col("entity_key").isin(*q.keys)).groupBy("entity_key").agg(F.min("node_id").alias("node_id")).select("node_id", F.lit(1.0).alias("score"))
    every = [s for s in (by_vector, by_key) if s is not None]
    if not every:
        return None, None
    both = every[0] if len(every) == 1 else every[0].unionAll(every[1])
    return by_vector, both.groupBy("node_id").agg(F.max("score").alias("score"))


def text_matches(graph: Graph, text: str | None) -> DataFrame | None:
    """BM25 (node_id, score) over all nodes' text, made once a query; none for a blank one."""
    if not text or not text.strip():
        return None
    q = graph.spark.createDataFrame([(0, text)], "query_id long, text string")
    return cut(bm25_over(node_documents(graph), q).select("node_id", "score"))


def text_scores(graph: Graph, matches: DataFrame, limit: int, summaries: bool) -> DataFrame:
    """The best of text_matches; then only summary nodes, or only others."""
    is_summary = graph.nodes.where(F.col("label") == SUMMARY).select("node_id")
    return top(matches, limit).join(is_summary, "node_id", "left_semi" if summaries else "left_anti")


def _local(graph: Graph, q: ContextQuery, matches: DataFrame | None) -> tuple[DataFrame | None, DataFrame | None]:
    """((node_id, score), (node_id, depth))."""
    by_vector, start = seeds(graph, q)
    lexical = None if matches is None else cut(text_scores(graph, matches, TEXT_LIMIT, False))
    if start is None:
        if lexical is None:
            return None, None
        start = top(lexical, q.top_k)
        top_score = start.agg(F.max("score").alias("_m"))
        start = start.crossJoin(F.broadcast(top_score)).select("node_id", (F.col("score") / F.col("_m")).alias("score"))
    walked = graph if not (q.apply_edge_filter and q.edge_filter) else graph.with_edges(q.edge_filter(graph.edges))
    flow = flow_scores(walked, start, ALPHA, THETA, q.depth)
    lists = [(flow, 1.0)]
    if by_vector is not None:
        lists.insert(0, (by_vector, 1.0))
    if lexical is not None:
        lists.append((lexical, 0.8))
    return (fuse(lists) if len(lists) > 1 else flow.select("node_id", "score")), flow.select("node_id", "depth")


def _global(graph: Graph, q: ContextQuery, matches: DataFrame | None) -> DataFrame:
    if matches is not None:
        return text_scores(graph, matches, max(q.limit or 10, 10) * 5, True)
    members = F.coalesce(F.col("props")["member_count"].try_cast("double"), F.lit(0.0))
    return graph.nodes.where(F.col("label") == SUMMARY).select("node_id", members.alias("score"))


def scores(graph: Graph, q: ContextQuery) -> tuple[DataFrame, DataFrame | None]:
    """((node_id, score) of the nodes considered, (node_id, depth))."""
    if q.mode not in ("local", "global", "hybrid"):
        raise InvalidQuery(f"retrieval mode {q.mode} isn't supported")
    matches = text_matches(graph, q.text)
    local, depth = _local(graph, q, matches) if q.mode != "global" else (None, None)
    wide = _global(graph, q, matches) if q.mode != "local" else None
    if local is None and wide is None:
        raise InvalidQuery("a context query needs text, a vector or keys")
    if local is None or wide is None:
        return (local if wide is None else wide), depth
    local, wide = cut(local), cut(wide)
    if wide.isEmpty():
        return local, depth
    return (fuse([(local, 1.0), (wide, 1.0)]) if not local.isEmpty() else wide), depth


def relationships(graph: Graph, chunks: DataFrame) -> DataFrame:
    """(node_id, relationships): all edges of the chunks, out and in, with the other end's name."""
    name = F.coalesce(F.col("props")["name"], "entity_key")
    names = graph.nodes.select(F.col("node_id").alias("other"), name.alias("name"))
    out = graph.edges.select(F.col("src").alias("node_id"), F.col("dst").alias("other"), "label", "weight", F.lit("out").alias("direction"))
    into = graph.edges.select(F.col("dst").alias("node_id"), F.col("src").alias("other"), "label", "weight", F.lit("in").alias("direction"))
    found = out.unionAll(into).join(chunks.select("node_id"), "node_id", "left_semi").join(names, "other", "left")
    return found.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("label", "direction", "other", "name", "weight"))).alias("relationships"))


def context_query(graph: Graph, q: ContextQuery) -> ContextResult:
    considered, depth = scores(graph, q)
    considered = cut(considered)
    rows = sized(considered, considered.count()).join(graph.nodes, "node_id")  # texts stay where they are
    rows = rows.join(depth, "node_id", "left") if depth is not None else rows.withColumn("depth", F.lit(0))
    confidence = F.when(F.col("props")["provenance"].isNotNull() | F.col("props")["source"].isNotNull(), F.lit(1.0))
    chunks = rows.select("node_id", "label", "score", F.coalesce("depth", F.lit(0)).alias("depth"), "props", content(F.col("props")).alias("content"), F.coalesce(F.col("props")["provenance"], F.col("props")["source"]).alias("provenance"), confidence.alias("confidence"), F.col("tx_from").alias("valid_from"), "tx_from", "ttl_expires_at", "created_at")
    chunks = cut(chunks.withColumn("tokens", char_tokens("content")))
    found = conflicts(chunks)
    if q.at is not None:
        chunks = chunks.where(not_expired(q.at))
    if q.decay and q.decay[0] != "none":
        if q.now is None:
            raise InvalidQuery("decay needs now")
        chunks = chunks.withColumn("score", decay.apply(q.decay[0], F.col("score"), F.coalesce("created_at", F.lit(0)), q.now, q.decay[1])).where("score > 0")
    if q.rerank_weight is not None:
        chunks = rerank(chunks, q.text, q.rerank_weight, q.rerank_candidates)
    if q.limit is not None:
        chunks = top(chunks, q.limit)
    if q.budget is not None:
        chunks = budgets.enforce(chunks, q.budget)
    chunks = chunks.join(relationships(graph, chunks), "node_id", "left")
    chunks = chunks.orderBy(*context_order(*q.sort)).drop("props", "tx_from", "created_at")
    return ContextResult(chunks, found, considered)


def messages(result: ContextResult, kind: str = "raw", query: str | None = None) -> DataFrame:
    """(payload): the chunks as one document, as JSON messages of a provider's form, or raw."""
    block = F.format_string("[%s] (score: %.2f)\n%s", F.col("label"), F.col("score"), F.col("content"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "node_id", block.alias("t"))))
    text = result.chunks.agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n\n").alias("text"))
    if kind == "raw":
        return text.select(F.col("text").alias("payload"))
    ask = F.lit(query or "")
    if kind == "openai":
        parts = F.array(F.struct(F.lit("system").alias("role"), F.col("text").alias("content")), F.struct(F.lit("user").alias("role"), ask.alias("content")))
        return text.select(F.to_json(parts).alias("payload"))
    if kind == "anthropic":
        whole = F.concat(F.lit("<context>\n"), F.col("text"), F.lit("\n</context>\n\n"), ask)
        return text.select(F.to_json(F.array(F.struct(F.lit("user").alias("role"), F.array(F.struct(F.lit("text").alias("type"), whole.alias("text"))).alias("content")))).alias("payload"))
    raise InvalidQuery(f"no message format {kind}")


def as_json(result: ContextResult) -> str:
    return json.dumps([r.asDict(True) for r in result.chunks.drop("valid_from").toLocalIterator()], ensure_ascii=False)
