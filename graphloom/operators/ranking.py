"""Ranking, fusion, normalisation, ordering and lexical reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import rerank_tokens
from ..runtime import numbered

RRF_K = 60


def ranked(scores: DataFrame, key: str = "node_id", score: str = "score") -> DataFrame:
    """scores with a rank from 1 by score, then key."""
    return numbered(scores, [F.desc(score), F.col(key)], "rank")


def top(scores: DataFrame, n: int, key: str = "node_id", score: str = "score") -> DataFrame:
    return scores.orderBy(F.desc(score), key).limit(n)


def fuse(lists: list[tuple[DataFrame, float]], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (node_id, score) lists with weights: the sum of w / (k + rank)."""
    parts = [ranked(df.select("node_id", "score")).select("node_id", (F.lit(float(w)) / (k + F.col("rank"))).alias("part")) for df, w in lists]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.groupBy("node_id").agg(F.sum("part").alias("score"))


def normalized(scores: DataFrame) -> DataFrame:
    """Scores over their maximum, if that is positive."""
    most = scores.agg(F.max("score").alias("_most"))
    return scores.crossJoin(F.broadcast(most)).withColumn("score", F.when(F.col("_most") > 0, F.col("score") / F.col("_most")).otherwise(F.col("score"))).drop("_most")


def property_order(key: str, descending: bool = False) -> list[Column]:
    """Numbers by value and strings by text; nulls last, first when descending; ties by node_id."""
    value = F.col("props")[key]
    number = value.try_cast("double")
    if descending:
        return [value.isNull().desc(), number.desc_nulls_last(), value.desc(), F.desc("node_id")]
    return [value.isNull().asc(), number.asc_nulls_last(), value.asc(), F.asc("node_id")]


def page(df: DataFrame, skip: int | None = None, limit: int | None = None) -> DataFrame:
    df = df.offset(skip) if skip else df
    return df.limit(limit) if limit is not None else df


def context_order(by: str = "relevance", ascending: bool = False) -> list[Column]:
    """relevance, recency or confidence, missing ones 0; ties by node_id in the same direction."""
    value = {"relevance": F.col("score"), "recency": F.coalesce(F.col("valid_from"), F.lit(0)), "confidence": F.coalesce(F.col("confidence"), F.lit(0.0))}[by]
    return [value.asc(), F.asc("node_id")] if ascending else [value.desc(), F.desc("node_id")]


def lexical_score(query: str, label: Column, content: Column) -> Column:
    """0.75 share of query tokens found + 0.2 phrase + 0.05 prefix, of 'label content'."""
    import re

    q = query.strip().lower()
    text = F.lower(F.concat(label, F.lit(" "), content))
    if not q:
        return F.lit(0.0)
    wanted = re.findall("[a-z0-9]+", q)
    if not wanted:
        return F.contains(text, F.lit(q)).cast("double")
    have = rerank_tokens(text)
    overlap = F.aggregate(F.array(*map(F.lit, wanted)), F.lit(0), lambda s, t: s + F.array_contains(have, t).cast("int"))
    return 0.75 * overlap / len(wanted) + 0.2 * F.contains(text, F.lit(q)).cast("double") + 0.05 * F.startswith(text, F.lit(q)).cast("double")


def rerank(chunks: DataFrame, query: str | None, weight: float = 0.35, candidates: int = 50) -> DataFrame:
    """The best candidates' scores blended with the lexical score; a single chunk or a blank query changes nothing."""
    if not query or not query.strip():
        return chunks
    w = min(max(weight, 0.0), 1.0)
    blended = F.least(F.greatest((1 - w) * F.col("score") + w * lexical_score(query, F.col("label"), F.col("content")), F.lit(0.0)), F.lit(1.0))
    best = chunks.select("node_id", "score").orderBy(F.desc("score"), "node_id").limit(candidates).select("node_id", F.lit(True).alias("_best"))
    out = chunks.join(best, "node_id", "left").crossJoin(F.broadcast(chunks.select("node_id").limit(2).agg(F.count("*").alias("_n"))))
    return out.withColumn("score", F.when(F.col("_best") & (F.col("_n") > 1), blended).otherwise(F.col("score"))).select(*chunks.columns)
