"""BM25 of a context query: texts are read once, with the results of before."""

import pytest
from pyspark.sql import functions as F

from graphloom.model import Graph
from graphloom.operators import search
from graphloom.operators.aggregates import text_statistics
from graphloom.plans import context

TEXTS = ["red fox", "Red red dog, lazy", "", None, "a b c", "the quick brown fox jumps over the lazy dog", "ÉTÉ été fox", "red fox"]


@pytest.fixture
def graph(spark):
    nodes = [{"node_id": i, "label": context.SUMMARY if i == 5 else "document", "props": {"text": t}} for i, t in enumerate(TEXTS)]
    return Graph.local(spark, nodes, [{"src": 0, "dst": 1}])


def test_a_hybrid_query_takes_texts_apart_once(graph, monkeypatch):
    calls, plain = [], search.search_tokens
    monkeypatch.setattr(context, "bm25_over", lambda *a: calls.append(1) or search.bm25_over(*a))
    q = context.ContextQuery(text="red lazy fox", mode="hybrid")
    found = {r["node_id"] for r in context.context_query(graph, q).chunks.collect()}
    assert {0, 1, 5, 6, 7} <= found and len(calls) == 1
    seen = []
    monkeypatch.setattr(search, "search_tokens", lambda c: seen.append(c) or plain(c))
    search.bm25_over(search.node_documents(graph), graph.spark.createDataFrame([(0, "fox")], "query_id long, text string")).collect()
    assert seen.count("text") == 3  # of the documents once, of the queries twice


@pytest.mark.parametrize("terms", [0, 1000])
def test_scores_are_those_of_whole_postings(spark, monkeypatch, terms):
    monkeypatch.setattr(search, "_PLAN_TERMS", terms)
    docs = spark.createDataFrame([*enumerate(TEXTS), (0, "red fox"), (0, "fox"), (None, "red")], "node_id long, text string")
    queries = spark.createDataFrame([(1, "Red fox"), (2, "été lazy"), (3, "nowhere"), (4, None), (5, "red red")], "query_id long, text string")
    rows = lambda df: sorted(((r["query_id"], r["node_id"], r["score"]) for r in df.withColumn("score", F.round("score", 9)).collect()), key=str)
    assert rows(search.bm25_over(docs, queries)) == rows(search.bm25(*text_statistics(docs), queries))
    assert search.bm25_over(docs, queries.where("query_id = 4")).collect() == []
    assert search.bm25_over(docs.limit(0), queries).collect() == []
