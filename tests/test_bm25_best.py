"""The best of BM25 a query, scored in the tasks, against all matches ranked."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import search


def test_best_are_those_of_all_matches_and_no_posting_is_shuffled(spark, monkeypatch):
    draw = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(draw.choices(words, range(1, 41), k=draw.randrange(0, 30))) for _ in range(300)]
    texts += [texts[0]] * 30 + ["", None, "a é", "alone"]
    docs = spark.createDataFrame([(1000 - i, t) for i, t in enumerate(texts)], "node_id long, text string").repartition(5)
    queries = spark.createDataFrame([(1, texts[0]), (2, "w1 w2 w2 w39"), (3, "alone w40"), (4, "nowhere"), (5, ""), (6, None), (7, " ".join(words))], "query_id long, text string")
    want = {}
    for r in search.bm25_over(docs, queries).withColumn("r", F.round("score", 6)).collect():
        want.setdefault(r["query_id"], []).append((-r["r"], r["node_id"], r["score"]))
    monkeypatch.setattr(search, "_CELLS", 64)  # many blocks of queries and documents
    found = search.bm25_best(docs, queries, 7)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["node_id"], pytest.approx(r["score"], abs=1e-9)))
    assert got == {q: [(i, x) for _, i, x in sorted(rows)[:7]] for q, rows in want.items()}
    again = search.bm25_best(docs.unionAll(docs.limit(1)), queries, 7)  # a repeated id
    assert again.count() == sum(min(7, len(x)) for x in want.values())
    assert search.bm25_best(docs.where("false"), queries, 7).collect() == []
