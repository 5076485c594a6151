"""Plans and bounds: range numbering, pruned budgets, vector indexes, ids beyond doubles, brute force for what SQL can't say."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom import runtime
from graphloom.functions import text
from graphloom.model import Graph
from graphloom.operators import budget, community, flow, paths, profile, search, similarity, traversal


def test_numbers_follow_a_total_order(spark):
    df = spark.range(500).select((F.col("id") * 37 % 501).alias("k"), F.col("id").alias("v"))
    rows = runtime.numbered(df, [F.desc("k"), F.col("v")], "n", 7).orderBy("n").collect()
    assert [r["n"] for r in rows] == list(range(7, 507)) and [r["k"] for r in rows] == sorted((r["k"] for r in rows), reverse=True)
    assert runtime.numbered(df.limit(0), ["k"], "n").count() == 0


def test_greedy_takes_what_a_pass_over_all_chunks_takes(spark):
    r = random.Random(4)
    rows = [(i, r.choice(["a", "edge", "text", "meta"]), r.randrange(50) / 50, r.choice([0, 1, 2, 3, 5, 8, 40, 200, 900])) for i in range(3000)]
    df = spark.createDataFrame(rows, "node_id long, label string, score double, tokens long")
    for tokens in (1, 37, 500):
        used, want = 0, set()
        for i, _, s, t in sorted(rows, key=lambda x: (-(x[2] / x[3]) if x[3] else -1e300, x[0])):
            if used + t <= tokens:
                used, want = used + t, want | {i}
        assert {x["node_id"] for x in budget.greedy(df, tokens).collect()} == want
        most = budget.candidates(df, tokens).count()
        assert most <= sum(tokens // t for t in (1, 2, 3, 5, 8, 40, 200, 900))
    pools, want = {"a": 0, "edge": 1, "text": 2, "meta": 3}, set()
    for p, share in enumerate(budget.STRATEGIES["proportional"]):
        used = 0
        for i, label, s, t in sorted(rows, key=lambda x: (-(x[2] / x[3]) if x[3] else -1e300, x[0])):
            if pools[label] == p and used + t <= int(500 * share):
                used, want = used + t, want | {i}
    assert {x["node_id"] for x in budget.proportional(df, 500).collect()} == want


def test_vector_index_recall_and_blocks(spark, sf_dir, monkeypatch):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("vec"))
    q = e.where("node_id % 100 < 10").select(F.col("node_id").alias("query_id"), "vec")
    vec = {r["node_id"]: np.array(r["vec"], float) for r in e.collect()}
    exact = {r["query_id"]: [] for r in q.collect()}
    for i in exact:
        exact[i] = sorted(vec, key=lambda n: (1 - vec[i] @ vec[n] / np.linalg.norm(vec[i]) / np.linalg.norm(vec[n]), n))[:10]
    pairs = {(i, n) for i, found in exact.items() for n in found}
    for block in (16 << 20, 4000):  # in one block, and in many
        monkeypatch.setattr(search, "_BLOCK_BYTES", block)
        assert {(r["query_id"], r["node_id"]) for r in search.nearest(e, q, 10).collect()} == pairs
    index = search.vector_index(e)
    assert index.rows.count() == len(vec)
    found = {(r["query_id"], r["node_id"]) for r in index.search(q, 10).collect()}
    assert len(found & pairs) >= 0.9 * len(pairs)
    assert {(r["query_id"], r["node_id"]) for r in index.search(q, 10, len(index.centres)).collect()} == pairs
    near = {(r["query_id"], r["node_id"]) for r in search.nearest_quantized(search.quantized(e), e, q, 10).collect()}
    assert len(near & pairs) >= 0.99 * len(pairs)
    back = {r["node_id"]: np.array(r["vec"]) for r in search.restored(search.quantized(e)).collect()}
    assert all(np.abs(back[n] - v).max() <= np.abs(v).max() / 254 + 1e-6 for n, v in vec.items())
    assert search.vector_index(e.limit(0)).search(q, 3).count() == 0


def test_ids_beyond_doubles(spark):
    big = 2**53
    g = Graph.of(spark.createDataFrame([(big + i,) for i in range(3)], "node_id long"), spark.createDataFrame([(big + 2, big + 1), (big + 1, big)], "src long, dst long"))
    assert [r["node_id"] for r in paths.topological_order(g).orderBy("position").collect()] == [big + 2, big + 1, big]
    assert {r["node_id"] for r in community.modularity_communities(g).collect()} == {big, big + 1, big + 2}


def _random_graph(spark, n, m, seed):
    r = random.Random(seed)
    edges = {(r.randrange(n), r.randrange(n)): r.randrange(1, 9) for _ in range(m)}
    rows = [(a, b, float(w), a * 1000 + b) for (a, b), w in edges.items()]
    return Graph.of(spark.createDataFrame([(i,) for i in range(n)], "node_id long"), spark.createDataFrame(rows, "src long, dst long, weight double, edge_id long")), edges


def test_flow_is_a_least_cut(spark):
    g, edges = _random_graph(spark, 7, 18, 2)
    found = flow.max_flow(g, 0, 6).collect()
    cuts = [sum(w for (a, b), w in edges.items() if a in side and b not in side) for k in range(6) for x in itertools.combinations(range(1, 6), k) for side in [{0, *x}]]
    assert found[0]["total"] == pytest.approx(min(cuts))
    assert all(r["flow"] <= edges[r["src"], r["dst"]] for r in found if r["src"] is not None)


def test_attachment_pairs_against_all_pairs(spark):
    g, edges = _random_graph(spark, 60, 150, 5)
    near = {i: {b for a, b in edges if a == i} | {a for a, b in edges if b == i} for i in range(60)}
    k = {i: len(x - {i}) for i, x in near.items()}
    want = sorted((-k[a] * k[b], a, b) for a in range(60) for b in range(a + 1, 60) if b not in near[a] and k[a] and k[b])[:12]
    assert [(-r["score"], r["a"], r["b"]) for r in similarity.predict_links(g, "preferential_attachment", 12).collect()] == want


def test_vectors_of_nodes_against_brute_force(spark):
    g, edges = _random_graph(spark, 20, 50, 7)
    start = {r["node_id"]: [{0: 3**0.5, 5: -(3**0.5)}.get(x, 0.0) for x in r["d"]] for r in g.nodes.select("node_id", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.pmod(F.xxhash64(F.lit(42), "node_id", i), F.lit(6))).alias("d")).collect()}
    links, now = {}, start
    for (a, b), w in edges.items():
        links.setdefault(a, []).append((b, w))
        links.setdefault(b, []).append((a, w))
    for _ in range(3):
        new = {}
        for n in now:
            v = np.sum([w * np.array(now[b]) for b, w in links.get(n, [])], axis=0) / max(1, len(links.get(n, []))) if links.get(n) else np.zeros(16)
            new[n] = v / np.linalg.norm(v) if np.linalg.norm(v) > 1e-10 else v
        now = new
    got = {r["node_id"]: np.array(r["vec"]) for r in flow.fast_rp(g, 16).collect()}
    assert all(np.allclose(got[n], now[n], atol=1e-5) for n in now)


def test_traversal_keeps_its_edges_in_place(spark):
    g, _ = _random_graph(spark, 30, 60, 9)
    edges = runtime.spread(g.out().select("a", "b"), "a")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = spark.range(5).select(F.col("id").alias("a")).join(edges, "a")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1  # of the frontier only
    seeds = spark.createDataFrame([(0, 1.0)], "node_id long, score double")
    assert traversal.bfs(g, seeds, 2).count() > 1


def test_detailed_stats_and_dangling_edges(spark):
    g, edges = _random_graph(spark, 10, 20, 3)
    row = profile.detailed_stats(g).collect()[0]
    assert (row["nodes"], row["edges"], row["labels"], row["edge_types"]) == (10, len(edges), "node=10", f"edge={len(edges)}")
    bad = profile.check(g.with_nodes(g.nodes.where("node_id <> 4"))).collect()
    assert sorted((r["src"], r["dst"]) for r in bad) == sorted([e for e in edges if e[0] == 4] + [e for e in edges if e[1] == 4])


def test_token_counters(spark):
    d = spark.createDataFrame([("Don't stop 12345!",), (None,)], "t string")
    assert [r["tokens"] for r in text.count_tokens(d, "t").collect()] == [5, None]
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    for kind in ("cl100k", "o200k", "exact"):
        assert text.count_tokens(d, "t", kind, path).first()["tokens"] >= 5
    with pytest.raises(ValueError):
        text.count_tokens(d, "t", "cl100k")
