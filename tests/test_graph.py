"""Micro-graphs with values derived by hand from the operators' formulas."""

import math

import pytest
from pyspark.sql import functions as F

from graphloom.errors import Conflict, InvalidQuery, NotFound
from graphloom.model import Graph
from graphloom.operators import aggregates, budget, centrality, community, filters, flow, importance, joins, paths, profile, ranking, resolve, search, similarity, timeline, traversal
from graphloom.operators.filters import EdgeFilter, NodeFilter


def make(spark, edges, n=None, **more):
    ids = sorted({x for e in edges for x in e[:2]} | set(range(1, (n or 0) + 1)))
    rows = [{"src": e[0], "dst": e[1], "weight": float(e[2]) if len(e) > 2 else 1.0, **(e[3] if len(e) > 3 else {})} for e in edges]
    return Graph.local(spark, [{"node_id": i, **more} for i in ids], rows)


def seeds(spark, *ids):
    return spark.createDataFrame([(i, 1.0) for i in ids], "node_id long, score double")


def table(df, *keys):
    return {r[keys[0]]: r[keys[1]] for r in df.collect()}


def both(*pairs):
    return [p for a, b in pairs for p in ((a, b), (b, a))]


@pytest.fixture(scope="module")
def linear(spark):
    return make(spark, [(1, 2), (2, 3), (3, 4)])


@pytest.fixture(scope="module")
def star(spark):
    return make(spark, [(1, i) for i in (2, 3, 4, 5)])


@pytest.fixture(scope="module")
def two_triangles(spark):
    return make(spark, both((1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (3, 4)))


def test_bfs(spark, linear):
    assert table(traversal.bfs(linear, seeds(spark, 1), 3), "node_id", "depth") == {1: 0, 2: 1, 3: 2, 4: 3}
    assert traversal.bfs(linear, seeds(spark, 1), 1).count() == 2
    assert traversal.bfs(linear, seeds(spark, 1), 3, max_nodes=2).count() == 2
    assert table(traversal.bfs(linear, seeds(spark, 3), 3, direction="in"), "node_id", "parent") == {3: None, 2: 3, 1: 2}


def test_edge_and_node_filters(spark):
    g = make(spark, [(1, 2, 0.5, {"prov": ("s", 0.5, None)}), (1, 3, 0.9, {"prov": ("s", 0.9, None)}), (1, 4, 0.9)])
    reached = lambda **f: set(table(traversal.bfs(g, seeds(spark, 1), 1, edge_filter=EdgeFilter(**f)), "node_id", "depth"))
    assert reached(min_weight=0.8) == {1, 3, 4}
    assert reached(min_confidence=0.7) == {1, 3}
    assert reached(valid_at=999) == {1} and reached(valid_at=1000) == {1, 2, 3, 4}
    assert reached(max_age_ms=10, now=1010) == {1, 2, 3, 4} and reached(max_age_ms=9, now=1010) == {1}
    assert NodeFilter(valid_at=1000)(g).count() == 4


def test_flow_takes_the_best_path(spark):
    g = make(spark, [(1, 2), (1, 3), (2, 4), (3, 4)])
    assert table(traversal.flow_scores(g, seeds(spark, 1), 0.8, 0.01, 3), "node_id", "score") == pytest.approx({1: 1.0, 2: 0.8, 3: 0.8, 4: 0.64})


def test_paths(spark, linear):
    assert paths.shortest_path(linear, 1, 4).first()["path"] == [1, 2, 3, 4]
    g = make(spark, [(1, 2, 0.1), (2, 3, 0.1), (1, 3, 1.0)])
    row = paths.dijkstra(g, 1, 3).first()
    assert row["path"] == [1, 3] and row["cost"] == 1.0
    assert table(paths.bellman_ford(g, 1), "node_id", "dist") == pytest.approx({1: 0.0, 3: 1.0, 2: 10.0})
    assert paths.a_star(g, 1, 3).first()["path"] == [1, 3]
    k = paths.k_shortest(make(spark, [(1, 2), (2, 4), (1, 3), (3, 4)]), 1, 4, 5).collect()
    assert [r["cost"] for r in k] == [2.0, 2.0]
    with pytest.raises(NotFound):
        paths.a_star(g, 1, 99)
    scored = paths.scored_paths(linear, spark.createDataFrame([(1, 1.0), (3, 0.5)], "node_id long, score double")).first()
    assert scored["path"] == [1, 2, 3] and scored["reliability"] == pytest.approx(0.75)


def test_components_and_order(spark, linear):
    g = make(spark, [(1, 2), (3, 4)], n=5)
    assert table(paths.connected_components(g), "node_id", "component") == {1: 0, 2: 0, 3: 1, 4: 1, 5: 2}
    scc = make(spark, [(1, 2), (2, 3), (3, 1), (3, 4)])
    assert table(paths.strong_components(scc), "node_id", "component") == {1: 1, 2: 1, 3: 1, 4: 4}
    assert [r["node_id"] for r in paths.topological_order(linear).collect()] == [1, 2, 3, 4]
    with pytest.raises(Exception, match="cycle"):
        paths.topological_order(scc).collect()


def test_centralities(spark, star):
    assert table(centrality.degree(star), "node_id", "score")[1] == 1.0
    assert table(centrality.simple_degree(star), "node_id", "score")[2] == 0.25
    ppr = table(centrality.personalized_pagerank(star, seeds(spark, 1)), "node_id", "score")
    assert max(ppr, key=ppr.get) == 1 and ppr[2] == pytest.approx(ppr[5])
    assert sum(ppr.values()) == pytest.approx(1.0)
    path = make(spark, both((1, 2), (2, 3)))
    assert table(centrality.closeness(path), "node_id", "score") == pytest.approx({1: 2 / 3, 2: 1.0, 3: 2 / 3})
    assert table(centrality.harmonic(path), "node_id", "score") == pytest.approx({1: 0.75, 2: 1.0, 3: 0.75})
    four = make(spark, [(1, 2), (2, 3), (3, 4)])
    assert table(centrality.betweenness(four), "node_id", "score") == pytest.approx({1: 0, 2: 2, 3: 2, 4: 0})
    tri = make(spark, both((1, 2), (2, 3), (1, 3)))
    assert centrality.triangle_count(tri).first()[0] == 1
    assert set(table(centrality.local_clustering(tri), "node_id", "score").values()) == {1.0}
    assert set(table(centrality.core_numbers(tri), "node_id", "core").values()) == {2}
    assert set(table(centrality.core_numbers(star), "node_id", "core").values()) == {1}
    e = table(centrality.eigenvector(tri), "node_id", "score")
    assert e == pytest.approx({1: 1.0, 2: 1.0, 3: 1.0})
    k = table(centrality.katz(star), "node_id", "score")
    assert sum(x * x for x in k.values()) == pytest.approx(1.0) and k[1] > k[2]
    h = {r["node_id"]: r for r in centrality.hits(star, 5).collect()}
    assert h[1]["hub"] == pytest.approx(1.0) and h[2]["authority"] == pytest.approx(0.5)
    assert centrality.article_rank(star).count() == 5


def test_communities(spark, two_triangles):
    for found in (community.modularity_communities(two_triangles), community.leiden(two_triangles), community.label_propagation(two_triangles)):
        groups = {}
        for n, c in table(found, "node_id", "community").items():
            groups.setdefault(c, set()).add(n)
        assert sorted(map(sorted, groups.values())) == [[1, 2, 3], [4, 5, 6]]
    assert community.modularity(two_triangles, community.modularity_communities(two_triangles)).first()[0] > 0
    colors = community.coloring(two_triangles)
    report = community.color_report(two_triangles, colors).first()
    assert report["conflicts"] == 0 and report["colors"] >= 3
    inside = seeds(spark, 1, 2, 3)
    assert community.conductance(two_triangles, inside).first()[0] == pytest.approx(1 / 7)
    assert community.conductance(two_triangles, seeds(spark, 1, 2, 3, 4, 5, 6)).first()[0] == 0
    assert community.conductance(two_triangles, seeds(spark)).first()[0] == 0
    assert community.summaries(two_triangles, community.leiden(two_triangles)).count() == 2
    assert community.community_profiles(two_triangles, community.leiden(two_triangles)).first()["size"] == 3


def test_similarity_and_links(spark):
    tri = make(spark, both((1, 2), (2, 3), (1, 3)))
    assert {(r["a"], r["b"]): r["score"] for r in similarity.similarity(tri).collect()}[1, 2] == pytest.approx(1 / 3)
    path = make(spark, [(1, 2), (2, 3)])
    for metric, score in (("adamic_adar", 1 / math.log(2)), ("common_neighbors", 1.0), ("resource_allocation", 0.5), ("preferential_attachment", 1.0)):
        rows = similarity.predict_links(path, metric).collect()
        assert [(r["a"], r["b"]) for r in rows] == [(1, 3)] and rows[0]["score"] == pytest.approx(score)


def test_flow_and_trees(spark):
    chain = make(spark, [(1, 2, 3), (2, 3, 2)])
    assert flow.max_flow(chain, 1, 3).first()["total"] == 2.0
    parallel = make(spark, [(1, 2, 3), (2, 4, 3), (1, 3, 2), (3, 4, 2)])
    assert flow.max_flow(parallel, 1, 4).first()["total"] == 5.0
    mst = flow.spanning_forest(make(spark, [(1, 2, 1), (2, 3, 2), (1, 3, 3)]))
    assert mst.agg(F.sum("weight")).first()[0] == 3.0
    vec = flow.fast_rp(chain, 16).collect()
    assert all(len(r["vec"]) == 16 for r in vec)


def test_walks(spark, two_triangles):
    walks = traversal.random_walks(two_triangles, seeds(spark, 1, 4), 6).collect()
    edges = {(r["a"], r["b"]) for r in two_triangles.simple().collect()}
    assert all(len(r["path"]) == 7 and all(p in edges for p in zip(r["path"], r["path"][1:])) for r in walks)
    walks = traversal.node2vec_walks(two_triangles, 2, 5, 0.5, 2.0).collect()
    assert len(walks) == 12 and all(all(p in edges for p in zip(r["path"], r["path"][1:])) for r in walks)
    sample = traversal.sample_neighbors(two_triangles, seeds(spark, 3), [2, 1])
    assert sample.groupBy("hop", "src").count().agg(F.max("count")).first()[0] <= 2


def test_joins_and_profile(spark):
    g = Graph.local(
        spark,
        [{"node_id": 1, "label": "person", "entity_key": "alice", "props": {"name": "Alice", "age": "30"}}, {"node_id": 2, "label": "person", "props": {"name": "Bob"}}, {"node_id": 3, "label": "topic", "props": {"name": "Rust"}}],
        [{"src": 1, "dst": 2, "label": "knows", "weight": 0.9}, {"src": 1, "dst": 3, "label": "uses", "weight": 0.8}, {"src": 1, "dst": 99, "label": "uses"}],
    )
    assert joins.neighbors(g, seeds(spark, 1), "both").count() == 3 and joins.neighbors(g, seeds(spark, 1), "out", "none").count() == 0
    assert joins.dangling(g).collect()[0]["missing"] == "dst"
    assert joins.pattern(g, "person", "uses", "topic").count() == 1
    assert joins.induced(g, seeds(spark, 1, 2)).count() == 1
    assert profile.stats(g).first().asDict() == {"nodes": 3, "edges": 3, "avg_degree": 2.0}
    inferred = {(r["label"], r["key"]): r for r in profile.infer_schema(g).collect()}
    assert inferred["person", "name"]["required"] and inferred["person", "age"]["null_rate"] == 0.5 and inferred["person", "age"]["type"] == "int"
    bad = profile.violations(g, [("node", "person", "required", "age", None), ("node", "person", "type", "name", "int")]).collect()
    assert sorted((r["id"], r["constraint"]) for r in bad) == [(1, "type"), (2, "required"), (2, "type")]
    assert aggregates.degree_distribution(g).first()["max_degree"] == 3
    assert profile.detailed_stats(g).count() == 1
    assert filters.search_property(g, "name", "Bob").first()["node_id"] == 2
    found = joins.conflicts(g.nodes.withColumn("score", F.lit(1.0))).collect()
    assert [(r["key"], r["kept"]) for r in found] == [("name", 1)]
    assert importance.importance(g, 1000).orderBy(F.desc("importance")).first()["node_id"] == 1


def test_bm25_and_vectors(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox"), (2, "a lazy dog sleeps"), (3, "brown bears eat")], "node_id long, text string")
    assert search.search_text(docs, "brown fox").first()["node_id"] == 1
    e = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0, 0.0]), (3, [1.0, 1.0, 0.0, 0.0])], "node_id long, vec array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0])], "query_id long, vec array<float>")
    rows = search.nearest(e, q, 2).orderBy("rank").collect()
    assert [r["node_id"] for r in rows] == [1, 3] and rows[0]["distance"] < 0.01 and rows[1]["distance"] == pytest.approx(1 - 1 / math.sqrt(2))


def test_fusion_and_budget(spark):
    a = spark.createDataFrame([(1, 3.0), (2, 2.0), (3, 1.0)], "node_id long, score double")
    b = spark.createDataFrame([(2, 3.0), (1, 2.0), (4, 1.0)], "node_id long, score double")
    fused = table(ranking.fuse([(a, 1.0), (b, 1.0)]), "node_id", "score")
    assert fused == pytest.approx({1: 1 / 61 + 1 / 62, 2: 1 / 61 + 1 / 62, 3: 1 / 63, 4: 1 / 63})
    chunks = spark.createDataFrame([(1, "a", 0.9, 50), (2, "a", 0.8, 60), (3, "b", 0.1, 10), (4, "b", 0.7, 100)], "node_id long, label string, score double, tokens long")
    ids = lambda df: sorted(r["node_id"] for r in df.collect())
    assert ids(budget.greedy(chunks, 110)) == [1, 2]
    assert ids(budget.greedy(chunks, 70)) == [1, 3]
    assert ids(budget.mmr(chunks, 120, 0.3)) == [1, 2, 3]
    assert 3 in ids(budget.submodular(chunks, 70, 0.5)) and ids(budget.enforce(chunks, budget.Budget(0))) == []
    assert ids(budget.proportional(chunks, 200)) == [1, 3]


def test_resolution(spark):
    names = spark.createDataFrame([(i, f"Acme Corporation {i}") for i in range(20)], "node_id long, name string")
    queries = spark.createDataFrame([(i, f"Acme Corp {i}") for i in range(20)], "query_id long, name string")
    found = resolve.match_blocked(names, queries, 0.82).collect()
    assert len(found) == 20 and all(r["score"] >= 0.82 for r in found)
    assert resolve.split_text("aaa bbb ccc", 7) == [(0, 7), (8, 11)]
    text = "Een zin. Nog één zin.\n\nEen alinea."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    for r in resolve.chunk(docs, 12).collect():
        assert text.encode()[r["start"] : r["end"]].decode() == r["content"] and len(r["content"]) <= 12
    g = Graph.local(spark, [{"node_id": 1, "props": {"a": "1", "b": "2"}}, {"node_id": 2, "props": {"b": "3"}}, {"node_id": 3}], [{"src": 1, "dst": 3}, {"src": 1, "dst": 2}])
    merged = resolve.merge_nodes(g, 1, 2)
    assert merged.nodes.where("node_id = 2").first()["props"] == {"a": "1", "b": "3"}
    assert [(r["src"], r["dst"], r["edge_id"]) for r in merged.edges.collect()] == [(2, 3, 3)]
    entities = spark.createDataFrame([("Jon Smith", "p", 0.5), ("John Smith", "p", 0.9), ("Acme", "c", 1.0)], "name string, label string, confidence double")
    kept = {r["name"]: (r["kept"], r["confidence"]) for r in resolve.dedup_entities(entities).collect()}
    assert kept["Jon Smith"] == kept["John Smith"] == ("John Smith", 0.9)
    aliased = resolve.resolve_aliases(spark.createDataFrame([("a",), ("z",)], "name string"), {"a": "b", "b": "c"})
    assert {r["name"]: r["canonical"] for r in aliased.collect()} == {"a": "c", "z": "z"}


def test_timeline(spark):
    g = Graph.local(spark, [{"node_id": 1}, {"node_id": 2, "tx_from": 2000}], [{"src": 1, "dst": 2, "valid_from": 100, "valid_until": 200, "tx_from": 100, "tx_until": 200}])
    assert timeline.at(g, 1500)[0].count() == 1 and g.edges.where(filters.is_valid_at(100)).count() == 1
    assert g.edges.where(filters.is_valid_at(200)).count() == 0 and g.edges.where(filters.is_valid_at(50)).count() == 0
    d = {r["kind"]: r for r in timeline.diff(g, 1500, 2500).collect()}
    assert d["node"]["added"] == 1 and d["node"]["active_before"] == 1 and d["node"]["active_after"] == 2
    with pytest.raises(InvalidQuery):
        timeline.diff(g, 5, 5)
    assert timeline.history(g, 1).first()["active"] is False


def test_conflict_is_an_error():
    assert issubclass(Conflict, Exception)
