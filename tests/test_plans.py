"""The context query, Cypher, the command language and the engine."""

import pytest
from pyspark.sql import functions as F

from graphloom.engine import Engine, User
from graphloom.errors import CapacityExceeded, Conflict, GraphError, InvalidQuery, NotAllowed, NotFound, SchemaViolation
from graphloom.model import Graph, Settings
from graphloom.operators.budget import Budget
from graphloom.plans import command, context, cypher
from graphloom.plans.context import ContextQuery


@pytest.fixture(scope="module")
def people(spark):
    nodes = [
        {"node_id": 1, "label": "person", "entity_key": "alice", "props": {"name": "Alice", "age": "30", "description": "Alice writes systems programming books", "_secret": "x"}},
        {"node_id": 2, "label": "person", "entity_key": "bob", "props": {"name": "Bob", "age": "25", "description": "Bob bakes bread"}, "ttl_expires_at": 5000},
        {"node_id": 3, "label": "topic", "entity_key": "rust", "props": {"name": "Rust", "description": "a systems programming language", "source": "wiki"}},
        {"node_id": 4, "label": "topic", "props": {"name": "Python", "age": "35"}},
        {"node_id": 5, "label": "_community_summary", "props": {"summary": "systems programming people", "member_count": "3"}},
    ]
    edges = [{"src": 1, "dst": 2, "label": "knows", "weight": 0.9}, {"src": 1, "dst": 3, "label": "uses", "weight": 0.8}, {"src": 2, "dst": 4, "label": "uses", "weight": 0.7}]
    vectors = [{"node_id": i, "vec": v} for i, v in ((1, [1.0, 0.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0, 0.0]), (3, [0.9, 0.1, 0.0, 0.0]))]
    return Graph.local(spark, nodes, edges, vectors)


def ids(df):
    return [r["node_id"] for r in df.collect()]


def test_context_by_key(people):
    rows = context.context_query(people, ContextQuery(keys=("alice",))).chunks.collect()
    assert [(r["node_id"], r["score"], r["depth"]) for r in rows] == [(1, 1.0, 0), (3, 0.5, 1), (2, 0.5, 1), (4, 0.25, 2)]
    assert "_secret" not in rows[0]["content"] and rows[0]["content"].startswith("age: 30\n")
    assert [x["name"] for x in rows[0]["relationships"]] == ["Bob", "Rust"]
    assert rows[1]["provenance"] == "wiki"


def test_context_stages(people):
    q = ContextQuery(text="systems programming", keys=("alice",))
    run = lambda **k: context.context_query(people, ContextQuery(**{**q.__dict__, **k})).chunks
    first = run().collect()
    assert first[0]["node_id"] in (1, 3)
    assert 2 not in ids(run(at=6000)) and 2 in ids(run(at=4000))
    assert ids(run(at=500)) == []
    assert len(ids(run(limit=2))) == 2
    tokens = {r["node_id"]: r["tokens"] for r in first}
    assert sum(tokens[i] for i in ids(run(budget=Budget(20)))) <= 20
    assert sorted(ids(run(decay=("step", 100), now=10_000))) == []
    assert ids(run(rerank_weight=1.0))[0] == 3 or ids(run(rerank_weight=1.0))[0] == 1
    assert ids(run(sort=("relevance", True))) == ids(run())[::-1]
    assert 5 in ids(run(mode="hybrid")) and ids(run(mode="global")) == [5]
    assert ids(run(text=None, keys=(), vector=[1.0, 0.0, 0.0, 0.0], top_k=1))[0] == 1
    with pytest.raises(InvalidQuery):
        run(mode="drift")
    with pytest.raises(InvalidQuery):
        run(text=None, keys=())
    result = context.context_query(people, q)
    assert result.conflicts.where("label = 'person' AND key = 'name'").first()["kept"] in (1, 2)
    assert result.subgraph(people)[1].count() == 3
    for kind in ("raw", "openai", "anthropic"):
        assert "Alice" in context.messages(result, kind, q.text).first()["payload"]
    assert context.explain(q)[0].startswith("1. ")


def test_cypher(people):
    run = lambda t: cypher.run(people, t)
    assert ids(run("MATCH (n:person) WHERE n.age > 26")) == [1]
    assert ids(run("MATCH (n) WHERE n.name STARTS WITH 'P' OR n.name ENDS WITH 'ob' AND n.age <= '25'")) == [2, 4]
    assert ids(run("MATCH (n:topic) WHERE n.age IS NULL")) == [3] and ids(run("MATCH (n:topic) WHERE n.age IS NOT NULL")) == [4]
    assert ids(run("MATCH (n {name: 'Bob'}) RETURN n")) == [2] and ids(run("MATCH (n) WHERE id(n) = 3")) == [3]
    assert [r["age"] for r in run("MATCH (n) RETURN n.age AS age ORDER BY n.age").collect()] == ["25", "30", "35", None, None]
    assert [r["age"] for r in run("MATCH (n) RETURN n.age AS age ORDER BY n.age DESC SKIP 1 LIMIT 2").collect()] == [None, "35"]
    assert run("MATCH (n:person) RETURN AVG(n.age), COUNT(DISTINCT n.age) AS c").first().asDict() == {"agg_0": 27.5, "c": 2}
    assert [r["b.name"] for r in run("MATCH (a:person)-[r:uses]->(b:topic) WHERE a.name = 'Alice' RETURN b.name").collect()] == ["Rust"]
    assert run("MATCH (a)-[r:none]->(b)").count() == 0
    assert cypher.created("CREATE (n:city {name: 'Paris'})") == ("city", {"name": "Paris"})
    for bad in ("MATCH (n", "FIND (n)", "MATCH (n) WHERE n.age ~ 3", "MATCH (n) RETURN n LIMIT 1 extra"):
        with pytest.raises(InvalidQuery):
            run(bad)
    with pytest.raises(InvalidQuery):
        cypher.run(people, "MATCH (n:nothing)", check_labels=True)


def test_commands_parse():
    q = command.parse("CONTEXT \"a \\\"b\\\"\" FROM 'g' BUDGET 8k SEEDS VECTOR [1, 2] TOP 3 SEEDS NODES [\"x\"] DEPTH 4 RETRIEVAL HYBRID RERANK {\"score_weight\": 0.5} FILTER LABELS [\"l\"] MIN_WEIGHT 0.5 DECAY LINEAR 10 PROVENANCE AT 5 LIMIT 7 SCORE BY recency DESC").args["query"]
    assert (q.text, q.budget.tokens, q.vector, q.top_k, q.keys, q.depth, q.mode, q.rerank_weight, q.at, q.limit, q.sort, q.decay) == ('a "b"', 8192, [1, 2], 3, ("x",), 4, "hybrid", 0.5, 5, 7, ("recency", False), ("linear", 10))
    assert q.edge_filter.labels == ("l",) and q.edge_filter.min_weight == 0.5
    assert command.parse('EDGE ADD TO "g" FROM 1 TO 2 LABEL "x" WEIGHT 0.5').args["weight"] == 0.5
    assert command.parse("ping").name == "ping" and command.parse('GRAPH CREATE "g"').category == "admin"
    assert command.parse('NODE MERGE "g" 1 INTO 2 POLICY keep_source').args["policy"] == "keep_source"
    for bad in ("", "NOPE", "NODE ADD", 'NODE GET "g" x', 'CONTEXT "q" FROM "g" DEPTH 101', "GRAPH FLY g", 'CONTEXT "q', 'BULK NODES TO "g" DATA {}', "PING PONG extra" if False else 'STATS "g" extra'):
        with pytest.raises(InvalidQuery):
            command.parse(bad)


def test_engine(spark, tmp_path):
    clock = iter(range(1000, 100_000))
    e = Engine(spark, lambda: next(clock), root=f"file://{tmp_path}")
    run = e.execute
    assert run("PING") == "PONG" and run('GRAPH CREATE "g"') == "OK"
    a = run('NODE ADD TO "g" LABEL "person" PROPERTIES {"name": "Alice", "age": 30} ENTITY_KEY "alice"')
    b = run('NODE ADD TO "g" LABEL "person" PROPERTIES {"name": "Bob"} ENTITY_KEY "bob"')
    assert (a, b) == (1, 2)
    assert run('NODE ADD TO "g" LABEL "person" PROPERTIES {"city": "Paris"} ENTITY_KEY "alice"') == a
    assert run(f'NODE GET "g" {a}').first()["props"] == {"name": "Alice", "age": "30", "city": "Paris"}
    edge = run(f'EDGE ADD TO "g" FROM {a} TO {b} LABEL "knows" WEIGHT 0.9')
    assert run(f'NEIGHBORS "g" {a} DIRECTION out').first()["neighbor"] == b
    assert run(f'EDGE INVALIDATE "g" {edge}') == "OK"
    row = run(f'EDGE GET "g" {edge}').first()
    assert row["valid_until"] is not None and row["tx_until"] is not None
    assert run('BULK NODES TO "g" DATA [{"label": "t", "properties": {"name": "Rust"}}, {"label": "t", "entity_key": "alice"}]') == [3, 4]
    assert run('SEARCH "g" WHERE name = "Rust"').first()["node_id"] == 3
    assert run('SEARCH TEXT "rust" IN "g"').first()["node_id"] == 3
    assert run('CYPHER "g" MATCH (n:person) RETURN COUNT(*) AS c').first()["c"] == 2
    assert run('CONTEXT "rust" FROM "g" SEEDS NODES ["alice"] BUDGET 4k TOKENS').count() >= 2
    assert run('STATS "g"').first()["nodes"] == 4 and run("GRAPH LIST").count() == 1
    assert run(f'NODE MERGE "g" 3 INTO {b}') == "OK" and run('GRAPH INFO "g"').first()["nodes"] == 3
    run('SCHEMA SET "g" node person required name')
    run('SCHEMA SET "g" node person unique name')
    with pytest.raises(SchemaViolation):
        run('NODE ADD TO "g" LABEL "person" PROPERTIES {}')
    with pytest.raises(Conflict):
        run('NODE ADD TO "g" LABEL "person" PROPERTIES {"name": "Alice"}')
    assert run(f'NODE DELETE "g" {b}') == "OK" and e.graph("g").edges.count() == 0
    with pytest.raises(NotFound):
        run(f'NODE GET "g" {b}')
    assert run('GRAPH CHECK "g"').count() == 0 and len(run("SNAPSHOT")) == 1
    from graphloom.sources import snapshots

    assert snapshots.recover(spark, f"file://{tmp_path}/g").nodes.count() == e.graph("g").nodes.count()
    kinds = [r["kind"] for r in e.events().orderBy("sequence").collect()]
    assert kinds[0] == "graph_created" and "edge_invalidated" in kinds and "node_deleted" in kinds
    assert run('INGEST "One text. Another." INTO "g"') == "OK" and e.graph("g").nodes.where("label = 'chunk'").count() == 1
    run("CONFIG SET a b")
    assert run("CONFIG GET a") == "b" and run('GRAPH DROP "g"') == "OK"
    with pytest.raises(NotFound):
        run('STATS "g"')


def test_capacity_and_eviction(spark):
    clock = iter(range(1000, 100_000))
    e = Engine(spark, lambda: next(clock))
    e.create("full", Settings(max_nodes=1))
    e.add_node("full", "x")
    with pytest.raises(CapacityExceeded):
        e.add_node("full", "x")
    e.create("lru", Settings(max_nodes=2, eviction="lru"))
    a, b = e.add_node("lru", "x"), e.add_node("lru", "x")
    e.touch("lru", a)
    e.add_node("lru", "x")
    assert sorted(r["node_id"] for r in e.graph("lru").nodes.collect()) == [a, 3]


def test_permissions():
    user = User("u", {"read"}, [("app:*", "read"), ("*", "none")])
    user.check(command.parse('STATS "app:x"'))
    for text in ('STATS "other"', 'NODE DELETE "app:x" 1', "SNAPSHOT"):
        with pytest.raises(NotAllowed):
            user.check(command.parse(text))
    with pytest.raises(GraphError):
        User("off", {"all"}, enabled=False).check(command.parse("PING"))
    User("admin", {"all"}, [("*", "admin")]).check(command.parse('GRAPH DROP "x"'))


def test_ingest_with_extractors(spark):
    import pandas as pd

    from graphloom.operators import resolve

    def entities(parts):
        for p in parts:
            rows = [(i, n, "person", n, 0.9) for i, t in zip(p["doc_id"], p["content"]) for n in ("Alice", "Jon Smith", "John Smith") if n in t]
            yield pd.DataFrame(rows, columns=["doc_id", "name", "label", "description", "confidence"])

    def relations(parts):
        for p in parts:
            yield pd.DataFrame([(i, "alice", "John Smith", "knows", 0.8) for i in p["doc_id"]], columns=["doc_id", "source", "target", "type", "confidence"])

    g = Graph.local(spark, [{"node_id": 1, "label": "person", "entity_key": "alice", "props": {"name": "Alice"}}], [])
    docs = spark.createDataFrame([(1, "Alice met Jon Smith, also known as John Smith.")], "doc_id long, text string")
    out = resolve.ingest(g, docs, entities, relations)
    people = {r["name"]: r["node_id"] for r in out.nodes.where("label = 'person'").select("node_id", F.col("props")["name"].alias("name")).collect()}
    assert set(people) == {"Alice", "John Smith"} and people["Alice"] == 1
    assert [(r["src"], r["dst"]) for r in out.edges.collect()] == [(1, people["John Smith"])]
