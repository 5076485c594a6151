"""Exchange formats, snapshots and logs, streams, functions and the catalog's queries against their SQL."""

import io
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from graphloom.functions import decay, text, values
from graphloom.model import Graph
from graphloom.sources import exchange, snapshots
from graphloom.streaming import cdc, ttl


@pytest.fixture(scope="module")
def graph(spark):
    nodes = [{"node_id": 10, "label": "a", "entity_key": "k", "props": {"name": 'x "q"', "n": "1", "_r": "2"}}, {"node_id": 20, "label": "b", "props": {"name": "y"}}]
    return Graph.local(spark, nodes, [{"src": 10, "dst": 20, "label": "l", "weight": 0.5}], [{"node_id": 10, "vec": [1.0, 2.0]}])


def test_json_round_trip(spark, graph, tmp_path):
    path = f"file://{tmp_path}/g"
    exchange.write_json(graph, path)
    with open(tmp_path / "g" / "nodes" / "extra.txt", "w") as f:
        f.write('not json\n{"id": 7}\n')
    back, rejects = exchange.read_json(spark, path, graph)
    rows = {r["node_id"]: r for r in back.nodes.collect()}
    assert set(rows) == {10, 20, 21, 22} and rows[21]["props"] == {"name": 'x "q"', "n": "1"} and rows[21]["entity_key"] == "k"
    assert [(r["src"], r["dst"], r["weight"]) for r in back.edges.where("edge_id > 1").collect()] == [(21, 22, 0.5)]
    assert rejects.count() == 2 and back.embeddings.where("node_id = 21").first()["vec"] == [1.0, 2.0]


def test_csv_and_dot(spark, graph, tmp_path):
    exchange.write_csv(graph, f"file://{tmp_path}/c")
    nodes, types = exchange.read_csv(spark, f"file://{tmp_path}/c", start=5)
    assert sorted(r["props"].get("n", "-") for r in nodes.collect()) == ["-", "1"] and {r["key"]: r["type"] for r in types.collect()} == {"n": "int", "name": "string"}
    exchange.write_dot(graph, f"file://{tmp_path}/d")
    lines = [r["line"] for r in exchange.dot_lines(graph).orderBy("part", "id").collect()]
    assert lines == ['digraph "graph" {', '  n10 [label="a: x \\"q\\""];', '  n20 [label="b: y"];', '  n10 -> n20 [label="l"];', "}"]


def test_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("plain é")
    (tmp_path / "b.csv").write_text("h,v\n1,2\n")
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>hi </w:t></w:r><w:r><w:t>there</w:t></w:r></w:p></w:document>')
    (tmp_path / "c.docx").write_bytes(body.getvalue())
    (tmp_path / "d.docx").write_bytes(b"broken")
    got = {r["path"].rpartition("/")[2]: r for r in exchange.read_documents(spark, f"file://{tmp_path}").collect()}
    assert (got["a.txt"]["text"], got["b.csv"]["text"], got["c.docx"]["text"]) == ("plain é", "h: 1, v: 2.", "hi there") and "BadZipFile" in got["d.docx"]["error"]


EVENTS = [
    (1, "g", 100, "node_created", '{"id": 1, "label": "a", "props": {"x": "1"}}'),
    (2, "g", 110, "node_created", '{"id": 2, "label": "a", "ttl_expires_at": 500}'),
    (3, "g", 120, "edge_created", '{"id": 1, "src": 1, "dst": 2, "label": "l"}'),
    (4, "g", 130, "node_updated", '{"id": 1, "props": {"y": "2"}}'),
    (5, "g", 140, "edge_invalidated", '{"id": 1}'),
    (6, "h", 150, "node_created", '{"id": 1, "label": "b"}'),
    (7, "g", 160, "node_updated", '{"id": 1, "props": {"x": "3"}}'),
]


def test_snapshots_log_and_recovery(spark, graph, tmp_path):
    root, log = f"file://{tmp_path}/s", f"file://{tmp_path}/log"
    empty = Graph.local(spark, [], [])
    for sequence in (0, 2, 4):
        snapshots.save(cdc.apply_events(empty, spark.createDataFrame([e for e in EVENTS if e[0] <= sequence], cdc.EVENT)), root, sequence)
    assert [s for s, _ in snapshots.listed(spark, root)] == [0, 2, 4]
    assert len(snapshots.cleanup(spark, root, 1)) == 2
    snapshots.append_events(spark, log, [e for e in EVENTS if e[1] == "g"])
    (tmp_path / "log" / "bad.json").write_text('{"sequence": 99, "graph": "g", "timestamp_ms": 1, "kind": "node_deleted", "payload_json": "{\\"id\\": 1}", "crc": 1}\n')
    events, damaged = snapshots.read_events(spark, log, 4)
    assert sorted(r["sequence"] for r in events.collect()) == [5, 7] and damaged.count() == 1
    g = snapshots.recover(spark, root, log)
    assert g.nodes.where("node_id = 1").first()["props"] == {"x": "3", "y": "2"}
    assert g.edges.first()["valid_until"] == 140
    snapshots.compact(spark, log, 5)
    assert [r["sequence"] for r in snapshots.read_events(spark, log)[0].collect()] == [7]


def test_replay_and_lifetimes(spark):
    events = spark.createDataFrame(EVENTS, cdc.EVENT)
    assert [r["sequence"] for r in cdc.replay(events, 1, "g", 3).collect()] == [4, 5, 7]
    assert [r["sequence"] for r in cdc.replay(events, rules=[("h", "read")]).collect()] == [6]
    got = {(r["graph"], r["entity"], r["id"]): (r["opened"], r["closed"]) for r in cdc.lifetimes(events).collect()}
    assert got == {("g", "node", 1): (100, None), ("g", "node", 2): (110, 500), ("g", "edge", 1): (120, 140), ("h", "node", 1): (150, None)}
    g = cdc.apply_events(Graph.local(spark, [], []), events.where("graph = 'g'"))
    assert ttl.expired_nodes(g, 500).count() == 1 and ttl.sweep(g, 500).nodes.count() == 1 and ttl.sweep(g, 100).edges.count() == 1
    assert ttl.expiry(5, None, 10) == 15 and ttl.expiry(5, 1, 10) == 6 and ttl.expiry(5, None, None) is None


def test_streamed_lifetimes_are_the_batch_ones(spark, tmp_path):
    source = f"file://{tmp_path}/events"
    for part in (EVENTS[3:], EVENTS[:3]):  # late events come in a second file
        spark.createDataFrame(part, cdc.EVENT).coalesce(1).write.mode("append").json(source)
    query = cdc.lifetimes_stream(cdc.stream(spark, source, files_a_trigger=1)).writeStream.format("memory").queryName("lives").outputMode("update").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    last = {(r["graph"], r["entity"], r["id"]): (r["opened"], r["closed"]) for r in spark.table("lives").collect() if r["opened"] is not None}
    batch = {(r["graph"], r["entity"], r["id"]): (r["opened"], r["closed"]) for r in cdc.lifetimes(spark.createDataFrame(EVENTS, cdc.EVENT)).collect()}
    assert last == batch


def test_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first()["v"]
    s = F.lit(1.0)
    assert value(decay.exponential(s, F.lit(0), 2000, 1000)) == 0.25 and value(decay.exponential(s, F.lit(0), 1, 0)) == 0 and value(decay.exponential(s, F.lit(5), 5, 1)) == 1
    assert value(decay.linear(s, F.lit(0), 500, 1000)) == 0.5 and value(decay.step(s, F.lit(0), 500, 1000)) == 1 and value(decay.step(s, F.lit(0), 1000, 1000)) == 0
    assert [value(decay.custom(s, F.lit(0), t, [(500, 0.5), (1000, 0.0)])) for t in (250, 500, 750, 2000)] == [0.75, 0.5, 0.25, 0]
    assert [value(text.char_tokens(F.lit(x))) for x in ("", "a", "abcd", "é" * 3)] == [0, 1, 1, 2]
    assert value(text.search_tokens(F.lit("The Quick-brown a fox é"))) == ["the", "quick", "brown", "fox", "é"]
    assert value(text.trigrams(F.lit("Abcab"))) == ["abc", "bca", "cab"] and value(text.trigrams(F.lit("Ab"))) == ["ab"]
    assert text.jaro_winkler_of("MARTHA", "MARHTA") == pytest.approx(0.9611, abs=1e-4)
    assert [value(values.csv_type(F.lit(x))) for x in ("1", "1.5", "TRUE", "x", "")] == ["int", "float", "bool", "string", None]
    assert [values.json_type(x) for x in ([], [1, 2.5], ["a"], {}, 1, True, None)] == ["vector", "vector", "list", "map", "int", "bool", "null"]
    assert values.scope("w", "u") == "ws:w:user:u"
    with pytest.raises(ValueError):
        values.scope("w", None, "a")


QUICK = [
    "node_label_counts", "edge_filters", "node_filters", "content_projection", "neighbors_both", "endpoint_labels", "conflict_detection", "cypher_aggregates", "cypher_where", "degree_distribution", "text_statistics", "rank_fusion", "budget_greedy", "decay_functions",
    "bfs_in", "weighted_distances", "strong_components", "personalized_pagerank", "betweenness_centrality", "triangles", "modularity", "link_prediction", "vector_search", "bm25_search", "blocked_resolution", "graph_diff", "event_lifetimes", "schema_inference", "dot_export",
]


@pytest.fixture(scope="module")
def duck(sf_dir):
    from pathlib import Path

    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", QUICK)
def test_catalog_against_sql(spark, sf_dir, duck, name):
    df = __spark_entry__.queries()[name](spark, sf_dir)
    rel = duck.sql(__spark_entry__.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    order = lambda r: tuple(str(x) for x in r)
    ours = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=order)
    theirs = sorted((tuple(dict(zip(rel.columns, r))[c] for c in columns) for r in rel.fetchall()), key=order)
    assert ours == theirs


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_tables_are_loaded_whole_and_the_log_lies_in_the_folder(spark, tmp_path):
    from graphloom.engine import Engine
    from graphloom.errors import NotFound
    from graphloom.streaming import cdc

    e = Engine(spark, now=lambda: 1000, root=f"file://{tmp_path}")
    e.create("g")
    first = e.add_node("g", "person", {"name": "Ann"})
    e.execute('SNAPSHOT')
    start, n = e.load_nodes("g", spark.range(500).selectExpr("'item' AS label", "map('k', CAST(id AS STRING)) AS props"))
    assert (start, n) == (first + 1, 500) and e.add_node("g", "person") == first + 501
    assert e.load_edges("g", spark.range(500).selectExpr("1 AS src", "id + 2 AS dst", "'has' AS label")) == (1, 500)
    with pytest.raises(NotFound):
        e.load_edges("g", spark.createDataFrame([(1, 9999, "has")], "src long, dst long, label string"))
    g = e.graph("g")
    assert g.nodes.count() == 502 and g.edges.count() == 500 and not e.log
    events = e.events()
    assert events.count() == events.select("sequence").distinct().count() == 1003
    empty = Engine(spark).create("g")
    again = cdc.apply_events(empty, events)
    assert again.nodes.count() == 502 and again.edges.count() == 500
    e.execute("WAL COMPACT")
    left = e.events()
    assert left.agg({"sequence": "min"}).first()[0] == 3 and left.count() == 1001
