"""Registered queries over the driver's tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import decay, text, values, vectors
from .functions.temporal import is_valid_at, is_valid_during
from .operators import aggregates, budget, centrality, community, filters, flow, importance, joins, paths, profile, ranking, resolve, search, similarity, timeline, traversal
from .operators.filters import EdgeFilter, NodeFilter
from .plans import context, cypher
from .runtime import cut
from .sources import exchange, tables
from .streaming import cdc, ttl

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# ---- shared SQL: the same graphs, for DuckDB
TRAFFIC = """
e AS MATERIALIZED (SELECT CAST(x.user_id AS BIGINT) AS a, CAST(y.user_id AS BIGINT) AS b, CAST(count(*) AS DOUBLE) AS w, CAST(x.user_id * 1000000000 + y.user_id AS BIGINT) AS edge_id
      FROM events x JOIN events y ON y.event_id = x.event_id + 1 GROUP BY ALL),
v AS MATERIALIZED (SELECT DISTINCT CAST(user_id AS BIGINT) AS id, 'user-' || user_id AS name, CAST(user_id % 5 AS BIGINT) AS region FROM events),
nv AS MATERIALIZED (SELECT count(*) AS n FROM v),
u AS MATERIALIZED (SELECT a, b, w FROM e UNION ALL SELECT b, a, w FROM e),
s AS MATERIALIZED (SELECT DISTINCT a, b FROM u WHERE a <> b)
"""
T12 = tables.SPAN
KNOWLEDGE = f"""
kn AS MATERIALIZED (
  SELECT CAST(r_regionkey AS BIGINT) AS id, 'region' AS label, r_name AS name, CAST(0 AS BIGINT) AS tx FROM region
  UNION ALL SELECT n_nationkey + {T12}, 'nation', n_name, 0 FROM nation
  UNION ALL SELECT c_custkey + {2 * T12}, 'customer', c_name, 0 FROM customer
  UNION ALL SELECT s_suppkey + {3 * T12}, 'supplier', s_name, 0 FROM supplier
  UNION ALL SELECT p_partkey + {4 * T12}, 'part', p_name, 0 FROM part
  UNION ALL SELECT o_orderkey + {5 * T12}, 'orders', NULL, epoch_ms(o_orderdate) FROM orders),
ke AS MATERIALIZED (
  SELECT n_nationkey + {T12} AS src, CAST(n_regionkey AS BIGINT) AS dst, 'in_region' AS label, 1.0 AS w, CAST(0 AS BIGINT) AS vf FROM nation
  UNION ALL SELECT c_custkey + {2 * T12}, c_nationkey + {T12}, 'located_in', 1.0, 0 FROM customer
  UNION ALL SELECT s_suppkey + {3 * T12}, s_nationkey + {T12}, 'located_in', 1.0, 0 FROM supplier
  UNION ALL SELECT o_orderkey + {5 * T12}, o_custkey + {2 * T12}, 'placed_by', 1.0, epoch_ms(o_orderdate) FROM orders
  UNION ALL SELECT l_orderkey + {5 * T12}, l_partkey + {4 * T12}, 'contains', sum(l_quantity), min(epoch_ms(l_shipdate)) FROM lineitem GROUP BY l_orderkey, l_partkey)
"""
DISTANCES = "r(s, n, d) AS (SELECT id, id, 0 FROM v UNION SELECT r.s, s.b, r.d + 1 FROM r JOIN s ON s.a = r.n WHERE r.d < 6), dist AS MATERIALIZED (SELECT s, n, min(d) AS d FROM r GROUP BY ALL)"


def unrolled(start: str, step: str, rounds: int) -> str:
    """CTEs p0 .. p{rounds}; {p} in step is the table before."""
    return ",\n".join([f"p0 AS MATERIALIZED ({start})", *(f"p{i} AS MATERIALIZED ({step.replace('{p}', f'p{i - 1}')})" for i in range(1, rounds + 1))])


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def score(df: DataFrame, *names: str) -> DataFrame:
    """Scores to six places, for comparison."""
    for n in names or ("score",):
        df = df.withColumn(n, F.round(n, 6))
    return df


def ids(spark: SparkSession, *of: int) -> DataFrame:
    return spark.createDataFrame([(i, 1.0) for i in of], "node_id long, score double")


# ---- scans, filters, projections
@query(f"WITH {KNOWLEDGE} SELECT label, count(*) AS n FROM kn GROUP BY label")
def node_label_counts(spark, d):
    return aggregates.label_counts(tables.knowledge(spark, d))


@query(f"WITH {KNOWLEDGE} SELECT label, count(*) AS n FROM ke GROUP BY label")
def edge_label_counts(spark, d):
    return aggregates.edge_label_counts(tables.knowledge(spark, d))


@query(f"WITH {KNOWLEDGE} SELECT id AS node_id, label, name FROM kn WHERE id = {T12 + 3}")
def node_lookup(spark, d):
    return filters.node_by_id(tables.knowledge(spark, d), T12 + 3).select("node_id", "label", F.col("props")["name"].alias("name"))


@query(f"WITH {KNOWLEDGE} SELECT id AS node_id, label FROM kn WHERE name = (SELECT min(r_name) FROM region) AND label = 'region'")
def node_by_entity_key(spark, d):
    key = tables.table(spark, d, "region").agg(F.min("r_name")).first()[0]
    return filters.node_by_key(tables.knowledge(spark, d), key).select("node_id", "label")


@query(f"SELECT count(*) AS n FROM part WHERE p_size > 25")
def property_predicate(spark, d):
    return filters.nodes_where(tables.knowledge(spark, d), "size", lambda v: v.cast("int") > 25).agg(F.count("*").alias("n"))


@query(f"SELECT c_custkey + {2 * T12} AS node_id, count(*) OVER () AS total FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY 1 LIMIT 100")
def property_search(spark, d):
    return filters.search_property(tables.knowledge(spark, d), "segment", "BUILDING").select("node_id", "total")


@query(f"WITH {KNOWLEDGE} SELECT label, count(*) AS n FROM ke WHERE label IN ('contains', 'placed_by') AND w >= 10 AND vf <= 800000000000 GROUP BY label")
def edge_filters(spark, d):
    return EdgeFilter(labels=("contains", "placed_by"), min_weight=10, valid_at=800000000000)(tables.knowledge(spark, d).edges).groupBy("label").agg(F.count("*").alias("n"))


@query(f"WITH {KNOWLEDGE} SELECT count(*) AS n FROM ke WHERE label = 'contains' AND greatest(1000000000000 - vf, 0) <= 250000000000")
def edge_age_filter(spark, d):
    return EdgeFilter(labels=("contains",), max_age_ms=250000000000, now=1000000000000)(tables.knowledge(spark, d).edges).agg(F.count("*").alias("n"))


@query(f"WITH {KNOWLEDGE} SELECT kn.label, count(DISTINCT kn.id) AS n FROM kn JOIN (SELECT src AS id FROM ke WHERE vf <= 800000000000 UNION SELECT dst FROM ke WHERE vf <= 800000000000) x USING (id) WHERE name IS NOT NULL GROUP BY 1")
def node_filters(spark, d):
    return NodeFilter(has_properties=("name",), valid_at=800000000000)(tables.knowledge(spark, d)).groupBy("label").agg(F.count("*").alias("n"))


@query(f"SELECT p_partkey + {4 * T12} AS node_id, 'brand: ' || p_brand || chr(10) || 'name: ' || p_name || chr(10) || 'size: ' || p_size AS content FROM part")
def content_projection(spark, d):
    return tables.knowledge(spark, d).nodes.where("label = 'part'").select("node_id", filters.content(F.col("props")).alias("content"))


@query("SELECT 'user-' || (user_id % 10) AS graph, count(*) AS n FROM events WHERE user_id % 10 IN (1, 2) GROUP BY 1")
def acl_filter(spark, d):
    rules = [("user-1", "read"), ("user-2", "readwrite"), ("user-*", "none")]
    return filters.allowed(tables.change_events(spark, d), rules).groupBy("graph").agg(F.count("*").alias("n"))


# ---- joins
@query(f"WITH {TRAFFIC} SELECT a AS node_id, b AS neighbor, w AS weight FROM u")
def neighbors_both(spark, d):
    g = tables.traffic(spark, d)
    return joins.neighbors(g, g.nodes, "both").select("node_id", "neighbor", "weight")


@query(f"WITH {KNOWLEDGE} SELECT ke.src AS node_id, count(*) AS n FROM ke WHERE vf <= 800000000000 AND label = 'contains' GROUP BY 1")
def temporal_neighbors(spark, d):
    g = tables.knowledge(spark, d)
    return joins.neighbors(g, g.nodes, "out", "contains", 800000000000).groupBy("node_id").agg(F.count("*").alias("n"))


@query(f"WITH {TRAFFIC} SELECT a AS src, b AS dst, w AS weight FROM e ORDER BY a, b LIMIT 1")
def edge_between(spark, d):
    g = tables.traffic(spark, d)
    first = g.edges.orderBy("src", "dst").first()
    return joins.edge_between(g, first["src"], first["dst"]).select("src", "dst", "weight")


@query(f"WITH {TRAFFIC}, k AS (SELECT a, count(*) AS k FROM s GROUP BY a) SELECT x.a, y.b, count(*) AS n FROM s x JOIN s y ON x.b = y.a WHERE x.a < y.b GROUP BY ALL")
def common_neighbor_counts(spark, d):
    return similarity.common_counts(tables.traffic(spark, d))


@query(f"WITH {KNOWLEDGE} SELECT DISTINCT ke.label, x.label AS src_label, y.label AS dst_label FROM ke JOIN kn x ON ke.src = x.id JOIN kn y ON ke.dst = y.id")
def endpoint_labels(spark, d):
    return joins.endpoint_labels(tables.knowledge(spark, d))


@query(f"WITH {TRAFFIC} SELECT a, b, w FROM e WHERE a < 12 AND b < 12")
def induced_subgraph(spark, d):
    g = tables.traffic(spark, d)
    return joins.induced(g, g.nodes.where("node_id < 12")).select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("w"))


@query(f"WITH {KNOWLEDGE}, gone AS (SELECT {2 * T12 + 7} AS id) SELECT 'src' AS missing, count(*) AS n FROM gone JOIN ke ON src = id UNION ALL SELECT 'dst', count(*) FROM gone JOIN ke ON dst = id")
def integrity_check(spark, d):
    """Without one customer's node its orders and its place dangle."""
    g = tables.knowledge(spark, d)
    return profile.check(g.with_nodes(g.nodes.where(f"node_id <> {2 * T12 + 7}"))).groupBy("missing").agg(F.count("*").alias("n"))


@query("SELECT least(x.n_nationkey, y.n_nationkey) + 1000000000000 AS node_a, greatest(x.n_nationkey, y.n_nationkey) + 1000000000000 AS node_b, 'name' AS key FROM nation x JOIN nation y ON x.n_nationkey < y.n_nationkey AND x.n_name <> y.n_name")
def conflict_detection(spark, d):
    chunks = tables.knowledge(spark, d).nodes.where("label = 'nation'").withColumn("score", F.lit(1.0))
    return joins.conflicts(chunks).select("node_a", "node_b", "key")


# ---- aggregates and Cypher
@query("SELECT count(*) AS n, count(p_size) AS sized, count(DISTINCT p_brand) AS brands, CAST(sum(p_size) AS DOUBLE) AS total, round(avg(p_size), 6) AS mean, CAST(min(p_size) AS DOUBLE) AS least, CAST(max(p_size) AS DOUBLE) AS most FROM part")
def cypher_aggregates(spark, d):
    found = cypher.run(tables.knowledge(spark, d), "MATCH (n:part) RETURN COUNT(*) AS n, COUNT(n.size) AS sized, COUNT(DISTINCT n.brand) AS brands, SUM(n.size) AS total, AVG(n.size) AS mean, MIN(n.size) AS least, MAX(n.size) AS most")
    return score(found, "mean")


@query("SELECT array_to_string(list(n_name ORDER BY n_nationkey), '|') AS names FROM nation")
def cypher_collect(spark, d):
    return cypher.run(tables.knowledge(spark, d), "MATCH (n:nation) RETURN COLLECT(n.name) AS names").select(F.array_join("names", "|").alias("names"))


@query("SELECT p_name AS name, CAST(p_size AS VARCHAR) AS size FROM part WHERE p_size >= 40 AND (p_brand LIKE '%1%') OR p_size < 3 ORDER BY p_size DESC, p_partkey DESC LIMIT 20 OFFSET 5")
def cypher_where(spark, d):
    return cypher.run(tables.knowledge(spark, d), "MATCH (n:part) WHERE n.size >= 40 AND n.brand CONTAINS '1' OR n.size < 3 RETURN n.name AS name, n.size AS size ORDER BY n.size DESC SKIP 5 LIMIT 20")


@query(f"SELECT c_custkey + {2 * T12} AS a_id, c_nationkey + {T12} AS b_id FROM customer WHERE c_mktsegment = 'BUILDING'")
def cypher_pattern(spark, d):
    return cypher.run(tables.knowledge(spark, d), "MATCH (a:customer)-[r:located_in]->(b:nation) WHERE a.segment = 'BUILDING'").select("a_id", "b_id")


@query(f"WITH {TRAFFIC}, g AS (SELECT id, (SELECT count(*) FROM u WHERE a = id) AS k FROM v), o AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM g) SELECT min(k) AS min_degree, max(k) AS max_degree, round(avg(k), 6) AS avg_degree, max(k) FILTER (i = n // 2) AS p50, max(k) FILTER (i = least(floor(n * 0.95), n - 1)) AS p95, max(k) FILTER (i = least(floor(n * 0.99), n - 1)) AS p99 FROM o")
def degree_distribution(spark, d):
    return aggregates.degree_distribution(tables.traffic(spark, d))


WORDS = "list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda w: strlen(w) >= 2)"
POSTINGS = f"""
dw AS (SELECT doc_id, {WORDS} AS w FROM documents WHERE text IS NOT NULL), dl AS (SELECT doc_id, w, len(w) AS dl FROM dw WHERE len(w) > 0),
corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
post AS (SELECT doc_id, term, dl, count(*) AS tf FROM (SELECT doc_id, dl, unnest(w) AS term FROM dl) GROUP BY ALL)
"""


@query(f"WITH {POSTINGS} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY term")
def text_statistics(spark, d):
    postings, _ = aggregates.text_statistics(tables.documents(spark, d))
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


# ---- ranking and budgets
@query(f"WITH {TRAFFIC}, x AS (SELECT a AS id, row_number() OVER (ORDER BY sum(w) DESC, a) AS r FROM e GROUP BY a), y AS (SELECT b AS id, row_number() OVER (ORDER BY sum(w) DESC, b) AS r FROM e GROUP BY b) SELECT id AS node_id, round(sum(p), 6) AS score FROM (SELECT id, 1.0 / (60 + r) AS p FROM x UNION ALL SELECT id, 0.8 / (60 + r) FROM y) GROUP BY id")
def rank_fusion(spark, d):
    e = tables.traffic(spark, d).edges
    side = lambda c: e.groupBy(F.col(c).alias("node_id")).agg(F.sum("weight").alias("score"))
    return score(ranking.fuse([(side("src"), 1.0), (side("dst"), 0.8)]))


@query(f"WITH {TRAFFIC}, x AS (SELECT a AS id, sum(w) AS t FROM e GROUP BY a) SELECT id AS node_id, round(t / (SELECT max(t) FROM x), 6) AS score FROM x")
def max_normalized(spark, d):
    return score(ranking.normalized(tables.traffic(spark, d).edges.groupBy(F.col("src").alias("node_id")).agg(F.sum("weight").alias("score"))))


def _chunks(spark, d):
    docs = tables.documents(spark, d)
    return docs.select("node_id", F.col("source").alias("label"), (F.length("text") % 97 / 97.0).alias("score"), text.char_tokens("text").alias("tokens"), F.col("text").alias("content"))


CHUNKS = "c AS (SELECT doc_id AS id, source AS label, length(text) % 97 / 97.0 AS score, CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL)"


@query(
    f"""WITH RECURSIVE {CHUNKS}, o AS (SELECT id, tokens, row_number() OVER (ORDER BY CASE WHEN tokens > 0 THEN -score / tokens ELSE -1e300 END, id) AS i FROM c),
    p(i, used, id, took) AS (SELECT 0, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), false UNION ALL
      SELECT o.i, CASE WHEN p.used + o.tokens <= 16384 THEN p.used + o.tokens ELSE p.used END, o.id, p.used + o.tokens <= 16384 FROM p JOIN o ON o.i = p.i + 1)
    SELECT id AS node_id FROM p WHERE took"""
)
def budget_greedy(spark, d):
    return budget.greedy(_chunks(spark, d), budget.PRESETS["16k"]).select("node_id")


@query(f"""WITH RECURSIVE {CHUNKS}, o AS (SELECT id, tokens, row_number() OVER (ORDER BY CASE WHEN tokens > 0 THEN -score / tokens ELSE -1e300 END, id) AS i FROM c),
    p(i, used, id, took) AS (SELECT 0, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), false UNION ALL
      SELECT o.i, CASE WHEN p.used + o.tokens <= 3276 THEN p.used + o.tokens ELSE p.used END, o.id, p.used + o.tokens <= 3276 FROM p JOIN o ON o.i = p.i + 1)
    SELECT id AS node_id, label FROM p JOIN c USING (id) WHERE took""")
def budget_proportional(spark, d):
    return budget.proportional(_chunks(spark, d), 8192).select("node_id", "label")


@query()
def budget_mmr(spark, d):
    return budget.mmr(_chunks(spark, d), 8192).select("node_id", "label")


@query()
def budget_submodular(spark, d):
    return budget.submodular(_chunks(spark, d), 8192).select("node_id", "label")


@query("SELECT n_nationkey AS node_id, round(CASE WHEN lower('nation ' || n_name) LIKE '%united states%' THEN 0.2 ELSE 0 END + 0.75 * ((CASE WHEN list_contains(regexp_extract_all(lower('nation ' || n_name), '[a-z0-9]+'), 'united') THEN 1 ELSE 0 END) + (CASE WHEN list_contains(regexp_extract_all(lower('nation ' || n_name), '[a-z0-9]+'), 'states') THEN 1 ELSE 0 END)) / 2, 6) AS score FROM nation")
def lexical_rerank(spark, d):
    return score(tables.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("node_id"), ranking.lexical_score("united states", F.lit("nation"), F.col("n_name")).alias("score"))).withColumn("node_id", F.col("node_id").cast("int"))


# ---- scalar functions
@query("SELECT o_orderkey AS id, round(CASE WHEN t >= 900000000000 THEN o_totalprice ELSE o_totalprice * pow(0.5, (900000000000 - t) / 5e10) END, 4) AS exponential, round(CASE WHEN t >= 900000000000 THEN o_totalprice ELSE o_totalprice * greatest(0, 1 - (900000000000 - t) / 2e11) END, 4) AS linear, round(CASE WHEN t >= 900000000000 OR 900000000000 - t < 100000000000 THEN o_totalprice ELSE 0 END, 4) AS step FROM (SELECT *, epoch_ms(o_orderdate) AS t FROM orders)")
def decay_functions(spark, d):
    o = tables.table(spark, d, "orders").withColumn("t", tables.millis("o_orderdate"))
    s, t, now = F.col("o_totalprice"), F.col("t"), 900000000000
    out = o.select(F.col("o_orderkey").alias("id"), decay.exponential(s, t, now, 50_000_000_000).alias("exponential"), decay.linear(s, t, now, 200_000_000_000).alias("linear"), decay.step(s, t, now, 100_000_000_000).alias("step"))
    for c in ("exponential", "linear", "step"):
        out = out.withColumn(c, F.round(c, 4))
    return out


@query("SELECT source, CAST(sum(CAST(ceil(strlen(text) / 4.0) AS BIGINT)) AS BIGINT) AS tokens FROM documents GROUP BY source")
def token_counts(spark, d):
    return tables.documents(spark, d).groupBy("source").agg(F.sum(text.char_tokens("text")).alias("tokens"))


@query(f"SELECT p_partkey + {4 * T12} AS node_id, CAST((length(p_name) + length(p_brand) + length(CAST(p_size AS VARCHAR))) // 4 AS BIGINT) AS tokens FROM part")
def node_token_estimate(spark, d):
    return tables.knowledge(spark, d).nodes.where("label = 'part'").select("node_id", values.node_tokens(F.col("props")).alias("tokens"))


@query("SELECT n_name AS a, r_name AS b, round(jaro_winkler_similarity(n_name, r_name), 6) AS score FROM nation, region")
def jaro_winkler(spark, d):
    pairs = tables.table(spark, d, "nation").crossJoin(F.broadcast(tables.table(spark, d, "region")))
    return score(pairs.select(F.col("n_name").alias("a"), F.col("r_name").alias("b"), text.jaro_winkler("n_name", "r_name").alias("score")))


@query("SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_distance(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 5) AS cosine, round(1 - list_inner_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 5) AS ip FROM embeddings x, embeddings y WHERE x.vec_id % 100 = 0")
def vector_distances(spark, d):
    e = tables.embeddings(spark, d)
    every = search.all_distances(e, e.where("node_id % 100 = 0").select(F.col("node_id").alias("query_id"), "vec"), ("cosine", "ip"))
    return every.select(F.col("query_id").alias("a"), F.col("node_id").alias("b"), F.round("cosine", 5).alias("cosine"), F.round("ip", 5).alias("ip"))


# ---- traversal and paths
@query(f"WITH RECURSIVE {KNOWLEDGE}, r(id, d) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT ke.src, r.d + 1 FROM r JOIN ke ON ke.dst = r.id WHERE r.d < 3) SELECT id AS node_id, min(d) AS depth FROM r GROUP BY id")
def bfs_in(spark, d):
    return traversal.bfs(tables.knowledge(spark, d), ids(spark, 0), 3, direction="in").select("node_id", "depth")


@query(f"WITH RECURSIVE {TRAFFIC}, r(id, d) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT e.b, r.d + 1 FROM r JOIN e ON e.a = r.id WHERE r.d < 3) SELECT id AS node_id, round(pow(0.5, min(d)), 6) AS score, min(d) AS depth FROM r GROUP BY id")
def flow_scores(spark, d):
    return score(traversal.flow_scores(tables.traffic(spark, d), ids(spark, 1), 0.5, 0.01, 3))


@query(f"WITH RECURSIVE {TRAFFIC}, r(id, d) AS (SELECT CAST(2 AS BIGINT), 0 UNION SELECT u.b, r.d + 1 FROM r JOIN u ON u.a = r.id WHERE r.d < 1), n AS (SELECT DISTINCT id FROM r) SELECT e.a, e.b, e.w FROM e JOIN n x ON e.a = x.id JOIN n y ON e.b = y.id")
def ego_network(spark, d):
    return traversal.ego_network(tables.traffic(spark, d), 2, 1)[1].select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("w"))


@query(f"WITH RECURSIVE {TRAFFIC}, r(s, n, d) AS (SELECT id, id, 0 FROM v UNION SELECT r.s, e.b, r.d + 1 FROM r JOIN e ON e.a = r.n WHERE r.d < 10) SELECT s AS source, n AS node_id, min(d) AS hops FROM r GROUP BY ALL")
def hop_distances(spark, d):
    g = tables.traffic(spark, d)
    return paths.hop_counts(g, g.nodes)


_RELAX = "SELECT id, min(d) AS d FROM (SELECT id, d FROM {p} UNION ALL SELECT e.b, {p}.d + 1 / e.w FROM {p} JOIN e ON e.a = {p}.id) GROUP BY id"


@query(f"WITH {TRAFFIC}, {unrolled('SELECT CAST(1 AS BIGINT) AS id, 0.0::DOUBLE AS d', _RELAX, 14)} SELECT id AS node_id, round(d, 6) AS dist FROM p14")
def weighted_distances(spark, d):
    return score(paths.bellman_ford(tables.traffic(spark, d), 1), "dist")


#: Paths of at most two edges: the fifth cheapest bounds what a longer one may cost.
_TWO_HOPS = "SELECT 1 / w AS c FROM e WHERE a = 1 AND b = 2 UNION ALL SELECT 1 / x.w + 1 / y.w FROM e x JOIN e y ON x.b = y.a WHERE x.a = 1 AND y.b = 2 AND x.b NOT IN (1, 2)"


@query(f"""WITH RECURSIVE {TRAFFIC}, best AS MATERIALIZED ({_TWO_HOPS}), most AS MATERIALIZED (SELECT max(c) + 1e-9 AS bound FROM (SELECT c FROM best ORDER BY c LIMIT 5)),
      w(n, path, cost) AS (SELECT CAST(1 AS BIGINT), [CAST(1 AS BIGINT)], 0.0::DOUBLE UNION ALL SELECT e.b, list_append(w.path, e.b), w.cost + 1 / e.w FROM w JOIN e ON e.a = w.n WHERE w.n <> 2 AND NOT list_contains(w.path, e.b) AND w.cost + 1 / e.w <= (SELECT bound FROM most))
      SELECT CAST(row_number() OVER (ORDER BY cost, path) AS INT) AS rank, round(cost, 6) AS cost FROM w WHERE n = 2 ORDER BY cost, path LIMIT 5""")
def k_shortest_paths(spark, d):
    return score(paths.k_shortest(tables.traffic(spark, d), 1, 2, 5), "cost").select("rank", "cost")


@query(f"WITH {TRAFFIC}, {unrolled('SELECT CAST(1 AS BIGINT) AS id, 0.0::DOUBLE AS d', _RELAX, 14)} SELECT round(max(d), 6) AS cost FROM p14")
def a_star_path(spark, d):
    g = tables.traffic(spark, d)
    ends = paths.cheapest_paths(g, 1).where("cost > 0").orderBy(F.desc("cost"), "node_id").first()
    return score(paths.a_star(g, 1, ends["node_id"]), "cost").select("cost")


@query(f"WITH {KNOWLEDGE} SELECT label, count(*) AS edges, CAST(0 AS BIGINT) AS backward FROM ke WHERE label IN ('in_region', 'located_in') GROUP BY label")
def topological_order(spark, d):
    """Edges by label, and how many of them the order has backward."""
    g = tables.knowledge(spark, d)
    keep = EdgeFilter(labels=("in_region", "located_in"))(g.edges)
    order = paths.topological_order(g.with_nodes(g.nodes.where("label IN ('region', 'nation', 'customer', 'supplier')")).with_edges(keep))
    at = keep.join(order.select(F.col("node_id").alias("src"), F.col("position").alias("x")), "src").join(order.select(F.col("node_id").alias("dst"), F.col("position").alias("y")), "dst")
    return at.groupBy("label").agg(F.count("*").alias("edges"), F.sum((F.col("x") >= F.col("y")).cast("long")).alias("backward"))


@query(f"""WITH RECURSIVE {TRAFFIC}, r(s, n, d, path) AS (SELECT id, id, 0, [id] FROM v WHERE id IN (1, 2, 3) UNION ALL SELECT r.s, e.b, r.d + 1, list_append(r.path, e.b) FROM r JOIN (SELECT DISTINCT a, b FROM e) e ON e.a = r.n WHERE r.d < 2 AND NOT list_contains(r.path, e.b)),
    m AS (SELECT s, n, min(d) AS d FROM r GROUP BY ALL), best AS (SELECT r.s, r.n, min(path) AS path FROM r JOIN m ON r.s = m.s AND r.n = m.n AND r.d = m.d WHERE r.n IN (1, 2, 3) AND r.s < r.n GROUP BY ALL)
    SELECT s AS a, n AS b, array_to_string(path, '-') AS path, 1.0::DOUBLE AS reliability FROM best""")
def scored_paths(spark, d):
    return paths.scored_paths(tables.traffic(spark, d), ids(spark, 1, 2, 3), 2).withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), "-"))


@query(f"WITH RECURSIVE {TRAFFIC}, r(s, n) AS (SELECT id, id FROM v UNION SELECT r.s, u.b FROM r JOIN u ON u.a = r.n), m AS (SELECT s, min(n) AS root FROM r GROUP BY s) SELECT s AS node_id, CAST(dense_rank() OVER (ORDER BY root) - 1 AS BIGINT) AS component FROM m")
def connected_components(spark, d):
    return paths.connected_components(tables.traffic(spark, d))


@query(f"WITH RECURSIVE {TRAFFIC}, r(s, n) AS (SELECT id, id FROM v UNION SELECT r.s, e.b FROM r JOIN e ON e.a = r.n), m AS (SELECT x.s, min(x.n) AS c FROM r x JOIN r y ON x.s = y.n AND x.n = y.s GROUP BY x.s) SELECT s AS node_id, c AS component, count(*) OVER (PARTITION BY c) AS size FROM m")
def strong_components(spark, d):
    return paths.strong_components(tables.traffic(spark, d))


@query(f"WITH {TRAFFIC}, d AS (SELECT a, count(*) AS k FROM (SELECT DISTINCT a, b FROM u) GROUP BY a) SELECT 1 AS hop, a AS src, least(k, 4) AS taken, CAST(0 AS BIGINT) AS unlinked FROM d WHERE a IN (1, 2, 3)")
def neighbor_sampling(spark, d):
    """First hop: how many neighbours of each seed are drawn, and how many of them are none."""
    g = tables.traffic(spark, d)
    drawn = cut(traversal.sample_neighbors(g, ids(spark, 1, 2, 3), [4, 2])).where("hop = 1")
    linked = g.both().select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1).alias("ok")).distinct()
    return drawn.join(linked, ["src", "dst"], "left").groupBy("hop", "src").agg(F.count("*").alias("taken"), F.sum(F.col("ok").isNull().cast("long")).alias("unlinked"))


@query(f"WITH {TRAFFIC} SELECT id AS start, CAST(11 AS BIGINT) AS nodes, CAST(0 AS BIGINT) AS jumps FROM v WHERE id IN (SELECT a FROM u)")
def random_walks(spark, d):
    """Of each walk its length, and how many of its steps are no edges."""
    g = tables.traffic(spark, d)
    walks = cut(traversal.random_walks(g, g.nodes, 10))
    steps = walks.select("start", F.size("path").alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.element_at("path", i.cast("int")).alias("a"), F.element_at("path", (i + 1).cast("int")).alias("b")))).alias("e")).select("*", "e.a", "e.b")
    linked = g.both().select("a", "b", F.lit(1).alias("ok")).distinct()
    return steps.join(linked, ["a", "b"], "left").groupBy("start").agg((F.count("*") + 1).alias("nodes"), F.sum(F.col("ok").isNull().cast("long")).alias("jumps"))


@query(f"WITH {TRAFFIC} SELECT id AS start, walk, CAST(9 AS BIGINT) AS nodes, CAST(0 AS BIGINT) AS jumps FROM v, (VALUES (0), (1)) t(walk) WHERE id IN (SELECT a FROM s)")
def node2vec_walks(spark, d):
    """Of each walk its length, and how many of its steps are no edges."""
    g = tables.traffic(spark, d)
    walks = cut(traversal.node2vec_walks(g, 2, 8, 0.5, 2.0))
    steps = walks.select("start", "walk", F.size("path").alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.element_at("path", i.cast("int")).alias("a"), F.element_at("path", (i + 1).cast("int")).alias("b")))).alias("e")).select("*", "e.a", "e.b")
    linked = g.both().select("a", "b", F.lit(1).alias("ok")).distinct()
    return steps.join(linked, ["a", "b"], "left").groupBy("start", "walk").agg((F.count("*") + 1).alias("nodes"), F.sum(F.col("ok").isNull().cast("long")).alias("jumps"))


# ---- centralities
_TELEPORT = 0.15
_PR = f"""SELECT v.id, {_TELEPORT} / (SELECT n FROM nv) + (1 - {_TELEPORT}) * (coalesce(x.s, 0) + (SELECT coalesce(sum({{p}}.x), 0) FROM {{p}} WHERE id NOT IN (SELECT a FROM e)) / (SELECT n FROM nv)) AS x
FROM v LEFT JOIN (SELECT e.b, sum({{p}}.x / k.k) AS s FROM e JOIN {{p}} ON e.a = {{p}}.id JOIN k ON k.a = e.a GROUP BY e.b) x ON x.b = v.id"""


@query(f"WITH {TRAFFIC}, k AS (SELECT a, count(*) AS k FROM e GROUP BY a), {unrolled('SELECT id, 1.0::DOUBLE / (SELECT n FROM nv) AS x FROM v', _PR, 20)} SELECT id AS node_id, round(x, 6) AS score FROM p20")
def pagerank(spark, d):
    return score(centrality.pagerank(tables.traffic(spark, d)))


_PPR = """SELECT v.id, 0.15 * (v.id = 1)::INT + 0.85 * (coalesce(x.s, 0) + (SELECT coalesce(sum({p}.x), 0) FROM {p} WHERE id NOT IN (SELECT a FROM e)) * (v.id = 1)::INT) AS x
FROM v LEFT JOIN (SELECT e.b, sum({p}.x / k.k) AS s FROM e JOIN {p} ON e.a = {p}.id JOIN k ON k.a = e.a GROUP BY e.b) x ON x.b = v.id"""


@query(f"WITH {TRAFFIC}, k AS (SELECT a, count(*) AS k FROM e GROUP BY a), {unrolled('SELECT id, 1.0::DOUBLE / (SELECT n FROM nv) AS x FROM v', _PPR, 10)} SELECT id AS node_id, round(x, 6) AS score FROM p10")
def personalized_pagerank(spark, d):
    return score(centrality.personalized_pagerank(tables.traffic(spark, d), ids(spark, 1), 0.15, 10))


_AR = "SELECT v.id, 0.15 / (SELECT n FROM nv) + 0.85 * coalesce(x.s, 0) AS x FROM v LEFT JOIN (SELECT e.b, sum({p}.x / (k.k + (SELECT count(*)::DOUBLE / (SELECT n FROM nv) FROM e))) AS s FROM e JOIN {p} ON e.a = {p}.id JOIN k ON k.a = e.a GROUP BY e.b) x ON x.b = v.id"


@query(f"WITH {TRAFFIC}, k AS (SELECT a, count(*) AS k FROM e GROUP BY a), {unrolled('SELECT id, 1.0::DOUBLE / (SELECT n FROM nv) AS x FROM v', _AR, 10)} SELECT id AS node_id, round(x, 6) AS score FROM p10")
def article_rank(spark, d):
    return score(centrality.article_rank(tables.traffic(spark, d), rounds=10))


_EV = "SELECT id, x / (SELECT max(x) FROM (SELECT sum({p}.x) AS x FROM s JOIN {p} ON s.a = {p}.id GROUP BY s.b)) AS x FROM (SELECT v.id, coalesce(sum({p}.x), 0) AS x FROM v LEFT JOIN s ON s.b = v.id LEFT JOIN {p} ON s.a = {p}.id GROUP BY v.id)"


@query(f"WITH {TRAFFIC}, {unrolled('SELECT id, 0.2 AS x FROM v', _EV, 10)} SELECT id AS node_id, round(x, 6) AS score FROM p10")
def eigenvector_centrality(spark, d):
    return score(centrality.eigenvector(tables.traffic(spark, d), 10, None))


_KZ = "SELECT v.id, 1e-2 * coalesce(sum({p}.x), 0) + 1 AS x FROM v LEFT JOIN (SELECT DISTINCT a, b FROM u) q ON q.b = v.id LEFT JOIN {p} ON q.a = {p}.id GROUP BY v.id"


@query(f"WITH {TRAFFIC}, {unrolled('SELECT id, 0e0 AS x FROM v', _KZ, 10)} SELECT id AS node_id, round(x / (SELECT sqrt(sum(x * x)) FROM p10), 6) AS score FROM p10")
def katz_centrality(spark, d):
    return score(centrality.katz(tables.traffic(spark, d), 0.01, 1.0, 10, None))


_HITS = """SELECT v.id, coalesce(h.x, 0) / (SELECT sqrt(sum(x * x)) FROM (SELECT e.a, sum(au.x) AS x FROM e JOIN (SELECT e.b, sum({p}.hub) AS x FROM e JOIN {p} ON e.a = {p}.id GROUP BY e.b) au ON e.b = au.b GROUP BY e.a)) AS hub,
coalesce(au.x, 0) / (SELECT sqrt(sum(x * x)) FROM (SELECT e.b, sum({p}.hub) AS x FROM e JOIN {p} ON e.a = {p}.id GROUP BY e.b)) AS authority
FROM v LEFT JOIN (SELECT e.a, sum(au.x) AS x FROM e JOIN (SELECT e.b, sum({p}.hub) AS x FROM e JOIN {p} ON e.a = {p}.id GROUP BY e.b) au ON e.b = au.b GROUP BY e.a) h ON h.a = v.id LEFT JOIN (SELECT e.b, sum({p}.hub) AS x FROM e JOIN {p} ON e.a = {p}.id GROUP BY e.b) au ON au.b = v.id"""


@query(f"WITH {TRAFFIC}, {unrolled('SELECT id, 1e0 AS hub, 1e0 AS authority FROM v', _HITS, 10)} SELECT id AS node_id, round(hub, 6) AS hub, round(authority, 6) AS authority FROM p10")
def hits(spark, d):
    return score(centrality.hits(tables.traffic(spark, d), 10), "hub", "authority")


@query(f"WITH {TRAFFIC} SELECT id AS node_id, round((SELECT count(*) FROM u WHERE a = id)::DOUBLE / ((SELECT n FROM nv) - 1), 6) AS score FROM v")
def degree_centrality(spark, d):
    return score(centrality.degree(tables.traffic(spark, d)))


@query(f"WITH {TRAFFIC} SELECT id AS node_id, round((SELECT count(*) FROM s WHERE a = id)::DOUBLE / ((SELECT n FROM nv) - 1), 6) AS score FROM v")
def simple_degree_centrality(spark, d):
    return score(centrality.simple_degree(tables.traffic(spark, d)))


@query(f"WITH RECURSIVE {TRAFFIC}, {DISTANCES} SELECT id AS node_id, round(coalesce((SELECT count(*) / sum(d) FROM dist WHERE s = id AND d > 0), 0), 6) AS score FROM v")
def closeness_centrality(spark, d):
    return score(centrality.closeness(tables.traffic(spark, d)))


@query(f"WITH RECURSIVE {TRAFFIC}, {DISTANCES} SELECT id AS node_id, round(coalesce((SELECT sum(1.0::DOUBLE / d) / ((SELECT n FROM nv) - 1) FROM dist WHERE s = id AND d > 0), 0), 6) AS score FROM v")
def harmonic_centrality(spark, d):
    return score(centrality.harmonic(tables.traffic(spark, d)))


@query(
    f"""WITH RECURSIVE {TRAFFIC}, {DISTANCES}, m AS MATERIALIZED (SELECT a, b, count(*)::DOUBLE AS m FROM u WHERE a <> b GROUP BY ALL),
    w(s, n, d, c) AS (SELECT id, id, 0, 1.0::DOUBLE FROM v UNION ALL SELECT w.s, m.b, w.d + 1, w.c * m.m FROM w JOIN m ON m.a = w.n JOIN dist ON dist.s = w.s AND dist.n = m.b AND dist.d = w.d + 1),
    g AS MATERIALIZED (SELECT s, n, max(d) AS d, sum(c) AS c FROM w GROUP BY ALL)
    SELECT id AS node_id, round(coalesce((SELECT sum(x.c * y.c / z.c) FROM g x JOIN g y ON x.n = y.s JOIN g z ON z.s = x.s AND z.n = y.n WHERE x.n = v.id AND x.s < y.n AND x.s <> v.id AND y.n <> v.id AND x.d + y.d = z.d), 0), 6) AS score FROM v"""
)
def betweenness_centrality(spark, d):
    return score(centrality.betweenness(tables.traffic(spark, d)))


#: Triangles of the simple graph s, and of each node.
_TRIANGLES = """t AS MATERIALIZED (SELECT x.a AS p, x.b AS q, y.b AS r FROM s x JOIN s y ON x.b = y.a JOIN s z ON z.a = x.a AND z.b = y.b WHERE x.a < x.b AND x.b < y.b),
i AS MATERIALIZED (SELECT id, count(*) AS t FROM (SELECT p AS id FROM t UNION ALL SELECT q FROM t UNION ALL SELECT r FROM t) GROUP BY id), k AS (SELECT a, count(*) AS k FROM s GROUP BY a),
n AS (SELECT v.id, coalesce(t, 0) AS t, coalesce(k, 0) AS k FROM v LEFT JOIN i USING (id) LEFT JOIN k ON k.a = v.id)"""


@query(f"WITH {TRAFFIC}, {_TRIANGLES} SELECT id AS node_id, t AS triangles, k AS neighbors, round(CASE WHEN k > 1 THEN 2.0 * t / (k * (k - 1)) ELSE 0 END, 6) AS clustering FROM n")
def triangles(spark, d):
    return score(centrality.triangles(tables.traffic(spark, d)), "clustering")


@query(f"WITH {TRAFFIC}, {_TRIANGLES} SELECT count(*) AS triangles FROM t")
def triangle_count(spark, d):
    return centrality.triangle_count(tables.traffic(spark, d))


@query(f"WITH {TRAFFIC}, {_TRIANGLES} SELECT id AS node_id, round(CASE WHEN k > 1 THEN 2.0 * t / (k * (k - 1)) ELSE 0 END, 6) AS score FROM n")
def local_clustering(spark, d):
    return score(centrality.local_clustering(tables.traffic(spark, d)))


_H_INDEX = "SELECT id, max(least(c, r)) AS c FROM (SELECT s.a AS id, {p}.c, row_number() OVER (PARTITION BY s.a ORDER BY {p}.c DESC) AS r FROM s JOIN {p} ON s.b = {p}.id) GROUP BY id"


@query(f"WITH {TRAFFIC}, {unrolled('SELECT a AS id, count(*) AS c FROM s GROUP BY a', _H_INDEX, 30)} SELECT v.id AS node_id, CAST(coalesce(c, 0) AS BIGINT) AS core FROM v LEFT JOIN p30 USING (id)")
def core_numbers(spark, d):
    return centrality.core_numbers(tables.traffic(spark, d))


# ---- the same over the knowledge graph, which grows with the tables
KV = "v AS MATERIALIZED (SELECT id FROM kn), nv AS MATERIALIZED (SELECT count(*) AS n FROM kn), e AS MATERIALIZED (SELECT src AS a, dst AS b, w::DOUBLE AS w FROM ke), u AS MATERIALIZED (SELECT a, b, w FROM e UNION ALL SELECT b, a, w FROM e), s AS MATERIALIZED (SELECT DISTINCT a, b FROM u WHERE a <> b)"


@query(f"WITH {KNOWLEDGE}, {KV}, k AS (SELECT a, count(*) AS k FROM e GROUP BY a), {unrolled('SELECT id, 1.0::DOUBLE / (SELECT n FROM nv) AS x FROM v', _PR, 20)} SELECT id AS node_id, round(x, 8) AS score FROM p20")
def knowledge_pagerank(spark, d):
    return centrality.pagerank(tables.knowledge(spark, d)).withColumn("score", F.round("score", 8))


@query(f"WITH {KNOWLEDGE}, {KV}, {unrolled('SELECT id, 1e0 AS hub, 1e0 AS authority FROM v', _HITS, 5)} SELECT id AS node_id, round(hub, 6) AS hub, round(authority, 6) AS authority FROM p5")
def knowledge_hits(spark, d):
    return score(centrality.hits(tables.knowledge(spark, d), 5), "hub", "authority")


@query(f"WITH {KNOWLEDGE}, {KV}, {unrolled('SELECT id, 0e0 AS x FROM v', _KZ, 8)} SELECT id AS node_id, round(x / (SELECT sqrt(sum(x * x)) FROM p8), 6) AS score FROM p8")
def knowledge_katz(spark, d):
    return score(centrality.katz(tables.knowledge(spark, d), 0.01, 1.0, 8, None))


@query(f"WITH {KNOWLEDGE}, {KV}, {unrolled('SELECT id, id AS c FROM v', 'SELECT id, min(c) AS c FROM (SELECT id, c FROM {p} UNION ALL SELECT s.a, {p}.c FROM s JOIN {p} ON s.b = {p}.id) GROUP BY id', 8)}, r AS (SELECT id, min(c) AS c FROM p8 GROUP BY id) SELECT id AS node_id, CAST(dense_rank() OVER (ORDER BY c) - 1 AS BIGINT) AS component FROM r")
def knowledge_components(spark, d):
    return paths.connected_components(tables.knowledge(spark, d))


@query(f"WITH {KNOWLEDGE}, {KV}, {unrolled('SELECT a AS id, count(*) AS c FROM s GROUP BY a', _H_INDEX, 30)} SELECT v.id AS node_id, CAST(coalesce(c, 0) AS BIGINT) AS core FROM v LEFT JOIN p30 USING (id)")
def knowledge_core_numbers(spark, d):
    return centrality.core_numbers(tables.knowledge(spark, d))


@query(f"WITH {KNOWLEDGE}, {KV}, {_TRIANGLES} SELECT id AS node_id, t AS triangles, k AS neighbors, round(CASE WHEN k > 1 THEN 2.0 * t / (k * (k - 1)) ELSE 0 END, 6) AS clustering FROM n")
def knowledge_triangles(spark, d):
    return score(centrality.triangles(tables.knowledge(spark, d)), "clustering")


@query(f"WITH {KNOWLEDGE}, {KV}, {unrolled(f'SELECT CAST({5 * T12 + 1} AS BIGINT) AS id, 0.0::DOUBLE AS d', 'SELECT id, min(d) AS d FROM (SELECT id, d FROM {p} UNION ALL SELECT e.b, {p}.d + 1 / e.w FROM {p} JOIN e ON e.a = {p}.id) GROUP BY id', 6)} SELECT id AS node_id, round(d, 6) AS dist FROM p6")
def knowledge_distances(spark, d):
    return score(paths.bellman_ford(tables.knowledge(spark, d), 5 * T12 + 1), "dist")


# ---- communities
_VOTE = """SELECT {p}.id, coalesce(n.c, {p}.c) AS c FROM {p} LEFT JOIN (SELECT id, c FROM (SELECT id, c, row_number() OVER (PARTITION BY id ORDER BY w DESC, c) AS r FROM (
SELECT id, c, sum(w) AS w FROM (SELECT l.a AS id, {p}.c, l.w FROM l JOIN {p} ON l.b = {p}.id UNION ALL
SELECT {p}.id, {p}.c, m.w / 2 FROM {p} JOIN (SELECT id, max(w) AS w FROM (SELECT l.a AS id, {p}.c, sum(l.w) AS w FROM l JOIN {p} ON l.b = {p}.id GROUP BY ALL) GROUP BY id) m ON m.id = {p}.id) GROUP BY id, c)) WHERE r = 1) n ON n.id = {p}.id"""


@query(f"WITH {TRAFFIC}, l AS MATERIALIZED (SELECT a, b, sum(w) AS w FROM u WHERE a <> b GROUP BY a, b), {unrolled('SELECT id, id AS c FROM v', _VOTE, 10)} SELECT id AS node_id, c AS community FROM p10")
def label_propagation(spark, d):
    return community.label_propagation(tables.traffic(spark, d))


@query(f"WITH {TRAFFIC} SELECT n AS members, true AS gained FROM nv")
def modularity_communities(spark, d):
    """Members in all, and whether the partition's modularity is above that of nodes alone, as moving only ever gains."""
    g = tables.traffic(spark, d)
    found = cut(community.modularity_communities(g))
    q = lambda c: community.modularity(g, c).select("modularity")
    alone = q(g.nodes.select("node_id", F.col("node_id").alias("community"))).withColumnRenamed("modularity", "alone")
    return found.agg(F.count_distinct("node_id").alias("members")).crossJoin(q(found)).crossJoin(alone).select("members", (F.col("modularity") > F.col("alone")).alias("gained"))


@query(f"WITH {TRAFFIC} SELECT n AS members, true AS gained FROM nv")
def leiden_communities(spark, d):
    """Members in all, and whether the partition's modularity is above that of nodes alone, as moving only ever gains."""
    g = tables.traffic(spark, d)
    found = cut(community.leiden(g))
    q = lambda c: community.modularity(g, c).select("modularity")
    alone = q(g.nodes.select("node_id", F.col("node_id").alias("community"))).withColumnRenamed("modularity", "alone")
    return found.agg(F.count_distinct("node_id").alias("members")).crossJoin(q(found)).crossJoin(alone).select("members", (F.col("modularity") > F.col("alone")).alias("gained"))


def _regions(spark, d):
    return tables.traffic(spark, d).nodes.select("node_id", (F.col("node_id") % 5).alias("community"))


@query(f"WITH {TRAFFIC}, k AS (SELECT a, sum(w) AS k FROM u GROUP BY a), m AS (SELECT 2 * sum(w) AS m FROM e) SELECT round(sum((e.w - x.k * y.k / m) / m), 6) AS modularity FROM e JOIN v p ON e.a = p.id JOIN v q ON e.b = q.id JOIN k x ON x.a = e.a JOIN k y ON y.a = e.b, m WHERE p.region = q.region")
def modularity(spark, d):
    return score(community.modularity(tables.traffic(spark, d), _regions(spark, d)), "modularity")


@query(f"WITH {TRAFFIC}, c AS (SELECT p.region AS community, count(*) AS vol, sum((p.region <> q.region)::INT) AS crossing FROM s JOIN v p ON s.a = p.id JOIN v q ON s.b = q.id GROUP BY 1), t AS (SELECT count(*) AS total FROM s) SELECT DISTINCT CAST(v.region AS BIGINT) AS community, round(CASE WHEN least(vol, total - vol) > 0 THEN crossing / least(vol, total - vol) ELSE 0 END, 6) AS conductance FROM v LEFT JOIN c ON c.community = v.region, t")
def conductances(spark, d):
    return score(community.conductances(tables.traffic(spark, d), _regions(spark, d)), "conductance")


@query(f"WITH {KNOWLEDGE} SELECT CAST(0 AS BIGINT) AS conflicts, (SELECT count(*) FROM kn) AS colored, true AS within")
def coloring(spark, d):
    """Ends of one colour, coloured nodes, and whether there are at most one more colours than the largest degree."""
    g = tables.knowledge(spark, d)
    found = cut(community.coloring(g))
    most = g.simple().groupBy("a").count().agg(F.max("count").alias("most"))
    return community.color_report(g, found).crossJoin(found.agg(F.count("color").alias("colored"))).crossJoin(most).select("conflicts", "colored", (F.col("colors") <= F.col("most") + 1).alias("within"))


@query(f"WITH {TRAFFIC} SELECT region AS community, count(*) AS members, string_agg('user ' || chr(39) || name || chr(39), '; ' ORDER BY id) AS summary FROM v GROUP BY 1")
def community_summaries(spark, d):
    return community.summaries(tables.traffic(spark, d), _regions(spark, d))


@query(f"""WITH {TRAFFIC}, inner_ AS (SELECT p.region, count(*) AS n FROM e JOIN v p ON e.a = p.id JOIN v q ON e.b = q.id WHERE p.region = q.region GROUP BY 1)
    SELECT v.region AS community, count(*) AS size, any_value(inner_.n) AS internal_edges, 'user' AS labels, array_to_string(list(name ORDER BY id)[1:5], '|') AS entities, string_agg('name: ' || name, chr(10) || '---' || chr(10) ORDER BY id) AS content,
           CAST(ceil(strlen(string_agg('name: ' || name, chr(10) || '---' || chr(10) ORDER BY id)) / 4.0) AS BIGINT) AS tokens FROM v JOIN inner_ USING (region) GROUP BY 1""")
def community_profiles(spark, d):
    found = community.community_profiles(tables.traffic(spark, d), _regions(spark, d))
    return found.withColumn("labels", F.array_join("labels", "|")).withColumn("entities", F.array_join("entities", "|"))


# ---- similarity, links, flow
_PAIR = f"WITH {TRAFFIC}, k AS (SELECT a, count(*) AS k FROM s GROUP BY a), c AS (SELECT x.a, y.b, count(*) AS n FROM s x JOIN s y ON x.b = y.a WHERE x.a < y.b GROUP BY ALL), p AS (SELECT c.a, c.b, n, x.k AS ka, y.k AS kb FROM c JOIN k x ON x.a = c.a JOIN k y ON y.a = c.b)"


@query(f"{_PAIR} SELECT a, b, round(n / (ka + kb - n), 6) AS jaccard, round(n / sqrt(ka * kb), 6) AS cosine, round(n / least(ka, kb), 6) AS overlap FROM p")
def neighborhood_similarity(spark, d):
    return score(similarity.similarities(tables.traffic(spark, d)), "jaccard", "cosine", "overlap")


@query(f"{_PAIR} SELECT a, b, round(n / (ka + kb - n), 6) AS score FROM p ORDER BY n / (ka + kb - n) DESC, a, b LIMIT 10")
def top_similar(spark, d):
    return score(similarity.top_similar(tables.traffic(spark, d)))


@query(f"{_PAIR} SELECT x.a, y.b, round(sum(CASE WHEN k.k > 1 THEN 1 / ln(k.k) ELSE 0 END), 6) AS adamic_adar, CAST(count(*) AS DOUBLE) AS common, round(sum(1.0 / k.k), 6) AS resource FROM s x JOIN s y ON x.b = y.a JOIN k ON k.a = x.b WHERE x.a < y.b AND NOT EXISTS (SELECT 1 FROM s WHERE s.a = x.a AND s.b = y.b) GROUP BY ALL")
def link_prediction(spark, d):
    found = similarity.all_link_scores(tables.traffic(spark, d))
    return score(found.select("a", "b", "adamic_adar", F.col("common_neighbors").alias("common"), F.col("resource_allocation").alias("resource")), "adamic_adar", "resource")


@query(f"WITH {TRAFFIC}, k AS (SELECT a, count(*) AS k FROM s GROUP BY a) SELECT x.a AS a, y.a AS b, CAST(x.k * y.k AS DOUBLE) AS score FROM k x JOIN k y ON x.a < y.a WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.a = x.a AND s.b = y.a) ORDER BY score DESC, a, b LIMIT 10")
def preferential_attachment(spark, d):
    return similarity.predict_links(tables.traffic(spark, d), "preferential_attachment")


@query(f"""WITH {TRAFFIC} SELECT least((SELECT sum(w) FROM e WHERE a = 1 AND b <> 1), (SELECT sum(w) FROM e WHERE b = 2 AND a <> 2)) AS most, true AS conserved""")
def max_flow(spark, d):
    """The flow's total (here what leaves the source or enters the sink is the bottleneck), and whether no node in between keeps any."""
    found = cut(flow.max_flow(tables.traffic(spark, d), 1, 2))
    sides = found.select(F.col("src").alias("n"), F.col("flow").alias("x")).unionAll(found.select("dst", -F.col("flow")))
    kept = sides.where("n NOT IN (1, 2)").groupBy("n").agg(F.abs(F.sum("x")).alias("x")).agg(F.coalesce(F.max("x"), F.lit(0.0)).alias("x"))
    return found.agg(F.max("total").alias("most")).crossJoin(kept).select("most", (F.col("x") < 1e-6).alias("conserved"))


@query(f"""WITH {TRAFFIC}, pr AS (SELECT least(a, b) AS a, greatest(a, b) AS b, min(w) AS w, arg_min(edge_id, (w, edge_id)) AS edge_id FROM e WHERE a <> b GROUP BY 1, 2),
    rk AS MATERIALIZED (SELECT a, b, w, edge_id, row_number() OVER (ORDER BY w, edge_id) AS r FROM pr), sy AS (SELECT a, b, r FROM rk UNION ALL SELECT b, a, r FROM rk UNION ALL SELECT id, id, 0 FROM v),
    {unrolled('SELECT a, b, min(r) AS r FROM sy GROUP BY a, b', 'SELECT x.a, y.b, min(greatest(x.r, y.r)) AS r FROM {{p}} x JOIN {{p}} y ON x.b = y.a GROUP BY x.a, y.b'.replace('{{', '{').replace('}}', '}'), 5)}
    SELECT rk.a, rk.b, rk.w AS weight, rk.edge_id FROM rk JOIN p5 ON p5.a = rk.a AND p5.b = rk.b WHERE p5.r = rk.r""")
def spanning_forest(spark, d):
    return flow.spanning_forest(tables.traffic(spark, d))


@query(f"WITH {TRAFFIC} SELECT id AS node_id, CAST(32 AS INT) AS dimensions, CASE WHEN id IN (SELECT a FROM u) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS length FROM v")
def fast_rp(spark, d):
    """Of each vector its dimensions and length; what a vector is made of is tested by brute force."""
    found = flow.fast_rp(tables.traffic(spark, d), 32)
    return found.select("node_id", F.size("vec").alias("dimensions"), F.round(F.sqrt(F.aggregate(F.transform("vec", lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x * x)), 3).alias("length"))


NOW = 1_000_000_000_000
_IMPORTANCE = f"SELECT kn.id AS node_id, least(1, greatest(0, 0.4 * coalesce(k, 0) / (SELECT max(k) FROM deg) + 0.3 * exp(-(greatest({NOW} - tx, 0) / 3600000.0) / 168))) AS x FROM kn LEFT JOIN deg ON deg.id = kn.id"
_DEG = "deg AS (SELECT id, count(*) AS k FROM (SELECT src AS id FROM ke UNION ALL SELECT dst FROM ke) GROUP BY id)"


@query(f"WITH {KNOWLEDGE}, {_DEG}, i AS ({_IMPORTANCE}) SELECT node_id, round(x, 6) AS importance FROM i ORDER BY x DESC, node_id LIMIT 10")
def most_important(spark, d):
    return score(importance.most_important(tables.knowledge(spark, d), NOW), "importance")


@query(f"WITH {KNOWLEDGE}, {_DEG}, i AS ({_IMPORTANCE}) SELECT count(*) AS n FROM i WHERE x >= 0.0003")
def condense(spark, d):
    return importance.condense(tables.knowledge(spark, d), NOW, 0.0003).nodes.agg(F.count("*").alias("n"))


@query(f"WITH {TRAFFIC}, x AS (SELECT user_id AS id, max(epoch_us(ts) // 1000) AS t FROM events GROUP BY 1), r AS (SELECT v.id, row_number() OVER (ORDER BY coalesce(t, 0), v.id) AS i FROM v LEFT JOIN x USING (id)) SELECT id AS node_id FROM r WHERE i <= (SELECT n FROM nv) + 1 - 12")
def lru_eviction(spark, d):
    from dataclasses import replace

    from .model import Settings

    access = tables.table(spark, d, "events").select(F.col("user_id").cast("long").alias("node_id"), tables.millis("ts").alias("accessed_at"))
    return importance.evictable(replace(tables.traffic(spark, d), settings=Settings(max_nodes=12, eviction="lru")), access)


@query("SELECT CAST(CASE WHEN n_nationkey < 3 THEN n_nationkey + 1 ELSE n_nationkey END AS BIGINT) AS id, CASE WHEN n_nationkey < 3 THEN 'alias-' || n_nationkey ELSE n_name END AS name, CASE WHEN n_nationkey < 3 THEN 'last' ELSE n_name END AS canonical FROM nation")
def alias_resolution(spark, d):
    n = tables.table(spark, d, "nation").select(F.when(F.col("n_nationkey") < 3, F.col("n_nationkey") + 1).otherwise(F.col("n_nationkey")).cast("long").alias("id"), F.when(F.col("n_nationkey") < 3, F.concat(F.lit("alias-"), F.col("n_nationkey").cast("string"))).otherwise(F.col("n_name")).alias("name"))
    return resolve.resolve_aliases(n, {"alias-0": "alias-1", "alias-1": "alias-2", "alias-2": "last"})


# ---- search and retrieval
@query("WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0), x AS (SELECT query_id, vec_id AS node_id, list_cosine_distance(q, embedding::DOUBLE[]) AS d FROM q, embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, node_id) AS rank FROM x) SELECT query_id, node_id, round(d, 5) AS distance FROM r WHERE rank <= 10")
def vector_search(spark, d):
    e = tables.embeddings(spark, d)
    queries = e.where("node_id % 100 = 0").select(F.col("node_id").alias("query_id"), "vec")
    return search.nearest(e, queries, 10).select("query_id", "node_id", F.round(F.abs("distance"), 5).alias("distance"))


@query("WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0), x AS (SELECT query_id, vec_id AS node_id, list_cosine_distance(q, embedding::DOUBLE[]) AS d FROM q, embeddings JOIN documents ON doc_id = vec_id WHERE lang = 'en'), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, node_id) AS rank FROM x) SELECT query_id, node_id, round(d, 5) AS distance FROM r WHERE rank <= 10")
def filtered_vector_search(spark, d):
    g = tables.library(spark, d)
    queries = g.embeddings.where("node_id % 100 = 0").select(F.col("node_id").alias("query_id"), "vec")
    return search.nearest_where(g, queries, 10, properties={"lang": "en"}).select("query_id", "node_id", F.round(F.abs("distance"), 5).alias("distance"))


BM25 = f"""{POSTINGS}, q AS (SELECT DISTINCT item_id, unnest({WORDS}) AS term FROM benchmark), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
hit AS (SELECT item_id AS query_id, doc_id AS node_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS x FROM post JOIN q USING (term) JOIN df USING (term), corpus GROUP BY ALL)"""


@query(f"WITH {BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(x, 6) DESC, node_id) AS rank FROM hit) SELECT query_id, node_id, round(x, 4) AS score FROM r WHERE rank <= 20")
def bm25_search(spark, d):
    queries = tables.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search.bm25_best(tables.documents(spark, d), queries, 20).select("query_id", "node_id", F.round("score", 4).alias("score"))


def _flagship(spark, d):
    g = tables.library(spark, d)
    ask = tables.table(spark, d, "benchmark").orderBy("item_id").first()["text"]
    return g, context.ContextQuery(text=ask, keys=("doc-1", "doc-2"), depth=2, budget=budget.Budget.preset("4k"), limit=50, at=10, decay=("none", None))


@query()
def context_query(spark, d):
    g, q = _flagship(spark, d)
    return context.context_query(g, q).chunks.select("node_id", "label", F.round("score", 6).alias("score"), "depth", "tokens", F.size(F.coalesce("relationships", F.array().cast("array<struct<label:string,direction:string,other:bigint,name:string,weight:double>>"))).alias("relationships"))


@query()
def context_hybrid(spark, d):
    g, q = _flagship(spark, d)
    vec = [float(x) for x in g.embeddings.where("node_id = 1").first()["vec"]]
    from dataclasses import replace

    return context.context_query(g, replace(q, mode="hybrid", vector=vec, rerank_weight=0.35, budget=budget.Budget(4096, "mmr"))).chunks.select("node_id", F.round("score", 6).alias("score"), "tokens")


@query()
def context_messages(spark, d):
    g, q = _flagship(spark, d)
    return context.messages(context.context_query(g, q), "openai", q.text)


# ---- resolution
@query(
    """WITH n AS (SELECT n_nationkey AS id, n_name AS name FROM nation), q AS (SELECT n_nationkey AS qid, left(n_name, length(n_name) - 1) AS name FROM nation),
    tg AS (SELECT id, unnest(list_distinct(CASE WHEN length(name) < 3 THEN [lower(name)] ELSE [substr(lower(name), i, 3) for i in range(1, length(name) - 1)] END)) AS t FROM n),
    tq AS (SELECT qid, unnest(list_distinct(CASE WHEN length(name) < 3 THEN [lower(name)] ELSE [substr(lower(name), i, 3) for i in range(1, length(name) - 1)] END)) AS t FROM q),
    c AS (SELECT DISTINCT qid, id FROM tg JOIN tq USING (t)), s AS (SELECT qid, c.id, jaro_winkler_similarity(n.name, q.name) AS x FROM c JOIN n USING (id) JOIN q USING (qid)),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY x DESC, id) AS rank FROM s WHERE x >= 0.85) SELECT CAST(qid AS BIGINT) AS query_id, CAST(id AS BIGINT) AS node_id, round(x, 6) AS score FROM r WHERE rank = 1"""
)
def blocked_resolution(spark, d):
    n = tables.table(spark, d, "nation")
    names = n.select(F.col("n_nationkey").cast("long").alias("node_id"), F.col("n_name").alias("name"))
    queries = n.select(F.col("n_nationkey").cast("long").alias("query_id"), F.expr("left(n_name, length(n_name) - 1)").alias("name"))
    return score(resolve.match_blocked(names, queries))


@query(f"WITH {TRAFFIC} SELECT id AS query_id, id AS node_id FROM v")
def key_resolution(spark, d):
    g = tables.traffic(spark, d)
    return resolve.match_key(g, g.nodes.select(F.col("node_id").alias("query_id"), "entity_key"))


@query("WITH x AS (SELECT a.vec_id AS q, b.vec_id AS n, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(s, 9) DESC, n) AS k FROM x) SELECT q AS query_id, n AS node_id FROM r WHERE k = 1 AND s > 0.92")
def vector_resolution(spark, d):
    e = tables.embeddings(spark, d)
    from .model import Graph

    g = Graph(None, None, e)
    return resolve.match_vector(g, e.where("node_id % 100 = 0").select(F.col("node_id").alias("query_id"), "vec")).select("query_id", "node_id")


@query("SELECT doc_id, CAST(length(regexp_replace(text, '\\s', '', 'g')) AS BIGINT) AS visible, CAST(0 AS BIGINT) AS oversize, CAST(0 AS BIGINT) AS misplaced FROM documents WHERE regexp_matches(text, '\\S')")
def chunked_documents(spark, d):
    """Of each document the characters in its chunks that aren't white space, and chunks that are too long or aren't where they say."""
    docs = tables.table(spark, d, "documents")
    pieces = resolve.chunk(docs, 512).join(docs.select("doc_id", "text"), "doc_id")
    at = F.decode(F.substring(F.encode("text", "utf-8"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")), "utf-8")
    return pieces.groupBy("doc_id").agg(
        F.sum(F.length(F.regexp_replace("content", r"\s", ""))).alias("visible"), F.sum((F.length("content") > 512).cast("long")).alias("oversize"), F.sum((at != F.col("content")).cast("long")).alias("misplaced")
    )


@query(f"WITH {TRAFFIC}, m AS (SELECT CASE WHEN a = 1 THEN 2 ELSE a END AS a, CASE WHEN b = 1 THEN 2 ELSE b END AS b, w, a = 1 OR b = 1 AS moved FROM e) SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, w FROM m WHERE NOT moved OR a <> b")
def node_merge(spark, d):
    return resolve.merge_nodes(tables.traffic(spark, d), 1, 2).edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("w"))


# ---- time and change
@query(f"WITH {KNOWLEDGE}, n AS (SELECT id FROM kn WHERE tx <= 800000000000) SELECT ke.label, count(*) AS n FROM ke JOIN n ON ke.src = n.id WHERE vf <= 800000000000 GROUP BY 1")
def point_in_time(spark, d):
    return timeline.at(tables.knowledge(spark, d), 800000000000)[1].groupBy("label").agg(F.count("*").alias("n"))


@query(f"WITH {KNOWLEDGE}, n AS (SELECT id FROM kn WHERE tx < 820000000000) SELECT ke.label, count(*) AS n FROM ke JOIN n ON ke.src = n.id WHERE vf < 820000000000 GROUP BY 1")
def time_range(spark, d):
    return timeline.during(tables.knowledge(spark, d), 800000000000, 820000000000)[1].groupBy("label").agg(F.count("*").alias("n"))


_DIFF = "SELECT '{0}' AS kind, CAST(coalesce(sum((t >= 800000000000 AND t < 850000000000)::INT), 0) AS BIGINT) AS added, CAST(0 AS BIGINT) AS removed, CAST(sum((t <= 800000000000)::INT) AS BIGINT) AS active_before, CAST(sum((t <= 850000000000)::INT) AS BIGINT) AS active_after FROM {1}"


@query(f"WITH {KNOWLEDGE} {_DIFF.format('node', '(SELECT tx AS t FROM kn)')} UNION ALL {_DIFF.format('edge', '(SELECT vf AS t FROM ke)')}")
def graph_diff(spark, d):
    return timeline.diff(tables.knowledge(spark, d), 800000000000, 850000000000)


@query(f"WITH {TRAFFIC} SELECT edge_id, a AS src, b AS dst, true AS active FROM e WHERE a = 1 OR b = 1")
def node_history(spark, d):
    return timeline.history(tables.traffic(spark, d), 1).select("edge_id", "src", "dst", "active")


@query("SELECT event_id AS sequence, 'user-' || (user_id % 10) AS graph FROM events WHERE event_id > 100 AND user_id % 10 = 3 ORDER BY event_id DESC LIMIT 200")
def event_replay(spark, d):
    return cdc.replay(tables.change_events(spark, d), 100, "user-3", 200).select("sequence", "graph")


_KIND = "CASE event_type WHEN 'signup' THEN 'node_created' WHEN 'view' THEN 'node_updated' WHEN 'click' THEN 'edge_created' WHEN 'purchase' THEN 'edge_invalidated' WHEN 'error' THEN 'node_deleted' END"


@query(f"WITH x AS (SELECT 'user-' || (user_id % 10) AS graph, {_KIND} AS kind, event_id % 97 AS id, epoch_us(ts) // 1000 AS t FROM events) SELECT graph, split_part(kind, '_', 1) AS entity, id, min(t) FILTER (kind LIKE '%_created') AS opened, min(t) FILTER (kind LIKE '%_deleted' OR kind LIKE '%_invalidated') AS closed FROM x GROUP BY ALL")
def event_lifetimes(spark, d):
    return cdc.lifetimes(tables.change_events(spark, d))


@query(f"SELECT epoch_ms(time_bucket(INTERVAL 1 hour, ts)) AS start_ms, 'user-' || (user_id % 10) AS graph, {_KIND} AS kind, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, d):
    e = tables.change_events(spark, d)
    return cdc.kind_counts(e, "1 hour").select(F.unix_millis("window.start").alias("start_ms"), "graph", "kind", "n")


@query("SELECT 'node' AS entity, (SELECT count(*) FROM orders WHERE epoch_ms(o_orderdate) + 200000000000 <= 1000000000000) AS n")
def expired(spark, d):
    g = tables.knowledge(spark, d)
    dated = g.with_nodes(g.nodes.withColumn("ttl_expires_at", F.when(F.col("label") == "orders", F.col("tx_from") + 200000000000)))
    return ttl.expired_nodes(dated, 1000000000000).agg(F.count("*").alias("n")).select(F.lit("node").alias("entity"), "n")


# ---- profiling and exchange
@query(f"WITH {TRAFFIC} SELECT (SELECT count(*) FROM v) AS nodes, (SELECT count(*) FROM e) AS edges, round(2.0 * (SELECT count(*) FROM e) / (SELECT count(*) FROM v), 6) AS avg_degree")
def graph_stats(spark, d):
    return profile.stats(tables.traffic(spark, d))


@query(f"""WITH {TRAFFIC}, g AS (SELECT id, (SELECT count(*) FROM u WHERE a = id) AS k FROM v), o AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM g),
    t AS (SELECT count(DISTINCT w) AS terms FROM (SELECT unnest(list_filter(regexp_extract_all(lower(name), '[\\p{{L}}\\p{{N}}]+'), lambda x: strlen(x) >= 2)) AS w FROM v))
    SELECT (SELECT n FROM nv) AS nodes, (SELECT count(*) FROM e) AS edges, round(2.0 * (SELECT count(*) FROM e) / (SELECT n FROM nv), 6) AS avg_degree, min(k) AS min_degree, max(k) AS max_degree,
           max(k) FILTER (i = n // 2) AS p50, max(k) FILTER (i = least(floor(n * 0.95), n - 1)) AS p95, max(k) FILTER (i = least(floor(n * 0.99), n - 1)) AS p99, CAST(0 AS BIGINT) AS vectors, (SELECT n FROM nv) AS text_indexed, (SELECT terms FROM t) AS terms,
           CAST(0 AS BIGINT) AS temporal_nodes, 'user=' || (SELECT n FROM nv) AS labels, 'follows=' || (SELECT count(*) FROM e) AS edge_types, CAST(64 * (SELECT n FROM nv) + 96 * (SELECT count(*) FROM e) + 128 * (SELECT terms FROM t) AS BIGINT) AS memory_bytes FROM o""")
def detailed_stats(spark, d):
    return profile.detailed_stats(tables.traffic(spark, d))


@query("SELECT 'part' AS label, unnest(['name', 'brand', 'size']) AS key, (SELECT count(*) FROM part) AS n UNION ALL SELECT 'customer', unnest(['name', 'segment']), (SELECT count(*) FROM customer) UNION ALL SELECT 'orders', unnest(['status', 'priority']), (SELECT count(*) FROM orders) UNION ALL SELECT 'supplier', 'name', (SELECT count(*) FROM supplier) UNION ALL SELECT 'nation', 'name', (SELECT count(*) FROM nation) UNION ALL SELECT 'region', 'name', (SELECT count(*) FROM region)")
def schema_properties(spark, d):
    return profile.properties(tables.knowledge(spark, d))


@query(" UNION ALL ".join(f"SELECT '{label}' AS label, '{key}' AS key, '{kind}' AS type, count({c}) AS present, round(1 - count({c})::DOUBLE / count(*), 3) AS null_rate, count(DISTINCT {c}) AS distinct_values, count({c}) = count(*) AS required, count({c}) = count(DISTINCT {c}) AS is_unique FROM {label}" for label, key, kind, c in (("part", "brand", "string", "p_brand"), ("part", "size", "int", "p_size"), ("part", "name", "string", "p_name"), ("customer", "name", "string", "c_name"), ("customer", "segment", "string", "c_mktsegment"), ("orders", "status", "string", "o_orderstatus"), ("orders", "priority", "string", "o_orderpriority"), ("supplier", "name", "string", "s_name"), ("nation", "name", "string", "n_name"), ("region", "name", "string", "r_name"))))
def schema_inference(spark, d):
    found = profile.infer_schema(tables.knowledge(spark, d))
    return found.select("label", "key", "type", "present", "null_rate", F.col("distinct").alias("distinct_values"), "required", F.col("unique").alias("is_unique"))


@query("SELECT 'unique' AS \"constraint\", count(*) AS n FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY 1 HAVING count(*) > 1)")
def schema_violations(spark, d):
    rules = [("node", "part", "unique", "brand", None), ("node", "part", "required", "name", None), ("node", "part", "type", "size", "int")]
    return profile.violations(tables.knowledge(spark, d), rules).groupBy("constraint").agg(F.count("*").alias("n"))


@query(f"WITH {TRAFFIC} SELECT '  n' || a || ' -> n' || b || ' [label=\"follows\"];' AS line FROM e UNION ALL SELECT '  n' || id || ' [label=\"user: ' || name || '\"];' FROM v UNION ALL SELECT 'digraph \"traffic\" {{' UNION ALL SELECT '}}'")
def dot_export(spark, d):
    return exchange.dot_lines(tables.traffic(spark, d)).select("line")


@query(f"""WITH {TRAFFIC} SELECT '{{"id":' || id || ',"label":"user","entity_key":"' || name || '","properties":{{"name":"' || name || '"}}}}' AS value FROM v
    UNION ALL SELECT '{{"id":' || edge_id || ',"source":' || a || ',"target":' || b || ',"label":"follows","weight":' || w || ',"properties":{{}},"valid_from":0}}' FROM e""")
def json_export(spark, d):
    nodes, edges = exchange.to_json(tables.traffic(spark, d))
    return nodes.unionAll(edges)


@query(f"WITH {TRAFFIC} SELECT 'user' AS _label, name FROM v")
def csv_export(spark, d):
    return exchange.csv_rows(tables.traffic(spark, d))


@query(f"WITH {KNOWLEDGE} SELECT CAST(sum((vf <= 800000000000)::INT) AS BIGINT) AS valid_at, CAST(sum((vf < 810000000000)::INT) AS BIGINT) AS valid_during FROM ke")
def temporal_predicates(spark, d):
    e = tables.knowledge(spark, d).edges
    return e.agg(F.sum(is_valid_at(800000000000).cast("long")).alias("valid_at"), F.sum(is_valid_during(800000000000, 810000000000).cast("long")).alias("valid_during"))
