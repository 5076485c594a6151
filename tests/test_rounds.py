"""PageRank, HITS, Katz and the like from neighbour lists, against dense matrices and the joins."""

import random

import numpy as np
import pytest

from graphloom.model import Graph
from graphloom.operators import centrality, compact


@pytest.fixture(scope="module")
def drawn(spark):
    """A hub, parallel edges, self-loops, dangling nodes, a lone node, and ends that are no nodes, on either side."""
    draw = random.Random(2)
    edges = [(1, 10 + i) for i in range(40)] + [(draw.randrange(10, 60), draw.randrange(10, 60)) for _ in range(120)] + [(10, 11)] * 3 + [(12, 12), (900, 11), (13, 901)]
    nodes = [1, 5, *range(10, 70)]
    g = Graph.local(spark, [{"node_id": i} for i in nodes], [{"src": a, "dst": b} for a, b in edges])
    return nodes, edges, g


def scores(df, *names):
    return {r["node_id"]: [r[c] for c in names or ("score",)] for r in df.collect()}


def test_rounds_shuffle_nothing_and_equal_the_joins(drawn, monkeypatch):
    nodes, edges, g = drawn
    seeds = g.nodes.where("node_id IN (10, 12, 5)")
    ask = {
        "pagerank": lambda: scores(centrality.pagerank(g, rounds=7)),
        "personalized": lambda: scores(centrality.personalized_pagerank(g, seeds, rounds=3)),
        "hits": lambda: scores(centrality.hits(g, 3), "hub", "authority"),
        "katz": lambda: scores(centrality.katz(g, 0.01, 1.0, 4, None)),
    }
    found = {k: f() for k, f in ask.items()}
    plan = centrality.katz(g, 0.01, 1.0, 2, None)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    monkeypatch.setattr(compact, "MOST_ONCE", -1)
    for k, f in ask.items():
        want = f()
        assert found[k].keys() == want.keys() == set(nodes)
        assert all(found[k][i] == pytest.approx(want[i], abs=1e-12) for i in nodes), k


def test_pagerank_of_a_multigraph_is_that_of_the_matrix(drawn):
    nodes, edges, g = drawn
    at, n = {i: k for k, i in enumerate(nodes)}, len(nodes)
    deg, m = np.zeros(n), np.zeros((n, n))
    for a, b in edges:
        if a in at:
            deg[at[a]] += 1
            if b in at:
                m[at[b], at[a]] += 1
    x = np.full(n, 1 / n)
    for _ in range(7):
        x = 0.15 / n + 0.85 * (m @ np.divide(x, deg, out=np.zeros(n), where=deg > 0) + x[deg == 0].sum() / n)
    found = scores(centrality.pagerank(g, rounds=7))
    assert [found[i][0] for i in nodes] == pytest.approx(x.tolist())
