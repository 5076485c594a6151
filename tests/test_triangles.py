"""Triangles from neighbour lists, against brute force."""

import random
from collections import Counter
from itertools import combinations

import pytest

from graphloom.model import Graph
from graphloom.operators import centrality, compact


def awkward():
    """A hub, a clique, random edges, parallel ones in both directions, self-loops, a lone node, ends that are no nodes."""
    draw = random.Random(3)
    edges = [(7, 1000 + i) for i in range(150)] + [(3000 + i, 3000 + j) for i in range(9) for j in range(i)]
    edges += [(draw.randrange(1000, 1150), draw.randrange(1000, 1150)) for _ in range(500)] + [(7, 1003), (1003, 7), (7, 7), (-5, 7), (1003, -5)]
    return sorted({x for e in edges for x in e} - {-5} | {9}), edges


@pytest.mark.parametrize("entries, at_once", [(2_000_000_000, 1 << 20), (2_000_000_000, 3), (10, 1 << 20)])
def test_triangles_are_counted_in_lists_or_joined(spark, monkeypatch, entries, at_once):
    nodes, edges = awkward()
    near = {i: set() for i in [*nodes, -5]}
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    met = Counter(i for a in near for b, c in combinations(sorted(x for x in near[a] if x > a), 2) if c in near[b] for i in (a, b, c))
    want = {i: (met[i], len(near[i])) for i in nodes}
    monkeypatch.setattr(compact, "MOST_ONCE", entries)
    plain = compact.triangles
    monkeypatch.setattr(compact, "triangles", lambda packed, spark: plain(packed, spark, at_once))
    found = centrality.triangles(Graph.local(spark, [{"node_id": i} for i in nodes], [{"src": a, "dst": b} for a, b in edges]))
    assert ("Join" in found._jdf.queryExecution().executedPlan().toString()) == (entries == 10)
    rows = found.collect()
    assert {r["node_id"]: (r["triangles"], r["neighbors"]) for r in rows} == want and len(rows) == len(nodes)
    assert all(abs(r["clustering"] - (2 * r["triangles"] / (r["neighbors"] * (r["neighbors"] - 1)) if r["neighbors"] > 1 else 0)) < 1e-12 for r in rows)


def test_no_nodes_no_links(spark):
    made = lambda n, e: Graph.local(spark, [{"node_id": i} for i in n], [{"src": a, "dst": b} for a, b in e])
    assert centrality.triangles(made([], [])).collect() == []
    assert [tuple(r) for r in centrality.triangles(made([4], [(4, 4)])).collect()] == [(4, 0, 0, 0.0)]
    assert centrality.triangle_count(made([1, 2, 3], [(1, 2), (2, 3), (3, 1), (1, 3)])).first()[0] == 1
