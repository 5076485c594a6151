"""What asks every node about its surroundings, from neighbour lists in the tasks' memory, against brute force."""

import math
import random
from collections import deque

import pytest

from graphloom.model import Graph
from graphloom.operators import centrality, compact, paths, similarity


def made(spark, n, edges):
    return Graph.local(spark, [{"node_id": i} for i in n], [{"src": a, "dst": b} for a, b in edges])


def awkward():
    """A hub, a chain, parallel edges, self-loops, another component and a lone node."""
    draw = random.Random(3)
    edges = [(7, 1000 + i) for i in range(150)] + [(2000 + i, 2001 + i) for i in range(40)] + [(1000, 2000)]
    edges += [(draw.randrange(1000, 1150), draw.randrange(1000, 1150)) for _ in range(200)] + [(7, 1003), (1003, 7), (7, 7), (5000, 5001)]
    return sorted({x for e in edges for x in e} | {9}), edges


def hops(edges, sources, mutual=True, most=10**9):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        if mutual:
            out.setdefault(b, set()).add(a)
    found = {}
    for s in sources:
        d, queue = {s: 0}, deque([s])
        while queue:
            a = queue.popleft()
            for b in out.get(a, ()) if d[a] < most else ():
                if b not in d:
                    d[b] = d[a] + 1
                    queue.append(b)
        found[s] = d
    return found


def test_closeness_and_harmonic_hold_no_pairs(spark):
    nodes, edges = awkward()
    g, d = made(spark, nodes, edges), hops(edges, nodes)
    close, harmonic = centrality.closeness(g), centrality.harmonic(g)
    for df in (close, harmonic):  # no join or shuffle of (source, node)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Join" not in plan and "Aggregate" not in plan.split("MapInArrow")[0]
    want = {s: (len(x) - 1) / sum(x.values()) if len(x) > 1 else 0.0 for s, x in d.items()}
    assert {r["node_id"]: r["score"] for r in close.collect()} == pytest.approx(want)
    want = {s: sum(1 / k for k in x.values() if k) / (len(nodes) - 1) for s, x in d.items()}
    assert {r["node_id"]: r["score"] for r in harmonic.collect()} == pytest.approx(want)


def test_betweenness_from_lists_is_that_of_joins(spark):
    nodes, edges = awkward()
    g = made(spark, nodes, edges)
    found = centrality.betweenness(g)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    joined = centrality.betweenness(g, centrality.distances(g))
    assert {r["node_id"]: r["score"] for r in found.collect()} == pytest.approx({r["node_id"]: r["score"] for r in joined.collect()})


def test_lists_too_large_for_tasks_are_joined(spark, monkeypatch):
    nodes, edges = awkward()
    g = made(spark, nodes, edges)
    lists = {r["node_id"]: r["score"] for r in centrality.closeness(g).collect()}
    monkeypatch.setattr(compact, "MOST_ENTRIES", 10)
    assert {r["node_id"]: r["score"] for r in centrality.closeness(g).collect()} == pytest.approx(lists)


def test_hop_counts_carry_no_paths(spark):
    nodes, edges = awkward()
    g = made(spark, nodes, edges)
    found = paths.hop_counts(g, g.nodes, 10)
    assert found.columns == ["source", "node_id", "hops"] and "Join" not in found._jdf.queryExecution().executedPlan().toString()
    want = {(s, n, k) for s, x in hops(edges, nodes, False, 10).items() for n, k in x.items()}
    assert {tuple(r) for r in found.collect()} == want == {(r["source"], r["node_id"], r["hops"]) for r in paths.hop_paths(g, g.nodes, 10).collect()}


def test_pairs_leave_as_they_are_found(spark):
    nodes, edges = awkward()
    g, near = made(spark, nodes, edges), {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    shared = {(a, b): near[a] & near[b] for a in near for b in near if a < b and near[a] & near[b]}
    found = similarity.common_counts(g)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    assert {(r["a"], r["b"]): r["n"] for r in found.collect()} == {p: len(c) for p, c in shared.items()}
    want = {p: len(c) / len(near[p[0]] | near[p[1]]) for p, c in shared.items()}
    assert {(r["a"], r["b"]): r["jaccard"] for r in similarity.similarities(g).collect()} == pytest.approx(want)
    best = sorted(want, key=lambda p: (-want[p], p))[:10]
    assert [(r["a"], r["b"]) for r in similarity.top_similar(g, k=10).collect()] == best
    free = {p: c for p, c in shared.items() if p[1] not in near[p[0]]}
    rows = {(r["a"], r["b"]): r for r in similarity.all_link_scores(g).collect()}
    assert {p: (r["common_neighbors"], r["resource_allocation"], r["adamic_adar"]) for p, r in rows.items()} == {p: pytest.approx((len(c), sum(1 / len(near[x]) for x in c), sum(1 / math.log(len(near[x])) for x in c))) for p, c in free.items()}
    # a node whose neighbours' lists are too long to hold is counted in pieces
    packed = compact.pack(g.simple(), g.nodes)
    pieces = compact.pairs(packed, g.nodes, lambda p: [p["a"], p["b"], p["n"], p["resource"]], "a long, b long, n long, x double", True, 20)
    assert {(r["a"], r["b"]): (r["n"], r["x"]) for r in pieces.collect()} == {p: (len(c), pytest.approx(sum(1 / len(near[x]) for x in c))) for p, c in shared.items()}
