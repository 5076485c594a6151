"""Distances are held some at a time, whatever the number of queries and rows."""

import numpy as np

from graphloom.operators import search


def test_no_batch_holds_more_distances_than_the_bound():
    draw = np.random.default_rng(5)
    q, x = draw.normal(size=(700, 8)), draw.normal(size=(5000, 8))
    ids, node = np.arange(700), np.arange(5000) + 10_000
    exact = search._distance(q, x, "cosine")
    every = list(search._pairwise(("cosine", "ip"), ids, q, node, x))
    assert max(b.num_rows for b in every) <= search._CELLS and sum(b.num_rows for b in every) == 700 * 5000
    found = np.full((700, 5000), np.nan)
    for b in every:
        found[b.column(0).to_numpy(), b.column(1).to_numpy() - 10_000] = b.column(2).to_numpy()
    assert np.allclose(found, exact)
    held = []
    distance = search._distance
    search._distance = lambda *a: held.append((d := distance(*a)).size) or d
    try:
        top = list(search._top(ids, q, node, x, 5, "cosine"))
    finally:
        search._distance = distance
    assert max(held) <= search._CELLS
    got = {(i, n) for b in top for i, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
    assert got == {(int(i), int(n) + 10_000) for i, row in enumerate(np.argsort(exact, axis=1)[:, :5]) for n in row}
