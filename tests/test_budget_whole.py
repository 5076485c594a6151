import random

import pytest

from graphloom import catalog
from graphloom.operators import budget


def slow(kind, labels, scores, sizes, tokens, weight):
    """The definition, chunk by chunk."""
    low, high = min(scores), max(scores)
    rel = [(s - low) / (high - low) if high - low > 1.1920929e-07 else 1.0 for s in scores]
    left, used, taken, seen = list(range(len(scores))), 0, [], set()
    while fit := [r for r, i in enumerate(left) if not (sizes[i] > 0 and used + sizes[i] > tokens)]:
        if kind == "mmr":
            r = max(fit, key=lambda r: (weight * rel[left[r]] - (1 - weight) * (labels[left[r]] in seen), -r))
        else:
            r = max(fit, key=lambda r: (weight * rel[left[r]] + (1 - weight) * (0 if labels[left[r]] in seen else labels.count(labels[left[r]])), -left[r]))
        i, left[r] = left[r], left[-1]
        left.pop()
        taken.append(i)
        used += sizes[i]
        seen.add(labels[i])
    return taken


@pytest.mark.parametrize("kind, pick, weight", [("mmr", budget.pick_mmr, 0.7), ("submodular", budget.pick_submodular, 0.5)])
def test_packers_follow_their_definition(kind, pick, weight):
    r = random.Random(3)
    for n in (0, 1, 2, 30, 200):
        for _ in range(20):
            labels, scores, sizes = [r.choice("abcd") for _ in range(n)], [r.randrange(9) / 8 for _ in range(n)], [r.randrange(60) for _ in range(n)]
            assert pick(labels, scores, sizes, 500, weight) == (slow(kind, labels, scores, sizes, 500, weight) if n else [])


@pytest.mark.parametrize("query", [catalog.budget_mmr, catalog.budget_submodular])
def test_packers_see_every_chunk(spark, tmp_path, query):
    rows = [(i, "x" * (96 * 97 + 96), "en", "big", 96 * 97 + 96) for i in range(600)] + [(600, "y" * 50, "en", "other", 50)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert "other" in {r["label"] for r in query(spark, str(tmp_path)).collect()}
