import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import exact_dedup, near_dedup
from graphloom.llm.exact_dedup import ContentTable, combine, grace

from .helpers import docs, words


def test_exact_groups_against_brute_force(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = d.select("doc_id", "text").collect()
    least = {}
    for r in rows:
        least[r["text"]] = min(r["doc_id"], least.get(r["text"], r["doc_id"]))
    got = {r["doc_id"]: r for r in exact_dedup.exact_duplicates(d).collect()}
    assert {i: r["group_id"] for i, r in got.items()} == {r["doc_id"]: least[r["text"]] for r in rows}
    assert {i for i, r in got.items() if r["keep"]} == set(least.values())


def test_exact_awkward_rows(spark):
    long = words(50_000)
    d = docs(spark, [(1, "a b", "en", "s"), (2, "a b", "en", "s"), (2, "a b", "en", "s"), (3, None, "en", "s"), (4, None, "en", "s"), (5, "", "en", "s"), (6, "", "en", None), (None, "a b", None, "s"), (7, long, "en", "s"), (8, long, "en", "s"), (9, long + "x", "en", "s")], clash=True)
    kept = exact_dedup.drop_exact_duplicates(d)
    assert kept.columns == d.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 5, 7, 9]
    assert exact_dedup.drop_exact_duplicates(d.limit(0)).count() == 0


def test_repeated_rows_keep_exactly_one(spark):
    d = docs(spark, [(1, "one two three four", "en", "s")] * 3 + [(2, "five six seven eight", "en", "s")] * 2)
    assert sorted(r["doc_id"] for r in exact_dedup.drop_exact_duplicates(d).collect()) == [1, 2]
    assert sorted(r["doc_id"] for r in near_dedup.drop_near_duplicates(d).collect()) == [1, 2]


def _batches(texts, hashes):
    for at in range(0, len(texts), 7):
        n = min(7, len(texts) - at)
        yield pa.RecordBatch.from_arrays([pa.array(hashes[at : at + 7], pa.int64()), pa.array(texts[at : at + 7], pa.string()), pa.array(range(at, at + n), pa.int64()), pa.array([1] * n, pa.int64())], ["th", "text", "least", "n"])


@pytest.mark.parametrize("table_bytes", [1, 2_000, 1 << 20])
def test_grace_recursion_and_hash_collisions(tmp_path, table_bytes):
    rng = random.Random(1)
    texts = [f"text {rng.randrange(40)} " * 3 for _ in range(300)]
    hashes = [(hash(t) % 9) * 2**58 - 2**62 for t in texts]  # many contents share a hash
    combined = list(combine(_batches(texts, hashes), table_bytes))
    out = [r for b in grace(combined, f"file://{tmp_path}", table_bytes) for r in b.to_pylist()]
    least, size = {}, Counter(texts)
    for i, t in enumerate(texts):
        least.setdefault(t, i)
    assert sorted((r["least"], r["n"]) for r in out) == sorted((least[t], n) for t, n in size.items())
    assert not list(tmp_path.iterdir())  # spill files are gone
    if table_bytes > 1000:
        assert sum(b.num_rows for b in combined) < 300  # copies are gone before the shuffle


def test_hash_collisions_and_hot_text_under_a_small_table(spark, monkeypatch):
    from pyspark.sql import functions as F

    d = docs(spark, [(i, f"text {i % 5}", "en", "s") for i in range(60)] + [(100, None, "en", "s")])
    few = exact_dedup.F.pmod(F.length("text"), F.lit(1)).cast("long")  # every text has the same 64 bits
    monkeypatch.setattr(exact_dedup, "text_key", lambda text="text": F.coalesce(few, F.lit(0)))
    got = {r["doc_id"]: (r["group_id"], r["group_size"], r["keep"]) for r in exact_dedup.exact_duplicates(d, 1000).collect()}
    assert got == {**{i: (i % 5, 12, i < 5) for i in range(60)}, 100: (100, 1, True)}
    monkeypatch.undo()
    hot = spark.range(100_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 9, F.lit("hot " * 50)).otherwise(F.concat(F.lit("cold "), F.col("id") % 1000)).alias("text"))
    rows = exact_dedup.exact_duplicates(hot, 3000).groupBy("group_id").agg(F.count("*").alias("n"), F.min("group_size").alias("size"), F.sum(F.col("keep").cast("int")).alias("kept")).collect()
    assert len(rows) == 101 and all(r["n"] == r["size"] and r["kept"] == 1 for r in rows) and max(r["n"] for r in rows) == 90_000


def test_open_addressing_grows():
    t = ContentTable(4)
    for i in range(100):
        found, slot = t.find(i % 3, str(i))
        assert found < 0
        t.add(i % 3, str(i), slot)
    assert [t.find(i % 3, str(i))[0] for i in range(100)] == list(range(100))


def _shingles(text):
    w = re.findall(r"[^\W_]+", text.lower())
    return frozenset(zip(*[w[k:] for k in range(3)])) or frozenset([tuple(w)])


def test_near_recall_and_precision_against_all_pairs(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sets = {r["doc_id"]: _shingles(r["text"]) for r in d.select("doc_id", "text").collect()}
    jaccard = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(sorted(sets), 2)}
    group = {r["doc_id"]: r["group_id"] for r in near_dedup.near_duplicates(d).collect()}
    alike = [p for p, j in jaccard.items() if j >= near_dedup.THRESHOLD]
    assert alike and sum(group[a] == group[b] for a, b in alike) >= 0.9 * len(alike)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), j in jaccard.items():  # what may be linked, allowing for the estimate's error
        if j >= near_dedup.THRESHOLD - 0.15:
            root[max(find(a), find(b))] = min(find(a), find(b))
    assert all(find(i) == find(g) for i, g in group.items())


def test_near_planted_copies_large_group_and_clean_rows(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(3000)]
    base = rng.choices(vocabulary, k=300)
    rows = [(0, " ".join(base), "en", "s")]
    for i in range(1, 120):  # a group larger than a leaf
        copy = list(base)
        for _ in range(6):
            copy[rng.randrange(300)] = rng.choice(vocabulary)
        rows.append((i, " ".join(copy), "en", "s"))
    clean = [(1000 + i, " ".join(rng.choices(vocabulary, k=200)), "en", "s") for i in range(60)]
    kept = {r["doc_id"] for r in near_dedup.drop_near_duplicates(docs(spark, rows + clean)).collect()}
    assert kept == {0} | {c[0] for c in clean}


def test_near_awkward_rows(spark):
    long = words(40_000)
    rows = [(1, None, "en", "s"), (2, "", "en", "s"), (3, "!!! ...", "en", "s"), (4, "one", "en", "s"), (5, "ONE!", "en", "s"), (6, "one two", "en", "s"), (7, long, "en", "s"), (8, long + " end", "en", "s"), (None, "null id text here", "en", "s")]
    d = docs(spark, rows, clash=True)
    kept = near_dedup.drop_near_duplicates(d)
    assert kept.columns == d.columns
    assert {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 4, 6, 7, None}
    assert near_dedup.near_duplicates(d.limit(0)).count() == 0 and near_dedup.drop_near_duplicates(d.limit(0)).count() == 0


def test_leaves_adapt_their_depth():
    labels = np.zeros((100, near_dedup.DEPTH), np.uint32)
    labels[:50, 4:] = 1
    labels = labels[np.lexsort(labels.T[::-1])]
    found = near_dedup.leaves(np.zeros(100, np.int64), labels, leaf=60)
    assert len(set(found)) == 2  # the region of 100 is taken apart, its parts of 50 aren't
    assert len(set(near_dedup.leaves(np.zeros(100, np.int64), labels, leaf=100))) == 1
    assert set(near_dedup.leaves(np.arange(5), np.zeros((5, near_dedup.DEPTH), np.uint32))) == {-1}


def test_components(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(30)] + [(101, 100), (102, 101), (100, 102)], "a long, b long")
    found = {r["node"]: r["component"] for r in near_dedup.components(edges).collect()}
    assert all(found[i] == 0 for i in range(1, 31)) and found[101] == found[102] == 100


def _families(rng, n, bits):
    """Sketches that drift: each is some earlier one with a few minima changed."""
    out = [rng.integers(0, 16, near_dedup._K, dtype=np.uint8)]
    for _ in range(n - 1):
        x = out[rng.integers(0, len(out))].copy()
        x[rng.integers(0, len(x), rng.integers(0, bits))] = rng.integers(0, 16, 1, dtype=np.uint8)
        out.append(x)
    low = np.array(out)
    return np.ascontiguousarray(low[:, 0::2] | (low[:, 1::2] << 4)).view(np.uint64)


@pytest.mark.parametrize("bits", [30, 70, 110])
def test_large_leaves_have_the_components_of_all_pairs(bits):
    rng = np.random.default_rng(bits)
    sketch = _families(rng, 400, bits)
    most = near_dedup.most_mismatches(near_dedup.THRESHOLD)
    a, b = np.triu_indices(400, 1)
    near = near_dedup._mismatches(sketch[a], sketch[b]) <= most
    brute = near_dedup._link(np.arange(400), a[near], b[near])
    found = near_dedup.leaf_components(np.zeros(400, np.int64), sketch)
    assert [set(np.flatnonzero(found == x)) for x in found] == [set(np.flatnonzero(brute == x)) for x in brute]
    nibbles = lambda x: np.stack([x.view(np.uint8) & 15, x.view(np.uint8) >> 4])
    assert near_dedup._mismatches(sketch[3], sketch[9]) == (nibbles(sketch[3].copy()) != nibbles(sketch[9].copy())).sum()


@pytest.mark.parametrize("block", [64, 150, 1 << 17])
def test_large_regions_in_blocks(tmp_path, monkeypatch, block):
    rng = np.random.default_rng(3)
    n = 700
    sketch = _families(rng, n, 80)
    labels = np.zeros((n, near_dedup.DEPTH), np.uint32)
    labels[:, 4:] = rng.integers(0, 3, (n, 4)) * (rng.random(n) < 0.6)[:, None]
    order = np.lexsort(labels.T[::-1])
    labels, node = labels[order], np.arange(n)
    expected = near_dedup._link(np.arange(n), node, near_dedup.leaf_components(near_dedup.leaves(np.zeros(n, np.int64), labels, leaf=48), sketch))
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    region = near_dedup._LargeRegion(near_dedup.THRESHOLD, near_dedup.LEAST_DEPTH, f"file://{tmp_path}")
    links = []
    for at in range(0, n, 50):
        links += region.take(labels[at : at + 50], node[at : at + 50], sketch[at : at + 50])
    links += region.end()
    found = near_dedup._link(np.arange(n), np.concatenate([x for x, _ in links]), np.concatenate([y for _, y in links]))
    assert [set(np.flatnonzero(found == x)) for x in found] == [set(np.flatnonzero(expected == x)) for x in expected]
    assert not list(tmp_path.iterdir())


def test_more_labels_in_the_shuffle_change_nothing(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"v{i}" for i in range(200)]
    rows = []
    for i in range(300):
        copy = list(base)
        for _ in range(rng.randrange(0, 40)):
            copy[rng.randrange(200)] = f"x{rng.randrange(900)}"
        rows.append((i, " ".join(copy), "en", "s"))
    d, found = docs(spark, rows), []
    original = near_dedup.large_prefixes
    monkeypatch.setattr(near_dedup, "large_prefixes", lambda *a: found.append(original(*a)) or found[-1])
    usual = {r["doc_id"]: r["group_id"] for r in near_dedup.near_duplicates(d).collect()}
    assert len(found[0]) > 3
    monkeypatch.setattr(near_dedup, "large_prefixes", lambda *a: np.zeros(0, np.uint64))
    assert usual == {r["doc_id"]: r["group_id"] for r in near_dedup.near_duplicates(d).collect()}


def test_rows_are_dropped_where_they_lie(spark, sf_dir, tmp_path, monkeypatch):
    from graphloom.llm import _cluster

    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    again = d.limit(3)
    d.unionByName(again).repartition(5).write.parquet(str(tmp_path / "docs"))
    d = spark.read.parquet(str(tmp_path / "docs"))
    for drop in (exact_dedup.drop_exact_duplicates, near_dedup.drop_near_duplicates):
        usual = sorted(r["doc_id"] for r in drop(d).collect())
        monkeypatch.setattr(_cluster, "BROADCAST_BYTES", 1)
        left = drop(d)
        assert sorted(r["doc_id"] for r in left.collect()) == usual and len(set(usual)) == len(usual)
        one = drop(spark.read.parquet(f"{sf_dir}/documents.parquet"))
        assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
        monkeypatch.undo()
