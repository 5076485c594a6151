import math
import random
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import _text, language, mixing

from .helpers import docs, words


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_held_out_accuracy(spark, table):
    train, held = table.where("doc_id % 2 = 0"), table.where("doc_id % 2 = 1")
    model = language.train(train, 60)
    rows = language.identify(held, model).collect()
    assert sum(r["lang"] == r["language"] for r in rows) >= 0.97 * len(rows)
    assert all(r["accepted"] for r in rows)
    assert {r["family"] for r in rows} == {"germanic", "romance"}


def test_rejects_and_awkward_rows(spark, table):
    model = language.train(table, 40)
    good = table.where("lang = 'de' AND n_chars > 200").first()["text"]
    rows = [(1, None, "en", "s"), (2, "", "en", "s"), (3, "123 ### 456", "en", "s"), (4, "это русский текст без перевода", "en", "s"), (5, good, None, "s"), (6, good, None, "s"), (7, good * 300, "de", "s"), (None, good, "de", None)]
    d = docs(spark, rows, clash=True)
    got = {r["doc_id"]: r for r in language.identify(d, model).collect()}
    assert [got[i]["language"] for i in (1, 2, 3, 4)] == ["und"] * 4 and not any(got[i]["accepted"] for i in (1, 2, 3, 4))
    assert got[5]["language"] == got[6]["language"] == got[7]["language"] == got[None]["language"] == "de" and got[5]["margin"] == got[6]["margin"]
    kept = language.accept_known(d, model)
    assert kept.columns == d.columns and {r["doc_id"]: r["lang"] for r in kept.collect()} == {5: "de", 6: "de", 7: "de", None: "de"}
    assert language.identify(d.limit(0), model).count() == 0


def _mixed(h):
    h ^= h >> 15
    h = h * 0x2C1B3C6D & 0xFFFFFFFF
    return h ^ h >> 13


def _brute_language(text, model):
    """The same decision, a character and a machine at a time."""
    low = _text.fold(text)
    kept, gap = [], False
    for c in low + "\n":
        if c.isalpha():
            kept.append(ord(c))
            gap = True
        elif gap:
            kept.append(32)
            gap = False
    score, seen, total = list(model.bias), 0, 0
    h1 = [(c + 0x9E37) * 0x85EBCA6B & 0xFFFFFFFF for c in kept]
    rows = {1: h1}
    for n in (2, 3):
        rows[n] = [(rows[n - 1][i] * 0x01000193 & 0xFFFFFFFF) ^ ((kept[i + n - 1] + n) * 0xC2B2AE35 & 0xFFFFFFFF) for i in range(len(kept) - n + 1)]
    for n, hashes in rows.items():
        for h in map(_mixed, hashes):
            for j, w in enumerate(model.weights[(h >> 32 - language.BITS) + ((n - 1) << language.BITS)].tolist()):
                score[j] += w / len(hashes)
            if n == 3:
                seen, total = seen + bool(model.seen[h >> 32 - language.SEEN_BITS]), total + 1
    if not any(c.isalpha() for c in low) or (total and seen / total < language.LEAST_SEEN):
        return "und"
    family = max(range(len(model.families)), key=lambda f: score[f])
    votes = {i: 0.0 for i, f in enumerate(model.family_of) if f == family}
    for j, (a, b) in enumerate(model.pairs):
        m = score[len(model.families) + j]
        if a in votes:
            votes[a] += (m > 0) + 1e-3 * math.tanh(m)
            votes[b] += (m <= 0) - 1e-3 * math.tanh(m)
    return model.languages[max(votes, key=lambda i: (votes[i], -i))]


def test_decisions_against_brute_force(spark, table):
    model = language.train(table, 40)
    rows = [r["text"] for r in table.orderBy("n_chars").limit(150).collect()] + ["Zwölf Boxkämpfer, 12!", "a", "?", "", "Ünïcödé tèxt ... 3", "это русский"]
    got = model.classify(rows)[0]
    assert got == [_brute_language(t, model) for t in rows]


def test_rows_of_a_sparse_matrix():
    rng = np.random.default_rng(1)
    dense = rng.random((9, 7)) * (rng.random((9, 7)) < 0.4)
    dense[[2, 8]] = 0
    of, ids = np.nonzero(dense)
    x = language.Rows(ids, dense[of, ids], np.searchsorted(of, np.arange(10)), 7)
    w, g, some = rng.random(7), rng.random(9), np.array([8, 0, 2, 5])
    assert np.allclose(x.times(w), dense @ w) and np.allclose(x.transposed_times(g), dense.T @ g)
    assert np.allclose(x.of(some).times(w), dense[some] @ w)


def test_models_of_no_and_one_language(spark, table):
    assert not any(r["accepted"] for r in language.identify(table.limit(3), language.train(table.limit(0))).collect())
    only = language.train(table.where("lang = 'en'"), 20)
    assert {r["language"] for r in language.identify(table.where("lang = 'en' AND n_chars > 100"), only).collect()} == {"en"}


def test_pivot_keeps_expectations():
    rng = random.Random(3)
    p = [rng.random() for _ in range(9)]
    hits = Counter()
    for _ in range(20_000):
        bits, held, left = mixing.pivot(p, [rng.random() for _ in p])
        if held >= 0:
            bits[held] = int(rng.random() < left)
        assert abs(sum(bits) - sum(p)) < 1
        hits.update(i for i, b in enumerate(bits) if b)
    assert all(abs(hits[i] / 20_000 - q) < 0.02 for i, q in enumerate(p))


@pytest.mark.parametrize("bucket_rows,fan", [(1000, 32), (7, 2)])
def test_sources_meet_their_targets(spark, bucket_rows, fan):
    rows = [(i, f"t {i}", "en", "abc"[(i > 60) + (i > 90)]) for i in range(100)]
    weights = {"a": 0.2, "b": 0.3, "c": 0.5}
    got = mixing.mixture(docs(spark, rows), weights, 77.0, bucket_rows=bucket_rows, fan=fan).collect()
    assert len(got) == 100
    for s, w in weights.items():
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["copies"] for r in own) - 77 * w) < 1
        assert {r["copies"] for r in own} <= {int(own[0]["rate"]), int(own[0]["rate"]) + 1}
    again = mixing.mixture(docs(spark, rows), weights, 77.0, bucket_rows=bucket_rows, fan=fan).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_default_loses_no_row_and_awkward_rows(spark):
    rows = [(i, words(5, i), "en", "hot") for i in range(40)] + [(50 + i, words(3, i), "en", None) for i in range(5)] + [(60, None, "en", "x"), (61, "", None, "x"), (60, None, "en", "x"), (None, "n", "en", "x"), (62, words(30_000), "en", "x")]
    d = docs(spark, rows, clash=True)
    out = mixing.resample(d)
    assert out.columns == d.columns
    got, want = Counter(r["doc_id"] for r in out.collect()), Counter(r[0] for r in rows)
    assert all(got[i] >= n for i, n in want.items()) and all(got[i] == 1 for i in range(40))
    total = {r["source"]: r["c"] for r in mixing.mixture(d).groupBy("source").agg({"copies": "sum"}).withColumnRenamed("sum(copies)", "c").collect()}
    assert sum(total.values()) == sum(got.values())
    assert mixing.resample(d.limit(0)).count() == 0 and mixing.mixture(d.limit(0)).count() == 0


def test_a_row_that_is_a_third_of_all_is_written_in_runs(spark, monkeypatch):
    d = docs(spark, [(i, words(5, i), "en", "hot") for i in range(20)] + [(7, "again", "en", "hot")] * 11 + [(None, None, "en", None)] * 2)
    usual = Counter(r["doc_id"] for r in mixing.resample(d).collect()), sorted(map(repr, mixing.mixture(d).collect()))
    monkeypatch.setattr(mixing, "RUN", 3)
    assert (Counter(r["doc_id"] for r in mixing.resample(d).collect()), sorted(map(repr, mixing.mixture(d).collect()))) == usual
    counts = spark.createDataFrame([(0, 0), (1, 1), (2, 3), (3, 4), (4, 10)], "doc_id long, c long")
    got = mixing._numbered(counts, "c", "n", "doc_id").select("doc_id", "n").collect()
    assert sorted(map(tuple, got)) == [(i, n) for i, c in ((1, 1), (2, 3), (3, 4), (4, 10)) for n in range(1, c + 1)]


def test_a_source_without_weight_goes(spark):
    d = docs(spark, [(1, "a", "en", "x"), (2, "b", "en", "y")])
    assert [r["doc_id"] for r in mixing.resample(d, {"x": 1.0, "absent": 5.0}, 2.0).collect()] == [1, 1]


def _brute(rows, weights, total, buckets, fan, seed=mixing.SEED):
    """Copies by the same rule, one row at a time, with the engine's hashes (doc_id, th, n) -> (u of each level, bucket)."""
    out, open_ = {}, {}
    counts = Counter(r["source"] for r in rows)
    norm = sum(weights.get(s, 0) for s in counts)
    for r in rows:
        rate = total * weights.get(r["source"], 0) / norm / counts[r["source"]]
        r["rate"] = round(rate) if abs(rate - round(rate)) < 1e-9 else rate
        out[r["key"]] = int(r["rate"])
        open_[r["key"]] = r["rate"] - int(r["rate"])
    level = 0
    of = {r["key"]: r for r in rows}
    node = {k: r["node"] for k, r in of.items()}
    while True:
        for b, s in sorted({(node[k], of[k]["s"]) for k in open_}):
            own = sorted(k for k in open_ if node[k] == b and of[k]["s"] == s)
            bits, held, left = mixing.pivot([open_[k] for k in own], [of[k]["u"][level] for k in own])
            for i, k in enumerate(own):
                out[k] += bits[i]
                if i == held:
                    open_[k] = left
                else:
                    del open_[k]
        if buckets == 1:
            break
        buckets, level = -(-buckets // fan), level + 1
        node = {k: node[k] // fan for k in open_}
    for k, p in open_.items():
        out[k] += of[k]["last"] < p
    return out


def test_mixing_against_brute_force(spark, monkeypatch):
    from pyspark.sql import functions as F

    d = docs(spark, [(i, f"t {i}", "en", "abc"[(i > 60) + (i > 90)]) for i in range(100)])
    weights, total, buckets, fan, seed = {"a": 0.2, "b": 0.3, "c": 0.5}, 77.0, 10, 3, mixing.SEED
    own = [F.col("doc_id"), F.xxhash64("text"), F.lit(1).cast("long")]
    u = [mixing._uniform(F.lit(seed), *own), *(mixing._uniform(F.lit(seed + 100 + k), *own) for k in (1, 2, 3))]
    rows = d.select("doc_id", "source", F.xxhash64("source").alias("s"), F.xxhash64("text").alias("th"), F.array(*u).alias("u"), mixing._uniform(F.lit(seed + 99), *own).alias("last"), F.pmod(F.xxhash64(F.lit(seed + 1), *own), F.lit(buckets)).alias("node"))
    table = [{**r.asDict(), "key": (r["doc_id"], r["th"])} for r in rows.collect()]
    want = {k[0]: n for k, n in _brute(table, weights, total, buckets, fan).items()}
    assert {r["doc_id"]: r["copies"] for r in mixing.mixture(d, weights, total, bucket_rows=10, fan=3).collect()} == want
    assert Counter(r["doc_id"] for r in mixing.resample(d, weights, total, bucket_rows=10, fan=3).collect()) == Counter(want)


def test_draws_do_not_depend_on_files(spark, table, tmp_path):
    rows, got = table.unionByName(table.where("doc_id < 4")), []
    for parts in (1, 3):
        rows.repartition(parts).write.parquet(str(tmp_path / str(parts)))
        d = spark.read.parquet(str(tmp_path / str(parts)))
        # rates may differ in their last bit, as sums of doubles do
        got.append((Counter(r["doc_id"] for r in mixing.resample(d, total=2500.0).collect()), sorted((r["doc_id"], r["source"], r["copies"]) for r in mixing.mixture(d, total=2500.0).collect())))
    assert got[0] == got[1]


def test_resample_in_place_and_with_many_sources(spark, table, tmp_path, monkeypatch):
    from graphloom.llm import _cluster

    table.unionByName(table.limit(4)).repartition(3).write.parquet(str(tmp_path / "docs"))
    d = spark.read.parquet(str(tmp_path / "docs"))
    usual = Counter(r["doc_id"] for r in mixing.resample(d, total=2500.0).collect())
    assert sum(usual.values()) in range(2490, 2511)
    for module, bound in ((_cluster, 1), (mixing, 1)):
        monkeypatch.setattr(module, "BROADCAST_BYTES", bound)
        assert Counter(r["doc_id"] for r in mixing.resample(d, total=2500.0).collect()) == usual
    table.write.parquet(str(tmp_path / "once"))
    assert "Exchange" not in mixing.resample(spark.read.parquet(str(tmp_path / "once")), total=2500.0)._jdf.queryExecution().executedPlan().toString()
