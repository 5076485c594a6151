import corpus_pipeline
from graphloom.llm import queries


def test_stages_on_awkward_rows(spark, sf_dir, tmp_path):
    from .helpers import docs

    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = docs(spark, [(-1, None, None, None), (-2, "", "en", "src0"), (-3, "?!", "en", "src0")])
    data = table.union(odd)
    ids = {r["doc_id"] for r in table.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, data, sf_dir)
        last = k + 1 == len(corpus_pipeline.STAGES)
        assert last or out.columns == table.columns
        out.write.parquet(str(tmp_path / str(k)))
        before, data = data, spark.read.parquet(str(tmp_path / str(k)))
        kept = {r["doc_id"] for r in data.select("doc_id").collect()}
        if name == "language ID":
            assert kept == ids
        if name.startswith("mixing"):
            assert kept == {r["doc_id"] for r in before.select("doc_id").collect()}
    assert {"n_tokens", "tokens"} <= set(data.columns) and data.where("tokens IS NULL").count() == 0


def test_stages_on_an_empty_table(spark, sf_dir):
    data = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, data, sf_dir).count() == 0


def test_run_and_names(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_every_stage_meets_every_awkward_row(spark, sf_dir, tmp_path):
    from .helpers import docs, words

    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = table.where("lang = 'en' AND n_chars BETWEEN 300 AND 3000").orderBy("doc_id").first()["text"]
    long = " ".join(good.split() * (60_000 // len(good.split())))
    rows = [
        (1, None, None, None), (2, "", "en", "s"), (3, "?! 12", "en", "s"), (4, good, "en", "s"), (4, good, "en", "s"), (5, good, None, None), (None, good + " tail", "en", "t"),
        (6, long, "en", "t"), (7, "der die das", "de", None), (8, words(30), "en", "s"), (8, words(30, 500), "en", "s"),
    ]
    d = docs(spark, rows, clash=True).selectExpr("*", "'x' AS pii_entities", "1 AS file", "2 AS value", "3 AS row", "4 AS _flag")
    labelled = table.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        given = d
        if name == "language ID":  # machines are fitted on the table's own labels
            given = d.unionByName(labelled, allowMissingColumns=True)
        out = stage(spark, given, sf_dir)
        got = out.collect()
        kept = [r["doc_id"] for r in got if r["th"] == "1"]
        if not name.startswith("token"):
            assert out.columns == d.columns
        if name == "language ID":
            assert sorted(map(str, kept)) == sorted(map(str, [4, 4, 5, None, 6, 7, 8, 8])) and all(r["lang"] for r in got)
        elif name.startswith("MinHash"):
            assert sorted(map(str, kept)) == sorted(map(str, [1, 2, 3, 4, 7, 8, 8]))
        elif name.startswith("benchmark"):
            assert sorted(map(str, kept)) == sorted(str(r[0]) for r in rows) and {r["text"] for r in got} == {r[1] for r in rows}
        elif name.startswith("mixing"):
            assert {str(r[0]) for r in rows} == set(map(str, kept)) and len(kept) >= len(rows)
        else:
            assert len(got) == len(rows) and {r["_n_tokens"] for r in got if r["doc_id"] in (1, 2)} == {0}
            assert [r["_tokens"] for r in got if r["doc_id"] == 1] == [None]
        assert stage(spark, d.limit(0), sf_dir).count() == 0


def test_runs_rows_against_the_stages_by_brute_force(spark, sf_dir):
    """The whole run, stage by stage in plain Python where that has an exact definition."""
    from collections import Counter

    from graphloom.llm import decontamination, language, mixing, near_dedup

    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.train(table)
    rows = {r["doc_id"]: r for r in table.collect()}
    ids = sorted(rows)
    accepted = [i for i, ok in zip(ids, model.classify([rows[i]["text"] for i in ids])[3]) if ok]
    # near copies: all pairs of signatures that meet in some tree, by the sketches' share
    sig, some = near_dedup.signature_matrix([rows[i]["text"] for i in accepted])
    root = list(range(len(accepted)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(accepted)):
        for b in range(a):
            meets = any((sig[a, t * 8 : t * 8 + 3] == sig[b, t * 8 : t * 8 + 3]).all() for t in range(near_dedup.TREES))
            if some[a] and some[b] and meets and ((sig[a] & 15) != (sig[b] & 15)).sum() <= near_dedup.most_mismatches(near_dedup.THRESHOLD):
                root[max(find(a), find(b))] = min(find(a), find(b))
    unique = [i for k, i in enumerate(accepted) if find(k) == k]
    clean = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(table.where(table["doc_id"].isin(unique)), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    counts = Counter(rows[i]["source"] for i in clean)
    power = {s: n**mixing.TEMPERATURE for s, n in counts.items()}
    total = max(n * sum(power.values()) / power[s] for s, n in counts.items())
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in got} == set(clean)
    copies = Counter(r["doc_id"] for r in got)
    for s, n in counts.items():
        rate = total * power[s] / sum(power.values()) / n
        own = [copies[i] for i in clean if rows[i]["source"] == s]
        assert abs(sum(own) - rate * n) < 1 + 1e-6 and all(int(rate - 1e-9) <= c <= rate + 1 for c in own)
    from graphloom.llm import tokens

    with open(tokens.TOKENIZER, "rb") as f:
        own = tokens.encoding(f.read())
    assert all(own.decode(r["tokens"]) == clean[r["doc_id"]] for r in got)
