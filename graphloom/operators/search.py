"""Vector and full-text search."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DimensionMismatch
from ..functions.text import search_tokens
from ..functions.vectors import METRICS
from ..model import Graph
from ..runtime import cut, new_path, portioned, rewritten, sized
from .aggregates import text_statistics

K1, B = 1.2, 0.75
#: Rows that an index's centres are fitted on, at most.
INDEX_SAMPLE = 100_000
_BLOCK_BYTES = 16 << 20  # of queries, or of rows, that meet at once in a worker
_STEP = 2048
_CELLS = 1 << 18  # distances of queries and rows at once
_QUERY_TERMS = 5_000_000  # of all queries, that a task may hold
_PLAN_TERMS = 1_000  # of all queries, that a plan may hold


def check_dimensions(embeddings: DataFrame, dimensions: int) -> None:
    if not embeddings.where(F.size("vec") != dimensions).isEmpty():
        raise DimensionMismatch(f"vectors must have {dimensions} dimensions")


def _query_files(queries: DataFrame, by: Column, width: int, rows: int) -> tuple[str, int]:
    """(folder of queries (query_id, vec) written by block, number of blocks), each block of about _BLOCK_BYTES."""
    blocks = max(1, -(-rows * (4 * width + 8) // _BLOCK_BYTES))
    path = new_path(queries.sparkSession, "queries")
    queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vec").cast("array<float>").alias("vec"), F.pmod(by, F.lit(blocks)).alias("block")).repartition("block").write.partitionBy("block").parquet(path)
    return path, blocks


def _matrix(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))


def _read_block(folder: str, key: str, value: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(ids, matrix) of a block of queries in the shared folder."""
    where, root = fs.FileSystem.from_uri(folder)
    at = f"{root}/{key}={value}"
    if where.get_file_info(at).type == fs.FileType.NotFound:
        return None
    t = ds.dataset(at, filesystem=where, format="parquet").to_table(columns=["query_id", "vec"])
    return (t["query_id"].to_numpy(), _matrix(t["vec"])) if t.num_rows else None


def _distance(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    product = q @ x.T
    if metric == "ip":
        return 1 - product
    if metric == "cosine":
        length = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
        return np.where(length > 0, 1 - product / np.where(length > 0, length, 1), 1.0)
    return np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * product, 0)


def _top(ids: np.ndarray, q: np.ndarray, node: np.ndarray, x: np.ndarray, k: int, metric: str) -> Iterator[pa.RecordBatch]:
    """The k nearest rows of x to each of q; _CELLS distances are held at a time."""
    some = max(1, _CELLS // _STEP)
    for i in range(0, len(q), some):
        few = q[i : i + some]
        best, of = np.zeros((len(few), 0)), np.zeros((len(few), 0), np.int64)
        for at in range(0, len(node), _STEP):
            d = _distance(few, x[at : at + _STEP], metric)
            best, of = np.concatenate((best, d), 1), np.concatenate((of, np.broadcast_to(node[at : at + _STEP], d.shape)), 1)
            order = np.lexsort((of, best), axis=1)[:, :k]
            best, of = np.take_along_axis(best, order, 1), np.take_along_axis(of, order, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[i : i + some], best.shape[1])), pa.array(of.ravel()), pa.array(best.ravel())], ["query_id", "node_id", "distance"])


def _pairwise(metrics: tuple[str, ...], ids: np.ndarray, q: np.ndarray, node: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each of q and x, _CELLS at a time, with the distance by each metric."""
    some = max(1, _CELLS // _STEP)
    for i in range(0, len(q), some):
        for at in range(0, len(node), _STEP):
            of = node[at : at + _STEP]
            d = [_distance(q[i : i + some], x[at : at + _STEP], m).ravel() for m in metrics]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[i : i + some], len(of))), pa.array(np.tile(of, len(q[i : i + some]))), *map(pa.array, d)], ["query_id", "node_id", *metrics])


def _against_all(embeddings: DataFrame, queries: DataFrame, metrics: tuple[str, ...], step: Callable[..., Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Blocks of queries lie as files in the shared folder; each task reads them one after the other, a run of its rows at a time."""
    for metric in metrics:
        if metric not in ("cosine", "l2", "ip"):
            raise ValueError(f"no metric {metric}")
    rows, width = queries.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(1))).first()
    folder, blocks = _query_files(queries, F.xxhash64("query_id"), width, rows)

    def meet(node: list[np.ndarray], x: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        nodes, rows = np.concatenate(node), np.concatenate(x)
        for b in range(blocks):
            if found := _read_block(folder, "block", b):
                yield from step(*found, nodes, rows)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, x, size = [], [], 0
        for batch in batches:
            if batch.num_rows:
                node.append(batch.column(0).to_numpy(zero_copy_only=False))
                x.append(_matrix(batch.column(1)))
                size += x[-1].nbytes
            if size > _BLOCK_BYTES:
                yield from meet(node, x)
                node, x, size = [], [], 0
        if node:
            yield from meet(node, x)

    return embeddings.where("vec IS NOT NULL").select("node_id", "vec").mapInArrow(make, schema)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "node_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(embeddings: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine") -> DataFrame:
    """(query_id, node_id, distance, rank): the k nearest of embeddings (node_id, vec) to each of queries (query_id, vec), exactly.

    A row carries its own vector only; each task keeps k a query before anything is shuffled.
    """
    return _ranked(_against_all(embeddings, queries, (metric,), lambda *found: _top(*found, k, metric), "query_id long, node_id long, distance double"), k)


def distances(embeddings: DataFrame, queries: DataFrame, metric: str = "cosine") -> DataFrame:
    """(query_id, node_id, distance) of every query with every row."""
    return all_distances(embeddings, queries, (metric,)).withColumnRenamed(metric, "distance")


def all_distances(embeddings: DataFrame, queries: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """(query_id, node_id, a distance a metric) of every query with every row, from one pass."""
    return _against_all(embeddings, queries, metrics, lambda *found: _pairwise(metrics, *found), "query_id long, node_id long, " + ", ".join(f"{m} double" for m in metrics))


@dataclass(frozen=True)
class VectorIndex:
    """An inverted file: every row (list, node_id, vec), and the lists' centres; lists too large for a task are in several parts.

    probes: how many lists a search looks into, as the rows of the fit needed for the recall that was asked for.
    """

    rows: DataFrame
    centres: np.ndarray
    metric: str
    probes: int

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
        """(query_id, node_id, distance, rank) among the rows of the lists nearest to each query."""
        centres, metric, n = self.centres, self.metric, len(self.centres)
        if not n:
            return nearest(self.rows.select("node_id", "vec"), queries, k, metric)
        probes = min(n, self.probes if probes is None else probes)

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(1))
                near = np.argsort(_distance(x, centres, metric), axis=1, kind="stable")[:, :probes] if len(x) else np.zeros((0, probes), np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), probes))), batch.column(1).take(pa.array(np.repeat(np.arange(len(x)), probes))), pa.array(near.ravel().astype(np.int64))], ["query_id", "vec", "list"])

        path = new_path(queries.sparkSession, "probes")
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vec").cast("array<float>").alias("vec")).mapInArrow(choose, "query_id long, vec array<float>, list long")
        asked.repartition("list").write.partitionBy("list").parquet(path)

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held = None, None
            for batch in batches:
                of = batch.column(0).to_numpy(zero_copy_only=False)
                for one in np.unique(of):
                    if one != at:
                        at, held = one, _read_block(path, "list", int(one))
                    if held:
                        mine = np.flatnonzero(of == one)
                        yield from _top(*held, batch.column(1).to_numpy(zero_copy_only=False)[mine], _matrix(batch.column(2).take(pa.array(mine))), k, metric)

        return _ranked(self.rows.mapInArrow(make, "query_id long, node_id long, distance double"), k)


def vector_index(embeddings: DataFrame, lists: int | None = None, metric: str = "cosine", sample: int = INDEX_SAMPLE, rounds: int = 8, recall: float = 0.95) -> VectorIndex:
    """An index of every row of embeddings (node_id, vec): k-means centres are fitted on at most `sample` rows, drawn by a hash of their ids.

    Without `lists` there are about the root of the number of rows, at most 4,096.  How many of them a search must look
    into for the recall that is asked for is measured on the sample: by the lists of the ten nearest of some of its rows.
    """
    some = embeddings.where("vec IS NOT NULL").select("node_id", F.col("vec").cast("array<float>").alias("vec"))
    n = some.count()
    drawn = some.where(F.pmod(F.xxhash64(F.lit(5), "node_id"), F.lit(1 << 30)) < F.lit(int(min(1.0, 1.1 * sample / max(1, n)) * (1 << 30)))).orderBy(F.xxhash64(F.lit(5), "node_id"), "node_id").limit(sample).toArrow()
    x = _matrix(drawn["vec"])
    lists = min(len(x), lists or max(1, min(4096, round(n**0.5))))
    centres = x[:lists].copy()
    for _ in range(rounds if lists else 0):
        near = np.concatenate([np.argmin(_distance(x[i : i + _STEP], centres, metric), axis=1) for i in range(0, len(x), _STEP)])
        total, size = np.zeros_like(centres), np.bincount(near, minlength=lists)
        np.add.at(total, near, x)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)

    probes = max(1, lists)
    if len(x) > 1:
        some_of = x[:: -(-len(x) // 256)]
        near10 = np.concatenate([np.argsort(_distance(some_of[i : i + 32], x, metric), axis=1, kind="stable")[:, 1:11] for i in range(0, len(some_of), 32)])
        of = np.concatenate([np.argmin(_distance(x[i : i + _STEP], centres, metric), axis=1) for i in range(0, len(x), _STEP)])
        place = np.argsort(np.argsort(_distance(some_of, centres, metric), axis=1, kind="stable"), axis=1)  # of each list, from the nearest on
        probes = int(np.quantile(np.take_along_axis(place, of[near10], 1), recall, method="higher")) + 1

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _matrix(batch.column(1))
            near = np.argmin(_distance(own, centres, metric), axis=1) if len(own) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int64)), *batch.columns], ["list", "node_id", "vec"])

    path = new_path(embeddings.sparkSession, "vector-index")
    # a salt splits a list that holds a large share of the rows; files stay sorted by list
    placed = some.mapInArrow(assign, "list long, node_id long, vec array<float>") if lists else some.select(F.lit(0).cast("long").alias("list"), "node_id", "vec")
    placed.repartition("list", F.pmod(F.xxhash64("node_id"), F.lit(max(1, n // 10_000_000)))).sortWithinPartitions("list").write.parquet(path)
    return VectorIndex(embeddings.sparkSession.read.parquet(path), centres, metric, probes)


def quantized(embeddings: DataFrame) -> DataFrame:
    """(node_id, code, scale): vectors as signed bytes, a quarter of their size; value = code * scale."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            scale = np.abs(x).max(1, initial=0) / 127
            code = np.rint(x / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
            offsets = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1] if len(x) else np.zeros(1, np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(code.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), packed, pa.array(scale)], ["node_id", "code", "scale"])

    return embeddings.where("vec IS NOT NULL").select("node_id", F.col("vec").cast("array<float>").alias("vec")).mapInArrow(make, "node_id long, code binary, scale double")


def restored(codes: DataFrame) -> DataFrame:
    """(node_id, vec) of quantized vectors, within half a step of what they were."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(np.frombuffer(c, np.int8) * s).astype(np.float32) for c, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float32()))], ["node_id", "vec"])

    return codes.mapInArrow(make, "node_id long, vec array<float>")


def nearest_quantized(codes: DataFrame, embeddings: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", oversample: int = 4) -> DataFrame:
    """(query_id, node_id, distance, rank): the best of oversample * k by quantized vectors, ranked by the exact ones."""
    found = nearest(restored(codes), queries, oversample * k, metric).select("query_id", "node_id")
    exact = found.join(embeddings.select("node_id", "vec"), "node_id").join(queries.select("query_id", F.col("vec").alias("q")), "query_id")
    distance = METRICS[metric](F.col("q"), F.col("vec"))
    return _ranked(exact.select("query_id", "node_id", distance.alias("distance")), k)


def nearest_where(graph: Graph, queries: DataFrame, k: int = 10, labels: list[str] | None = None, properties: dict[str, str] | None = None, metric: str = "cosine", oversample: int | None = None) -> DataFrame:
    """k-NN among nodes of some labels and properties: filtered first, or, with oversample, after fetching oversample * k."""
    keep = graph.nodes
    if labels:
        keep = keep.where(F.col("label").isin(*labels))
    for key, value in (properties or {}).items():
        keep = keep.where(F.col("props")[key] == value)
    ids = keep.select("node_id")
    if oversample is None:
        return nearest(graph.embeddings.join(ids, "node_id", "left_semi"), queries, k, metric)
    found = nearest(graph.embeddings, queries, oversample * k, metric).join(ids, "node_id", "left_semi")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "node_id"))
    return found.select("query_id", "node_id", "distance", rank.alias("rank")).where(F.col("rank") <= k)


def bm25(postings: DataFrame, corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, node_id, score) for every match of queries (query_id, text): distinct query terms, k1 1.2, b 0.75."""
    terms = queries.select("query_id", F.explode(F.array_distinct(search_tokens("text"))).alias("term"))
    wanted = postings.join(terms.select("term").distinct(), "term", "left_semi")
    df = wanted.groupBy("term").agg(F.count("*").alias("df"))
    n, avgdl = F.col("n"), F.col("avgdl")
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / avgdl))
    weighed = wanted.join(df, "term").crossJoin(F.broadcast(corpus)).select("term", "node_id", part.alias("part"))
    return weighed.join(terms, "term").groupBy("query_id", "node_id").agg(F.sum("part").alias("score"))


def query_terms(queries: DataFrame) -> DataFrame:
    """The distinct terms (term) of queries (query_id, text)."""
    return cut(queries.select(F.explode(search_tokens("text")).alias("term")).distinct())


def bm25_over(docs: DataFrame, queries: DataFrame, key: str = "node_id", text: str = "text") -> DataFrame:
    """bm25 over documents, of which only the queries' terms are looked at.

    Their texts are read once; where queries have more than _PLAN_TERMS terms, once for postings and once for their lengths.
    """
    terms = query_terms(queries)
    if terms.count() > _PLAN_TERMS:
        postings, corpus = text_statistics(docs, key, text, terms)
        return bm25(cut(postings), cut(corpus), queries)
    wanted = [r["term"] for r in terms.collect()]
    words = docs.select(F.col(key).alias("node_id"), search_tokens(text).alias("w"))
    # a filter before the table would take the words apart once more
    held = rewritten(words.select("node_id", F.size("w").alias("dl"), F.filter("w", lambda w: w.isin(*wanted)).alias("own"))).where("dl > 0")
    corpus = held.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    postings = portioned(held.where(F.size("own") > 0), held.count(), "node_id").select("node_id", "dl", F.explode("own").alias("term")).groupBy("node_id", "term", "dl").agg(F.count("*").alias("tf"))
    return bm25(cut(postings), cut(corpus), queries)


def _blocks(found: pa.Table) -> list[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """Of terms (query_id, term, idf) in order of queries: (queries, their terms, idf, terms x queries), _CELLS of a matrix at a time or one query."""
    query, term, idf = found["query_id"].to_numpy(), found["term"].combine_chunks(), found["idf"].to_numpy()
    ends = np.append(np.flatnonzero(query[1:] != query[:-1]) + 1, len(query)) if len(query) else np.zeros(0, np.int64)
    out, i, low = [], 0, 0
    while i < len(ends):
        j = i + 1
        while j < len(ends) and (ends[j] - low) * (j + 1 - i) <= 16 * _CELLS:
            j += 1
        some = slice(low, int(ends[j - 1]))
        coded = term[some].dictionary_encode()
        code = coded.indices.to_numpy()
        own, of = np.unique(query[some], return_inverse=True)
        weight, holds = np.zeros(len(coded.dictionary)), np.zeros((len(coded.dictionary), len(own)))
        weight[code], holds[code, of] = idf[some], 1
        out.append((own, coded.dictionary, weight, holds))
        i, low = j, some.stop
    return out


def bm25_best(docs: DataFrame, queries: DataFrame, k: int, key: str = "node_id", text: str = "text") -> DataFrame:
    """(query_id, node_id, score, rank): the k best of bm25_over a query, by score to six places, then id.

    Tasks hold the queries' terms, score their documents against all queries and keep k a query; postings are not shuffled.
    Where ids are repeated or queries have more than _QUERY_TERMS terms, postings are joined.
    """
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "node_id"))
    terms = cut(queries.select("query_id", F.explode(F.array_distinct(search_tokens("text"))).alias("term")).distinct())
    twice = docs.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n")).where("n > 1 OR k IS NULL")
    if terms.count() > _QUERY_TERMS or not twice.isEmpty() or not terms.where("query_id IS NULL").isEmpty():
        return bm25_over(docs, queries, key, text).withColumn("rank", rank).where(F.col("rank") <= k)
    spark, least = docs.sparkSession, F.lit("")  # no term is empty: it stands for the document
    words = docs.select(F.col(key).cast("long").alias("node_id"), search_tokens(text).alias("w")).where(F.size("w") > 0)
    wanted = terms.select("term").distinct().unionAll(spark.range(1).select(least.alias("term")))
    each = words.select(F.size("w").alias("dl"), F.explode(F.concat(F.array(least), F.array_distinct("w"))).alias("term"))
    counted = cut(each.join(sized(wanted, terms.count() + 1, 100), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("dl")))
    whole = counted.where("term = ''").first()
    n, average = (whole["df"], whole["dl"] / whole["df"]) if whole else (0, 1.0)
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    path = new_path(spark, "terms")
    terms.join(counted, "term").select(F.col("query_id").cast("long").alias("query_id"), "term", idf.alias("idf")).write.parquet(path)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(path)
        blocks = _blocks(ds.dataset(root, filesystem=where, format="parquet").to_table(columns=["query_id", "term", "idf"]).sort_by([("query_id", "ascending"), ("term", "ascending")]))
        best = [(np.zeros((len(own), 0)), np.zeros((len(own), 0), np.int64)) for own, *_ in blocks]
        for batch in batches:
            node, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            dl = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            doc, flat = np.repeat(np.arange(len(node)), dl), lists.flatten()
            for at, (own, vocabulary, weight, holds) in enumerate(blocks):
                code = pc.fill_null(pc.index_in(flat, vocabulary), -1).to_numpy(zero_copy_only=False)
                hit = np.flatnonzero(code >= 0)
                pair, tf = np.unique(doc[hit] * len(weight) + code[hit], return_counts=True)
                of, code = pair // len(weight), pair % len(weight)
                part = weight[code] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[of] / average))
                step = max(1, 8 * _CELLS // max(1, len(weight)))
                for i in range(0, len(node), step):
                    low, high = np.searchsorted(of, (i, i + step))
                    cells = np.zeros((min(step, len(node) - i), len(weight)))
                    cells[of[low:high] - i, code[low:high]] = part[low:high]
                    x = (cells @ holds).T
                    score, met = best[at]
                    score, met = np.concatenate((score, x), 1), np.concatenate((met, np.broadcast_to(node[i : i + step], x.shape)), 1)
                    order = np.lexsort((met, -np.floor(score * 1e6 + 0.5)), axis=1)[:, :k]
                    best[at] = np.take_along_axis(score, order, 1), np.take_along_axis(met, order, 1)
        for (own, *_), (score, met) in zip(blocks, best):
            q, j = np.nonzero(score > 0)
            for i in range(0, len(q), 1 << 16):
                some = q[i : i + (1 << 16)], j[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(own[some[0]]), pa.array(met[some]), pa.array(score[some])], ["query_id", "node_id", "score"])

    return words.mapInArrow(make, "query_id long, node_id long, score double").withColumn("rank", rank).where(F.col("rank") <= k)


def search_text(docs: DataFrame, query: str, limit: int = 20, key: str = "node_id", text: str = "text") -> DataFrame:
    """(node_id, score) of the best documents for one query."""
    q = docs.sparkSession.createDataFrame([(0, query)], "query_id long, text string")
    return bm25_over(docs, q, key, text).select("node_id", "score").orderBy(F.desc("score"), "node_id").limit(limit)


def node_documents(graph: Graph) -> DataFrame:
    """(node_id, text): the visible string properties of each node, in order of their keys."""
    values = F.filter(F.array_sort(F.map_entries(F.map_filter(F.col("props"), lambda k, v: ~k.startswith("_") & v.isNotNull()))), lambda e: e["value"].isNotNull())
    return graph.nodes.select("node_id", F.array_join(F.transform(values, lambda e: e["value"]), " ").alias("text"))
