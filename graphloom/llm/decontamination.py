"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

The test items' word n-grams (lower case, letters and digits only) are hashed
into a sorted array and a bitmap.  Training texts are scanned window by window;
a window whose hash is in the set is verified word by word before it counts.
Matching windows are merged to spans.  A document that is mostly test material
goes; from any other only the spans are cut out.

A benchmark whose set may be broadcast is met in one scan.  Of a larger one only a
bitmap of its hashes is broadcast (of a fixed size); the windows that it lets
through, with their words, are joined to the table of its n-grams, and what was found
comes back to the documents in a second scan, whatever the benchmark's size.

Defined results: null, empty and too short texts are clean and pass unchanged, very
long texts are taken whole; items of fewer than ``n`` words count as one window of
their own length if they have at least ``min_words`` words, and are ignored otherwise;
an empty benchmark leaves everything unchanged, an empty table gives an empty result;
an n-gram of several items (ties) counts for each of them; repeated rows are judged row
by row; further columns pass through, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._cluster import BROADCAST_BYTES, attached, cut, file_key, fresh, text_key

N_GRAM = 8
MIN_WORDS = 5
DROP_SHARE = 0.5
_BITS = 22
_WIDE_BITS = 29  # of the bitmap for a benchmark that is too large to broadcast: 64 MB a size of n-gram
_GRAM_BYTES = 400  # of one n-gram with its words, on the driver and in a worker


class GramSet:
    """Hashes of benchmark n-grams by length, with the words behind each for verification."""

    def __init__(self, items: list[tuple[int, str]], n: int, min_words: int):
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.words: dict[int, dict[tuple[str, ...], list[int]]] = {}
        found: dict[int, dict[int, dict[tuple[str, ...], set[int]]]] = {}
        for item, text in items:
            w = T.split_words([text])
            low = T.fold(text)
            words = [low[a:b] for a, b in zip(w.start, w.end)]
            size = min(n, len(words))
            if size < min(n, min_words):
                continue
            hashes, at = w.windows(size)
            for h, i in zip(hashes.tolist(), at.tolist()):
                found.setdefault(size, {}).setdefault(h, {}).setdefault(tuple(words[i : i + size]), set()).add(item)
        for size, grams in found.items():
            keys = np.sort(np.fromiter(grams, np.uint64, len(grams)))
            bitmap = np.zeros(1 << _BITS, bool)
            bitmap[keys >> np.uint64(64 - _BITS)] = True
            self.by_length[size] = (keys, bitmap)
            self.words[size] = {h: {g: sorted(i) for g, i in x.items()} for h, x in grams.items()}

    def hits(self, texts: list[str]) -> Iterator[tuple[int, list[tuple[int, int, int]], set[int], T.Words]]:
        """(index of text, verified windows as (first word, words, item count), items, words) of texts with hits."""
        w = T.split_words(texts)
        found: dict[int, tuple[list, set]] = {}
        folded: dict[int, str] = {}
        for size, (keys, bitmap) in self.by_length.items():
            hashes, at = w.windows(size)
            maybe = np.flatnonzero(bitmap[hashes >> np.uint64(64 - _BITS)])
            if not len(maybe):
                continue
            sub = hashes[maybe]
            maybe = maybe[keys[np.minimum(np.searchsorted(keys, sub), len(keys) - 1)] == sub]
            for h, i in zip(hashes[maybe].tolist(), at[maybe].tolist()):
                d = int(w.doc[i])
                low = folded.get(d)
                if low is None:
                    low = folded[d] = T.fold(texts[d])
                items = self.words[size][h].get(tuple(low[w.start[j] : w.end[j]] for j in range(i, i + size)))
                if items:
                    windows, of = found.setdefault(d, ([], set()))
                    windows.append((i - int(w.first[d]), size))
                    of.update(items)
        for d in sorted(found):
            yield d, *found[d], w


def _covered(windows: list[tuple[int, int]], n_words: int) -> np.ndarray:
    edge = np.zeros(n_words + 1, np.int64)
    for at, size in windows:
        edge[at] += 1
        edge[at + size] -= 1
    return np.cumsum(edge[:-1]) > 0


def _cut_out(text: str, covered: np.ndarray, start: np.ndarray) -> str:
    """text without the covered words and what separates each from the next word."""
    ends = np.concatenate((start[1:], [len(text)]))
    parts, keep_from = [text[: start[0]]], None
    for i in np.flatnonzero(np.diff(np.concatenate(([True], covered, [True]))) != 0):
        if keep_from is None:
            keep_from = i
        else:
            parts.append(text[start[keep_from] : ends[i - 1]])
            keep_from = None
    return "".join(parts)


def _items(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> tuple[DataFrame, int]:
    """((item, text), bytes that their set of n-grams takes at most)."""
    items = benchmark.where(F.col(text).isNotNull()).select(F.coalesce(F.col(item).cast("long"), F.lit(-1)).alias("item"), F.col(text).alias("text"))
    words = items.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(r"[\p{L}\p{N}]+"))), F.lit(0))).first()[0]
    return items, words * _GRAM_BYTES


def _grams_of(items: DataFrame, n: int, min_words: int) -> DataFrame:
    """(size, gram, item): the n-grams of items, words joined by a space."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grams = GramSet([(item, text)], n, min_words).words
                out += [(size, h, " ".join(g), item) for size, by_hash in grams.items() for h, of in by_hash.items() for g in of]
            kinds = [pa.int64(), pa.uint64(), pa.string(), pa.int64()]
            size, h, gram, of = (pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 4, kinds))
            yield pa.RecordBatch.from_arrays([size, h.view(pa.int64()), gram, of], ["size", "hash", "gram", "item"])

    return items.mapInArrow(make, "size long, hash long, gram string, item long").distinct()


def _bitmap(grams: DataFrame) -> tuple[dict[int, np.ndarray], int]:
    """(bits of the hashes of each size of n-gram, number of hash bits), at most _WIDE_BITS of them whatever there is."""
    n = max(1, grams.count())
    bits = min(_WIDE_BITS, max(16, int(n).bit_length() + 5))
    found = grams.select("size", F.shiftrightunsigned("hash", 64 - bits).alias("at")).distinct()
    # bytes of the bitmap that aren't 0, so that what comes to the driver is bounded by its size
    rows = found.groupBy("size", (F.shiftright("at", 3)).alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, CAST(at % 8 AS INT))")).alias("set")).toArrow()
    out: dict[int, np.ndarray] = {}
    sizes, byte, value = (rows[c].to_numpy() for c in ("size", "byte", "set"))
    for size in np.unique(sizes):
        own = np.zeros((1 << bits) // 8, np.uint8)
        own[byte[sizes == size]] = value[sizes == size]
        out[int(size)] = own
    return out, bits


def _windows_let_through(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps, bits = shared.value
        for batch in batches:
            out: list[tuple] = []
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            for at, run in T.chunks(batch.column(3).to_pylist()):
                w, folded = T.split_words(run), {}
                for size, own in maps.items():
                    hashes, first = w.windows(size)
                    place = hashes >> np.uint64(64 - bits)
                    for i in first[(own[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0].tolist():
                        d = int(w.doc[i])
                        low = folded.get(d) or folded.setdefault(d, T.fold(run[d]))
                        out.append((*keys[at + d], i - int(w.first[d]), size, " ".join(low[w.start[j] : w.end[j]] for j in range(i, i + size))))
            kinds = [pa.int64()] * 5 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, kinds)], ["doc_id", "th", "file", "at", "size", "gram"])

    return scan


def _judged(docs: DataFrame, benchmark: DataFrame, n: int, min_words: int, make, schema) -> DataFrame:
    """make over batches of docs, with a function that finds the hits of a run of texts."""
    spark = docs.sparkSession
    items, size_of_set = _items(benchmark)
    if size_of_set <= BROADCAST_BYTES:
        shared = spark.sparkContext.broadcast(GramSet([tuple(r) for r in items.select("item", "text").collect()], n, min_words))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from make(batch, lambda at, run: shared.value.hits(run))

        return docs.mapInArrow(scan, schema)
    grams = cut(_grams_of(items, n, min_words))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("th"), file_key().alias("file"), "text")
    maybe = rows.mapInArrow(_windows_let_through(spark.sparkContext.broadcast(_bitmap(grams))), "doc_id long, th long, file long, at long, size long, gram string")
    hits = maybe.join(grams.select("size", "gram", "item"), ["size", "gram"])
    found = F.struct(F.collect_set(F.struct("at", "size")).alias("windows"), F.collect_set("item").alias("items"))
    side = cut(hits.groupBy("doc_id", "th", "file").agg(found.alias("value")))
    weight = side.agg(F.coalesce(F.sum(F.size("value.windows") * 24 + F.size("value.items") * 8 + 64), F.lit(0))).first()[0]
    joined = attached(docs, side, weight, fresh(docs, "_hits")[0])

    def scan_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            known = batch.column(last).to_pylist()
            plain = pa.RecordBatch.from_arrays(batch.columns[:last], names=batch.schema.names[:last])

            def find(at: int, run: list[str], known=known):
                hit = [d for d in range(len(run)) if known[at + d]]
                if hit:
                    w = T.split_words(run)
                    for d in hit:
                        yield d, sorted((x["at"], x["size"]) for x in known[at + d]["windows"]), set(known[at + d]["items"]), w

            yield from make(plain, find)

    return joined.mapInArrow(scan_joined, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = N_GRAM, min_words: int = MIN_WORDS, drop_share: float = DROP_SHARE) -> DataFrame:
    """A row for each contaminated document: its words, verified windows, words removed, action and text left.

    Columns doc_id, n_words, hit_windows, removed_words, item_ids (ascending, joined by commas),
    action ("span" or "document") and clean_text (empty if the document goes).
    """

    def make(batch: pa.RecordBatch, find) -> Iterator[pa.RecordBatch]:
        ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
        rows: list[tuple] = []
        for at, run in T.chunks(texts):
            for d, windows, items, w in find(at, run):
                lo, hi = w.first[d], w.first[d + 1]
                covered = _covered(windows, int(hi - lo))
                gone = bool(covered.mean() >= drop_share)
                left = "" if gone else _cut_out(run[d], covered, w.start[lo:hi])
                rows.append((ids[at + d].as_py(), int(hi - lo), len(windows), int(covered.sum()), ",".join(map(str, sorted(items))), "document" if gone else "span", left))
        names = ["doc_id", "n_words", "hit_windows", "removed_words", "item_ids", "action", "clean_text"]
        types = [pa.int64()] * 4 + [pa.string()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)], names)

    schema = "doc_id long, n_words long, hit_windows long, removed_words long, item_ids string, action string, clean_text string"
    return _judged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, n, min_words, make, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N_GRAM, min_words: int = MIN_WORDS, drop_share: float = DROP_SHARE) -> DataFrame:
    """docs, all columns, without contaminated documents and spans; clean rows are the same as before."""

    def make(batch: pa.RecordBatch, find) -> Iterator[pa.RecordBatch]:
        where = batch.schema.get_field_index("text")
        texts = batch.column(where).to_pylist()
        keep, changed = np.ones(len(texts), bool), False
        for at, run in T.chunks(texts):
            for d, windows, _, w in find(at, run):
                lo, hi = w.first[d], w.first[d + 1]
                covered = _covered(windows, int(hi - lo))
                if covered.mean() >= drop_share:
                    keep[at + d] = False
                else:
                    texts[at + d], changed = _cut_out(run[d], covered, w.start[lo:hi]), True
        if changed:
            columns = list(batch.columns)
            columns[where] = pa.array(texts, batch.schema.field(where).type)
            batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
        yield batch if keep.all() else batch.filter(pa.array(keep))

    return _judged(docs, benchmark, n, min_words, make, docs.schema)


CONTAMINATION_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, lower(text) AS low FROM documents WHERE text IS NOT NULL),
     w AS (SELECT r, doc_id, text, regexp_extract_all(low, '[\\p{L}\\p{N}]+') AS ws FROM d),
     b AS (SELECT coalesce(item_id, -1) AS item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM benchmark WHERE text IS NOT NULL),
     bs AS (SELECT item_id, ws, least(8, len(ws)) AS n FROM b WHERE len(ws) >= 5),
     grams AS (SELECT DISTINCT item_id, n, ws[i:i + n - 1] AS g FROM (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM bs)),
     win AS (SELECT r, i, n, ws[i:i + n - 1] AS g
             FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM grams) WHERE len(ws) >= n)),
     hit AS (SELECT win.r, win.i, win.n, grams.item_id FROM win JOIN grams ON win.n = grams.n AND win.g = grams.g),
     items AS (SELECT r, count(DISTINCT (i, n)) AS hit_windows, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS item_ids FROM hit GROUP BY r),
     gone AS (SELECT r, list(DISTINCT p) AS ps FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
     x AS (SELECT w.doc_id, len(ws) AS n_words, hit_windows, len(ps) AS removed_words, item_ids, text, ps, len(ps) / len(ws) >= 0.5 AS all_gone,
                  regexp_extract_all(text, '[\\p{L}\\p{N}]+[^\\p{L}\\p{N}]*') AS units
           FROM w JOIN items USING (r) JOIN gone USING (r))
SELECT doc_id, n_words, hit_windows, removed_words, item_ids, CASE WHEN all_gone THEN 'document' ELSE 'span' END AS action,
       CASE WHEN all_gone THEN '' ELSE regexp_extract(text, '^[^\\p{L}\\p{N}]*')
            || array_to_string(list_transform(list_filter(range(1, n_words + 1), lambda p: NOT list_contains(ps, p)), lambda p: units[p]), '') END AS clean_text
FROM x
"""
