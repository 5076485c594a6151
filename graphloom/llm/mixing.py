"""Mixing sources to target weights by pivotal dependent rounding.

A source with n rows and target weight w gets total * w / n copies of each row,
in general a fraction; its whole part is certain, the rest is a probability.
Pivotal rounding takes two open rows of a source at a time and moves probability
from one to the other, at random and true to expectation, until one of them is 0
or 1.  Rows are rounded bucket by bucket; each bucket leaves at most one open row
a source, and these residuals are combined by a reduction tree, FAN of them at a
node, until one is left at the root and is drawn.  So each source's copies differ
from its expectation by less than one, whatever the number of buckets.

Without weights, sources get rows to the power of TEMPERATURE.  Without a total, the
least one is taken at which no row is lost: the source that is most over-represented
keeps one copy of each row, all others get more.  Draws are hashes of seed and row, so
a task that runs again decides the same, and so does another run over the same rows, wherever they lie (but for a draw within the last bit of a rate, which is a sum of doubles).  Counts, weights and rates of sources are a
table; it may have as many rows as there are hosts in a crawl.

Defined results: null is a source of its own; a source without a weight has
weight 0 and goes; weights of absent sources are ignored; rows alike in id and text
(ties, rows repeated whole) are rows of their own, of which resample may take any;
null, empty and very long texts don't matter; an empty table gives an empty result;
columns pass through, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._cluster import BROADCAST_BYTES, attached, cut, file_key, fresh, sized, text_key, with_columns_of

BUCKET_ROWS = 50_000
FAN = 32
#: Copies of a row that are written out as one run; more of them are runs of their own, spread over tasks.
RUN = 4096
TEMPERATURE = 0.7
SEED = 17
_EPS = 1e-9


def source_rates(docs: DataFrame, weights: Mapping[str | None, float] | None = None, total: float | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """(source, n, whole, p, rate) of each source: its rows, and their expected copies as a whole number, a fraction and together."""
    counts = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weighed = counts.withColumn("w", F.pow("n", F.lit(temperature)))
    else:
        own = docs.sparkSession.createDataFrame([(s, float(w)) for s, w in weights.items()], "_source string, _w double")
        weighed = counts.join(F.broadcast(own), F.col("source").eqNullSafe(F.col("_source")), "left").select("source", "n", F.coalesce("_w", F.lit(0.0)).alias("w"))
    weighed = cut(weighed)
    norm = weighed.agg(F.sum("w")).first()[0]
    if not norm:
        return weighed.select("source", "n", F.lit(0.0).alias("whole"), F.lit(0.0).alias("p"), F.lit(0.0).alias("rate"))
    if total is None:
        total = weighed.where("w > 0").agg(F.max(F.col("n") * F.lit(norm) / F.col("w"))).first()[0]
    r = F.lit(float(total)) * F.col("w") / F.lit(norm) / F.col("n")
    rate = F.when(F.abs(r - F.round(r)) < _EPS, F.round(r)).otherwise(r)
    return weighed.select("source", "n", F.floor(rate).cast("double").alias("whole"), (rate - F.floor(rate)).alias("p"), rate.alias("rate"))


def pivot(probabilities: list[float], draws: list[float]) -> tuple[list[int], int, float]:
    """(bit of each, index of the open one or -1, its probability); the open one's bit is 0 as yet."""
    bits = [0] * len(probabilities)
    held, p = -1, 0.0
    for i, (q, u) in enumerate(zip(probabilities, draws)):
        if q <= _EPS or q >= 1 - _EPS:
            bits[i] = int(q > 0.5)
            continue
        if held < 0:
            held, p = i, q
            continue
        s = p + q
        if s < 1:
            if u * s < q:
                held = i
            p = s
        else:
            if u * (2 - s) < 1 - q:
                bits[held], held = 1, i
            else:
                bits[i] = 1
            p = s - 1
        if p <= _EPS or p >= 1 - _EPS:
            bits[held] = int(p > 0.5)
            held, p = -1, 0.0
    return bits, held, p


def _uniform(*what: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*what), 11) + F.lit(0.5)) / F.lit(float(1 << 53))


def _rounded(rows: DataFrame) -> DataFrame:
    """One level: rows (doc_id, th, file, n, node, s, p, u) sorted by node and source; p of what stays open, bit of what is settled."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def settle(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts).combine_chunks()
            node, s = t["node"].to_numpy(), t["s"].to_numpy()
            p, u = t["p"].to_numpy(), t["u"].to_numpy()
            edges = np.flatnonzero(np.concatenate(([True], (node[1:] != node[:-1]) | (s[1:] != s[:-1]), [True])))
            bit, open_p = np.zeros(len(p), np.int32), np.zeros(len(p))
            for a, b in zip(edges[:-1], edges[1:]):
                bits, held, left = pivot(p[a:b].tolist(), u[a:b].tolist())
                bit[a:b] = bits
                if held >= 0:
                    open_p[a + held] = left
            t = t.set_column(t.schema.get_field_index("p"), "p", pa.array(open_p)).append_column("bit", pa.array(bit))
            return t.to_batches()[0]

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("node").to_numpy(), batch.column("s").to_numpy()
            differs = np.flatnonzero((key[0] != key[0][-1]) | (key[1] != key[1][-1]))
            last = int(differs[-1]) + 1 if len(differs) else 0
            if last:
                yield settle([*kept, batch.slice(0, last)])
                kept = []
            elif kept and (kept[-1].column("node")[-1].as_py(), kept[-1].column("s")[-1].as_py()) != (key[0][0], key[1][0]):
                yield settle(kept)
                kept = []
            kept.append(batch.slice(last))
        if kept:
            yield settle(kept)

    ordered = rows.repartition("node").sortWithinPartitions("node", "s", "doc_id", "th", "n", "file")
    return ordered.mapInArrow(make, "doc_id long, th long, file long, n long, node long, s long, p double, u double, bit int")


def _numbered(rows: DataFrame, count: str, name: str, *keys: str) -> DataFrame:
    """A row for each number from 1 to count, as column name; rows with large counts are spread over tasks by keys and run."""
    (run,) = fresh(rows, "_run")
    one = F.lit(1).cast("long")
    few = rows.where(F.col(count).between(1, RUN)).withColumn(name, F.explode(F.sequence(one, F.col(count))))
    runs = rows.where(F.col(count) > RUN).withColumn(run, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / RUN).cast("long"))))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = runs.repartition(tasks, *keys, run)
    many = spread.withColumn(name, F.explode(F.sequence(F.col(run) * RUN + one, F.least(F.col(count), (F.col(run) + 1) * RUN)))).drop(run)
    return few.union(many)


def copies(docs: DataFrame, rates: DataFrame, seed: int = SEED, bucket_rows: int = BUCKET_ROWS, fan: int = FAN) -> DataFrame:
    """(doc_id, th, file, n, s, bit) for each row of docs, s being 64 bits of the source; rates as of source_rates."""
    sources, rows_in_all = rates.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    table = sized(rates.select(F.col("source").alias("_source"), F.coalesce(F.xxhash64("source"), F.lit(0)).alias("s"), "p"), sources, 100)
    buckets = max(1, -(-rows_in_all // bucket_rows))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("th"), file_key().alias("file"), F.col("source").cast("string").alias("_source"))
    rows = rows.join(table, rows["_source"].eqNullSafe(table["_source"]))
    # of rows that are alike in id and text, n tells one from another, whatever the files they lie in are called
    alike = rows.groupBy("doc_id", "th", "file", "s", "p").count()
    before = Window.partitionBy("doc_id", "th", "s").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    alike = alike.withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    units = _numbered(alike, "count", "n", "doc_id", "th", "file").withColumn("n", F.col("n") + F.col("before")).drop("count", "before")
    own, drawn = ["doc_id", "th", "file", "n"], ["doc_id", "th", "n"]
    units = units.withColumn("u", _uniform(F.lit(seed), *drawn)).withColumn("node", F.pmod(F.xxhash64(F.lit(seed + 1), *drawn), F.lit(buckets)))
    level = cut(_rounded(units.select(*own, "node", "s", "p", "u")))
    settled, depth = [level.where("p = 0")], 1
    open_ = level.where("p > 0")
    while buckets > 1:
        buckets = -(-buckets // fan)
        level = cut(_rounded(open_.select(*own, F.floor(F.col("node") / fan).cast("long").alias("node"), "s", "p", _uniform(F.lit(seed + 100 + depth), *drawn).alias("u"))))
        settled.append(level.where("p = 0"))
        open_, depth = level.where("p > 0"), depth + 1
    root = open_.withColumn("bit", (_uniform(F.lit(seed + 99), *drawn) < F.col("p")).cast("int"))
    out = root
    for x in settled:
        out = out.unionByName(x)
    return out.select(*own, "s", "bit")


def mixture(docs: DataFrame, weights: Mapping[str | None, float] | None = None, total: float | None = None, seed: int = SEED, bucket_rows: int = BUCKET_ROWS, fan: int = FAN) -> DataFrame:
    """doc_id, source, rate (expected copies) and copies for each row of docs."""
    rates = cut(source_rates(docs, weights, total))
    names = sized(rates.select(F.coalesce(F.xxhash64("source"), F.lit(0)).alias("s"), "source", "rate", "whole"), rates.count(), 100)
    return copies(docs, rates, seed, bucket_rows, fan).join(names, "s").select("doc_id", "source", "rate", (F.col("whole") + F.col("bit")).cast("long").alias("copies"))


def resample(docs: DataFrame, weights: Mapping[str | None, float] | None = None, total: float | None = None, seed: int = SEED, bucket_rows: int = BUCKET_ROWS, fan: int = FAN) -> DataFrame:
    """docs, all columns, each row as often as it has copies; rows are copied where they lie."""
    rates = cut(source_rates(docs, weights, total))
    sources = rates.count()
    if not sources:
        return docs
    few = sources * 100 <= BROADCAST_BYTES
    whole_, value_, copies_, key_ = fresh(docs, "_whole", "_value", "_copies", "_s")
    names = sized(rates.select(F.coalesce(F.xxhash64("source"), F.lit(0)).alias(key_), F.col("whole").cast("long").alias(whole_)), sources, 100)
    rows = cut(copies(docs, rates, seed, bucket_rows, fan).join(names, F.col("s") == F.col(key_)).select("doc_id", "th", "file", "bit", (F.col("bit") + F.col(whole_)).alias("copies")))
    by_row = cut(rows.groupBy("doc_id", "th").agg(F.count("*").alias("alike"), F.sum("bit").cast("long").alias("bit"), F.sum("copies").alias("copies"), F.min("file").alias("file")))
    # the whole part is known where the row lies, if the table of sources may go there
    plain = by_row.where("alike = 1 AND bit > 0" if few else "alike = 1").select("doc_id", "th", "file", F.col("bit" if few else "copies").alias("value"))
    n_plain, n_alike = plain.count(), by_row.where("alike > 1").count()
    side = plain
    if n_alike:  # copies of all rows alike, as a negative number
        again = by_row.where("alike > 1").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), (-1 - F.col("copies")).alias("value"))
        side = side.unionByName(rows.select("doc_id", "th", "file").distinct().join(again, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))).select("doc_id", "th", "file", "value"))
    marked = attached(docs, side, (n_plain + n_alike) * 40, value_)
    if few:
        marked = marked.join(names, F.coalesce(F.xxhash64(F.col("source").cast("string")), F.lit(0)) == F.col(key_), "left")
    certain = F.coalesce(F.col(whole_), F.lit(0)) if few else F.lit(0)

    def repeated(some: DataFrame, n: Column) -> DataFrame:
        times = F.when(n >= 1, F.sequence(F.lit(1).cast("long"), n)).otherwise(F.array().cast("array<bigint>"))
        return with_columns_of(some.withColumn(copies_, F.explode(times)), docs)

    value = F.coalesce(F.col(value_), F.lit(0))
    alone = repeated(marked.where(value >= 0), certain + value)
    # of rows alike in id and text any stands for all
    if not n_alike:
        return alone
    (count_,) = fresh(marked, "_count")
    again = marked.where(value < 0).dropDuplicates(["doc_id", "text"]).withColumn(count_, -1 - value)
    return alone.union(with_columns_of(_numbered(again, count_, copies_, "doc_id"), docs))
