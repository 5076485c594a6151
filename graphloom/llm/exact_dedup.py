"""Exact dedup by Grace hash.

Map tasks hash complete texts into an open-addressing table and hand on each
content once, with its least doc_id and how often it came, so a hot text costs one
record a task; past TABLE_BYTES the table is closed and contents that it doesn't have are
handed on as they come.  The records are partitioned by 64 bits of their text, first across the
cluster (the shuffle is the outermost level of spill files), then inside a task:
contents go into an open-addressing table until it holds TABLE_BYTES; from then on
it is closed, records of contents that it has are settled, and all others are
partitioned by further hash bits to spill files in the shared folder, each of which
is processed the same way, until a bucket fits.  Slots compare complete contents,
never only hashes.  A worker holds contents and three numbers for each, and nothing
a row.  Rows then meet their content by its 64 bits, in which only numbers move; where
two contents share these bits (a collision), rows of both are compared by content.

Defined results: null is no content, so each null text is a group of its own;
the empty text is a content; very long texts are compared whole; of a group the row
with the least doc_id (nulls last) stays, and of ties and rows repeated whole exactly
one; an empty table gives an empty result; further columns pass through, whatever
they are called.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._cluster import cut, file_key, keep_one, shared_folder, sized, text_key

TABLE_BYTES = 64 << 20
FANOUT = 16
_NO_ID = np.iinfo(np.int64).max
_RECORD = ["th", "text", "least", "n"]


class ContentTable:
    """Open addressing with linear probing; a slot matches only if the contents are equal."""

    def __init__(self, slots: int = 1 << 10):
        self.slot = [-1] * slots
        self.hashes: list[int] = []
        self.contents: list[str] = []
        self.least: list[int] = []
        self.n: list[int] = []
        self.bytes = 0

    def find(self, h: int, content: str) -> tuple[int, int]:
        """(index or -1, slot)."""
        slot, mask = self.slot, len(self.slot) - 1
        at = h & mask
        while (i := slot[at]) >= 0:
            if self.hashes[i] == h and self.contents[i] == content:
                return i, at
            at = (at + 1) & mask
        return -1, at

    def add(self, h: int, content: str, at: int, least: int = _NO_ID, n: int = 0) -> int:
        i = len(self.contents)
        self.slot[at] = i
        self.hashes.append(h)
        self.contents.append(content)
        self.least.append(least)
        self.n.append(n)
        self.bytes += 4 * len(content) + 200  # at most, with what Python adds
        if 2 * i > len(self.slot):
            self.slot = [-1] * (2 * len(self.slot))
            mask = len(self.slot) - 1
            for j, x in enumerate(self.hashes):
                at = x & mask
                while self.slot[at] >= 0:
                    at = (at + 1) & mask
                self.slot[at] = j
        return i

    def take(self, batch: pa.RecordBatch, table_bytes: int) -> np.ndarray:
        """Which records (th, text, least, n) of a batch are not in the table, as it is closed."""
        rest, least, n = [], self.least, self.n
        for j, (h, text, d, k) in enumerate(zip(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64).tolist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            i, slot = self.find(h, text)
            if i >= 0:
                n[i] += k
                if d < least[i]:
                    least[i] = d
            elif self.bytes > table_bytes:
                rest.append(j)
            else:
                self.add(h, text, slot, d, k)
        return np.array(rest, np.int64)

    def records(self, texts: bool) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(self.contents), 1000):
            b = slice(a, a + 1000)
            columns = {"th": pa.array(np.array(self.hashes[b], np.uint64).view(np.int64)), "text": pa.array(self.contents[b], pa.string()), "least": pa.array(self.least[b], pa.int64()), "n": pa.array(self.n[b], pa.int64())}
            yield pa.RecordBatch.from_arrays([columns[c] for c in _RECORD if texts or c != "text"], [c for c in _RECORD if texts or c != "text"])


def combine(batches: Iterable[pa.RecordBatch], table_bytes: int = TABLE_BYTES) -> Iterator[pa.RecordBatch]:
    """Records (th, text, least, n) with each content once, as long as the table takes contents."""
    table = ContentTable()
    for batch in batches:
        rest = table.take(batch, table_bytes)
        if len(rest):
            yield pa.RecordBatch.from_arrays(batch.take(pa.array(rest)).columns, _RECORD)
    yield from table.records(True)


def grace(batches: Iterable[pa.RecordBatch], folder: str, table_bytes: int = TABLE_BYTES, level: int = 0) -> Iterator[pa.RecordBatch]:
    """(th, least, n) of each content of batches of (th, text, least, n); folder is where spill files may go, as a URI."""
    table = ContentTable()
    where, root = fs.FileSystem.from_uri(folder)
    mine, files = f"{root}/grace-{uuid.uuid4().hex}", {}
    try:
        for batch in batches:
            rest = table.take(batch, table_bytes)
            if len(rest):
                h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)[rest]
                part = (T.mix(h + np.uint64(0x51ED2701 * (level + 1))) % np.uint64(FANOUT)).astype(np.int64)
                for p in np.unique(part):
                    if int(p) not in files:
                        where.create_dir(mine, recursive=True)
                        sink = where.open_output_stream(f"{mine}/{p}.arrow")
                        files[int(p)] = (sink, ipc.new_stream(sink, batch.schema, options=ipc.IpcWriteOptions(compression="zstd")))
                    files[int(p)][1].write_batch(batch.take(pa.array(rest[part == p])))
        yield from table.records(False)
        del table
        for p in sorted(files):
            files[p][1].close()
            files[p][0].close()
        for p in sorted(files):
            with where.open_input_stream(f"{mine}/{p}.arrow") as source, ipc.open_stream(source) as reader:
                yield from grace(reader, folder, table_bytes, level + 1)
            where.delete_file(f"{mine}/{p}.arrow")
    finally:
        if files:
            where.delete_dir(mine)


def exact_groups(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """A row for each row of docs: doc_id, th, file, group_id (the group's least doc_id), group_size, keep."""
    folder = shared_folder(docs.sparkSession)
    doc_id = F.col("doc_id").cast("long")
    records = docs.where("text IS NOT NULL").select(text_key().alias("th"), "text", F.coalesce(doc_id, F.lit(int(_NO_ID))).alias("least"), F.lit(1).cast("long").alias("n"))
    combined = records.mapInArrow(lambda batches: combine(batches, table_bytes), "th long, text string, least long, n long")
    contents = cut(combined.repartition("th").mapInArrow(lambda batches: grace(batches, folder, table_bytes), "th long, least long, n long"))
    shared = cut(contents.groupBy("th").count().where("count > 1").select(F.col("th").alias("_th")))  # 64 bits that several contents have
    some = shared.count()
    rows = docs.select(doc_id.alias("doc_id"), text_key().alias("th"), file_key().alias("file"), F.col("text").isNull().alias("absent"), *([F.col("text").alias("_text")] if some else []))
    if some:
        rows = rows.join(sized(shared, some, 16), F.col("th") == F.col("_th"), "left").withColumn("same", F.when(F.col("_th").isNotNull(), F.col("_text"))).drop("_th", "_text")
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    key = ["th", "same"] if some else ["th"]
    # of rows with the least id one stays
    first = rows.where("NOT absent").groupBy(*key).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"), F.count("*").alias("own"))
    if some:  # counted by content right here
        groups = first.select(F.col("th").alias("t"), F.col("same").alias("s"), F.col("first"), F.col("own").alias("n"))
    else:
        groups = first.join(contents, "th").select(F.col("th").alias("t"), F.lit(None).cast("string").alias("s"), "first", "n")
    match = (rows["th"] == groups["t"]) & (rows["same"].eqNullSafe(groups["s"]) if some else F.lit(True))
    known = rows.where("NOT absent").join(groups, match).select("doc_id", "th", "file", F.col("first")["doc_id"].alias("group_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("first")["row"]).alias("keep"))
    alone = rows.where("absent").select("doc_id", "th", "file", F.col("doc_id").alias("group_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("keep"))
    return known.unionByName(alone)


def exact_duplicates(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """doc_id, group_id, group_size, keep for each row of docs."""
    return exact_groups(docs, table_bytes).drop("th", "file")


def drop_exact_duplicates(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """docs, all columns, with one row of each content."""
    return keep_one(docs, exact_groups(docs, table_bytes).withColumn("kept_th", F.col("th")))


EXACT_SQL = """
SELECT doc_id, CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS group_id,
       CASE WHEN text IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY text) END AS group_size,
       text IS NULL OR row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) = 1 AS keep
FROM documents
"""
