"""Token-ID output: Parquet list columns with controlled encodings, row groups and page indexes.

Texts are tokenised by a byte-level BPE whose vocabulary file is a parameter; its
bytes are broadcast, so that executors need no such file.  The table is written by
Spark's own committed writer, with token ids in a dictionary or delta encoding,
bounded row groups and small pages with column and offset indexes.  Rows are laid out by
ranges of (source, doc_id) over the files and sorted within each, so a reader of one
source or a range of ids opens few files and skips row groups and pages in them, and a
reader of metadata never touches tokens.  The ranges cost one shuffle of the texts; with
layout="files" rows stay in the files' order instead and are only sorted within each.

Defined results: a null text has null tokens and n_tokens 0, the empty text an
empty list, very long texts are tokenised whole; strings of special tokens in a text are
ordinary text, so that decoding gives back every text exactly; null sources and ids come
first, of ties and repeated rows, which are rows, the earlier in the input; an empty table
gives an empty table; further columns are kept as metadata, and a new column whose name is
taken has underscores before it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ._cluster import fresh, new_path

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokeniser of the public 50k byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 128 << 10
PAGE_ROWS = 512
SLICE_ROWS = 128
_encodings: dict[int, object] = {}


def encoding(vocabulary: bytes):
    """The tokeniser of a vocabulary file's bytes, made once a process."""
    import tiktoken

    key = hash(vocabulary)
    if key not in _encodings:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        _encodings[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def tokenize(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """docs without text, with n_tokens and tokens."""
    count_, tokens_ = fresh(docs, "n_tokens", "tokens")
    with open(tokenizer, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    meta = [c for c in docs.columns if c != "text"]
    schema = S.StructType([*(docs.schema[c] for c in meta), S.StructField(count_, S.IntegerType()), S.StructField(tokens_, S.ArrayType(S.IntegerType(), False))])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):  # ids are Python integers for a moment
                part = batch.slice(at, SLICE_ROWS)
                texts = part.column(len(meta)).to_pylist()
                ids = [own.encode_ordinary(t) if t else [] for t in texts]
                count = np.fromiter(map(len, ids), np.int32, len(ids))
                null = np.fromiter((t is None for t in texts), bool, len(texts))
                offsets = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
                flat = pa.array(np.fromiter((i for x in ids for i in x), np.int32, int(offsets[-1])))
                item = pa.field("element", pa.int32(), False)
                validity = pa.py_buffer(np.packbits(~null, bitorder="little").tobytes()) if null.any() else None
                lists = pa.Array.from_buffers(pa.list_(item), len(ids), [validity, pa.py_buffer(offsets.tobytes())], children=[flat])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(count), lists], [*meta, count_, tokens_])

    return docs.select(*[f"`{c}`" for c in meta], "text").mapInArrow(make, schema)


def laid_out(docs: DataFrame, layout: str = "range") -> DataFrame:
    """docs in ranges of (source, doc_id) over the partitions and in order within each, or only the latter."""
    if layout not in ("range", "files"):
        raise ValueError(f"layout is range or files, not {layout}")
    (row,) = fresh(docs, "_row")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())  # splits and orders ties
    keys = [F.col(c) for c in ("source", "doc_id") if c in docs.columns] + [F.col(row)]
    placed = numbered.repartitionByRange(*keys) if layout == "range" else numbered
    return placed.sortWithinPartitions(*keys).drop(row)


def write_tokens(tokens: DataFrame, path: str, encoding: str = "dictionary", row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS) -> str:
    """Write a token table as it lies; encoding of the ids is "dictionary" or "delta"."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding is dictionary or delta, not {encoding}")
    writer = tokens.write
    lists = [f.name for f in tokens.schema if isinstance(f.dataType, S.ArrayType) and f.name.strip("_") == "tokens"]
    options = {
        "compression": "zstd",
        "parquet.block.size": row_group_bytes,
        "parquet.page.size": page_bytes,
        "parquet.page.row.count.limit": page_rows,
        "parquet.writer.version": "v2",  # delta for integers outside a dictionary, and page headers that a reader can skip by
        "parquet.enable.dictionary": "true",
        "parquet.dictionary.page.size": 1 << 20,
        "parquet.columnindex.truncate.length": 64,
    }
    if encoding == "delta":
        options |= {f"parquet.enable.dictionary#{name}.list.element": "false" for name in lists}
    for k, v in options.items():
        writer = writer.option(k, str(v))
    writer.parquet(path)
    return path


def token_table(docs: DataFrame, tokenizer: str = TOKENIZER, path: str | None = None, encoding: str = "dictionary", layout: str = "range") -> DataFrame:
    """Tokenise docs, write the table to path (of its own in the shared folder unless given), and read it."""
    spark = docs.sparkSession
    return spark.read.parquet(write_tokens(tokenize(laid_out(docs, layout), tokenizer), path or new_path(spark, "tokens"), encoding))


def read_tokens(spark: SparkSession, path: str, source: str | None = None, ids: tuple[int, int] | None = None, columns: list[str] | None = None) -> DataFrame:
    """A selective read: by source and range of doc_id, which the indexes prune by, of some columns."""
    df = spark.read.parquet(path)
    if source is not None:
        df = df.where(F.col("source") == source)
    if ids is not None:
        df = df.where(F.col("doc_id").between(*ids))
    return df.select(*columns) if columns else df
