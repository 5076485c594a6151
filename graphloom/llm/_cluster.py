"""What the corpus operators need from the session: the shared folder, cut lineage, sized broadcasts."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: A side is broadcast only if rows * bytes a row stay below this; beyond it the join shuffles.
BROADCAST_BYTES = 64 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, as in tests on one machine, one of our own, set for the session."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not at:
        at = sc._jsc.sc().getCheckpointDir()
        at = at.get() if at.isDefined() else None
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut: a reliable checkpoint in the shared folder, which outlives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def sized(df: DataFrame, rows: int, bytes_a_row: int) -> DataFrame:
    """df with a broadcast hint if `rows` counted rows are small enough, else df, which then joins by shuffle."""
    return F.broadcast(df) if rows * bytes_a_row <= BROADCAST_BYTES else df


def text_key(text: str = "text") -> Column:
    """64 bits of the text; 0 for null, so that it can be a join key."""
    return F.coalesce(F.xxhash64(F.col(text)), F.lit(0))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes not to be a column of df."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        out.append(n)
    return out


def with_columns_of(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*[f"`{c}`" for c in like.columns])


def file_key() -> Column:
    """64 bits of the file that a row is read from, 0 without one; to be selected where the file is scanned."""
    return F.when(F.input_file_name() == "", F.lit(0)).otherwise(F.xxhash64(F.input_file_name()))


def attached(docs: DataFrame, side: DataFrame, total_bytes: int, name: str) -> DataFrame:
    """docs with a further column: the value that side (doc_id, th, file, value) has for the row, else null.

    The rows of docs stay where they are.  A small side is broadcast.  A larger one is written to the shared folder,
    sorted by the file that its rows come from, and a task looks up only the rows of the files that it scans; so
    neither texts nor the whole side move, whatever their size.  Only rows that are read from no file (results of a
    shuffle, or local data) are then joined by a shuffle.
    """
    key = [docs["doc_id"].cast("long"), F.coalesce(F.xxhash64(docs["text"]), F.lit(0))]
    columns = [docs[f"`{c}`"] for c in docs.columns]
    if total_bytes <= BROADCAST_BYTES or not side.where("file = 0").isEmpty():
        once = sized(side.dropDuplicates(["doc_id", "th"]).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.col("value").alias("_value")), 1, total_bytes)
        return docs.join(once, key[0].eqNullSafe(once["_id"]) & (key[1] == once["_th"]), "left").select(*columns, once["_value"].alias(name))
    path, buckets = new_path(docs.sparkSession, "side"), max(1, total_bytes // BROADCAST_BYTES)
    bucket = F.pmod("file", F.lit(buckets))
    side.select("file", "doc_id", "th", "value", bucket.alias("bucket")).repartition("bucket").sortWithinPartitions("bucket", "file").write.option("parquet.block.size", str(4 << 20)).partitionBy("bucket").parquet(path)
    kind = side.schema["value"].dataType
    held: dict = {}

    @F.arrow_udf(kind)
    def look_up(file: pa.Array, doc_id: pa.Array, th: pa.Array) -> pa.Array:
        out = []
        for f, i, h in zip(file.to_pylist(), doc_id.to_pylist(), th.to_pylist()):
            if held.get("file") != f:  # a file at a time
                where, root = fs.FileSystem.from_uri(path)
                at = f"{root}/bucket={f % buckets}"
                t = ds.dataset(at, filesystem=where, format="parquet").to_table(filter=ds.field("file") == f, columns=["doc_id", "th", "value"]) if where.get_file_info(at).type != fs.FileType.NotFound else None
                held["file"], held["rows"] = f, {} if t is None else dict(zip(zip(t["doc_id"].to_pylist(), t["th"].to_pylist()), t["value"].to_pylist()))
            out.append(held["rows"].get((i, h)))
        return pa.array(out, to_arrow_type(kind))

    return docs.select(*columns, look_up(file_key(), key[0], key[1]).alias(name))


def keep_one(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """docs, all columns, with one row of each group.

    groups has doc_id, th, file, group_id, kept_th and keep for each row of docs.  Rows are dropped where they lie; of
    rows repeated whole, which can't be told apart there, one is drawn by a shuffle of just these.
    """
    rows = cut(groups.select("doc_id", "th", "file", "keep", (F.col("doc_id").eqNullSafe(F.col("group_id")) & (F.col("th") == F.col("kept_th"))).alias("same")))
    n_gone, n_repeated = rows.where("NOT keep").agg(F.coalesce(F.sum((~F.col("same")).cast("long")), F.lit(0)), F.coalesce(F.sum(F.col("same").cast("long")), F.lit(0))).first()
    if not n_gone + n_repeated:
        return docs
    side = rows.where("NOT keep AND NOT same").select("doc_id", "th", "file", F.lit(0).alias("value"))
    if n_repeated:
        again = rows.where("NOT keep AND same").select("doc_id", "th").distinct()
        side = side.unionByName(rows.where("same").join(again, rows["doc_id"].eqNullSafe(again["doc_id"]) & (rows["th"] == again["th"]), "left_semi").select("doc_id", "th", "file", F.lit(1).alias("value")))
    (flag,) = fresh(docs, "_flag")
    marked = attached(docs, side.distinct(), (n_gone + 2 * n_repeated) * 32, flag)
    left = with_columns_of(marked.where(F.col(flag).isNull()), docs)
    return left.union(with_columns_of(marked.where(F.col(flag) == 1), docs).dropDuplicates(["doc_id", "text"])) if n_repeated else left
