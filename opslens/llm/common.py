"""Shared helpers of the training-data operators.

Every operator takes a DataFrame plus the names of its id and text columns and
returns only its own columns, so extra input columns (also with clashing names)
never reach it. A null text counts as the empty text; a null id is kept as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.session import ensure_checkpoint_dir


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with a null text as the empty string."""
    return docs.select(F.col(id_col).alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with marks ahead until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's text form leaves remainder 1 by 3; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def order_bucket(docs: DataFrame, id_col: str = "doc_id") -> Column:
    """Bucket number that ascends with the integer id and holds about equally many rows.

    The bounds are quantiles of the id column, counted by Spark; only they
    reach the driver (four for each shuffle partition, so that hashing buckets
    to tasks stays even). Rows with equal ids share a bucket; a null id is in
    bucket -1, before all others.
    """
    n = 4 * shuffle_width(docs.sparkSession)
    at = [i / n for i in range(1, n)]
    bounds = docs.agg(F.percentile_approx(F.col(id_col), at, 20 * n).alias("q")).first()["q"] or []

    def longs(values) -> Column:
        return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values \
            else F.array().cast("array<bigint>")

    key = F.col(id_col)
    # two-level search: every step-th bound first, then the few between two of them
    step = max(1, round(n ** 0.5))
    high = F.size(F.filter(longs(bounds[step - 1::step]), lambda b: b < key))
    low = F.size(F.filter(F.slice(longs(bounds), high * step + 1, F.lit(step)), lambda b: b < key))
    return F.when(key.isNull(), F.lit(-1)).otherwise(high * step + low)


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new folder name, as a full URI, under the checkpoint folder that all executors share."""
    import uuid
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{tag}-{uuid.uuid4().hex[:12]}"


def settle(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it back: the lineage
    is cut and a lost executor loses nothing of it."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_fs(uri: str):
    """pyarrow file system and path of a URI (file, hdfs, s3, gs, ...)."""
    from pyarrow import fs
    if uri.startswith("file:"):
        uri = "file://" + "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)
