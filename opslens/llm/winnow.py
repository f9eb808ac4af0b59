"""Document fingerprints by winnowing, native.

A k-gram is ``k`` consecutive words (split at white space); its hash is
Spark's xxhash64 over its words, computed anew for each, cut to 31 bits. Of each window of
``w`` consecutive k-grams the smallest hash is chosen, the rightmost on ties,
and kept with its position. Texts that share ``w + k - 1`` consecutive words
share a chosen hash: the winnowing guarantee.

Hash and position are packed in one long (hash above, descending position
below), so a plain minimum does both; the minimum over ``w`` is built by
doubling (1, 2, 4, ... k-grams), each step one pass over the array.

Cases: a null or empty text (or only white space) has no k-gram and an empty
fingerprint; a text of fewer than ``k`` words has one k-gram of all its words;
fewer than ``w`` k-grams make one window. Two empty fingerprints are alike
(1), an empty and another are not (0). Equal texts have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opslens.llm.common import id_text, order_bucket

K = 4
WINDOW = 8
_LOW = 0xFFFFFFFF


def choose(df: DataFrame, text: str, out: str, k: int = K, w: int = WINDOW) -> DataFrame:
    """Add ``out``: array<long>, the chosen (hash, position) of each window, packed, in order."""
    if w & (w - 1):
        raise ValueError("the window must be a power of two")
    tmp = f"__{out}"
    df = df.withColumn(tmp, F.array_remove(F.split(F.col(text), r"[\x20\x09-\x0D]+"), ""))
    words = F.col(tmp)
    df = df.withColumn(out, F.transform(words, lambda x, i: F.shiftleft(F.shiftrightunsigned(
        F.xxhash64(x, *[F.get(words, i + j) for j in range(1, k)]), 33), 32).bitwiseOR(F.lit(_LOW) - i)))
    n = F.size(out)
    df = df.withColumn(out, F.slice(out, F.lit(1), F.greatest(n - k + 1, F.least(n, F.lit(1))))).drop(tmp)
    count = F.size(out)
    df = df.withColumn(f"{tmp}n", F.greatest(count - w + 1, F.least(count, F.lit(1))))
    half = 1
    while half < w:
        step, prior = half, f"{tmp}{half}"
        df = df.withColumnRenamed(out, prior)
        df = df.withColumn(out, F.transform(prior, lambda x, i: F.least(x, F.get(F.col(prior), i + step)))).drop(prior)
        half *= 2
    return df.withColumn(out, F.array_distinct(F.slice(out, F.lit(1), F.col(f"{tmp}n")))).drop(f"{tmp}n")


def hashes(packed: str) -> Column:
    return F.transform(packed, lambda e: F.shiftright(e, 32).cast("int"))


def picks(packed: str) -> Column:
    """array<struct<hash int, pos int>> of a packed column."""
    return F.transform(packed, lambda e: F.struct(
        F.shiftright(e, 32).cast("int").alias("hash"), (F.lit(_LOW) - e.bitwiseAND(F.lit(_LOW))).cast("int").alias("pos")))


def as_text(hash_array: Column) -> Column:
    """Eight hex digits for each chosen hash, in order."""
    return F.array_join(F.transform(hash_array, lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two hash arrays (0 to 1)."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                k: int = K, w: int = WINDOW) -> DataFrame:
    """doc_id, fingerprint array<struct<hash, pos>> of every document."""
    return choose(id_text(docs, id_col, text_col), "text", "packed", k, w).select(
        "doc_id", picks("packed").alias("fingerprint"))


def with_next(docs: DataFrame, prepare) -> DataFrame:
    """``prepare(docs)`` plus ``next``: the prepared struct of the row after each, by
    (doc_id, text); the first row comes after the last.

    Rows are dealt by quantile buckets of the id, so one shuffle gives each
    task a few stretches of the order; only the head of each bucket (as many
    as the buckets) crosses to the bucket before it.
    """
    bucketed = docs.withColumn("bucket", order_bucket(docs))
    heads = bucketed.groupBy("bucket").agg(F.min("doc_id").alias("head"))
    owners = (bucketed.join(F.broadcast(heads.drop("bucket")), F.col("doc_id").eqNullSafe(F.col("head")), "left_semi")
              .groupBy("bucket", "doc_id").agg(F.min("text").alias("text")))
    owners = prepare(owners)
    cols = F.struct(*[c for c in owners.columns if c not in ("bucket", "doc_id")])
    chain = W.orderBy("bucket")  # one row a bucket
    links = heads.select("bucket", F.coalesce(F.lead("bucket").over(chain), F.first("bucket").over(chain)).alias("after"))
    crossing = links.join(owners.select(F.col("bucket").alias("after"), cols.alias("over")), "after").drop("after")
    order = W.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    ahead = prepare(bucketed).withColumn("ahead", F.lead(cols).over(order))
    return ahead.join(crossing, "bucket", "left").withColumn("next", F.coalesce("ahead", "over")).drop(
        "ahead", "over", "bucket")


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 k: int = K, w: int = WINDOW) -> DataFrame:
    """Fingerprint of each text, of the text with its last half replaced by the next
    document's first half as long, and their likeness; the next document's too."""
    def prepare(df: DataFrame) -> DataFrame:
        return choose(df, "text", "packed", k, w).withColumn("own", hashes("packed")).drop("packed")

    rows = with_next(id_text(docs, id_col, text_col), prepare)
    n = F.char_length("text")
    cut = F.floor(n / 2).cast("int")
    rows = rows.select("doc_id", "own", n.cast("long").alias("n_chars"), F.col("next.own").alias("next_own"),
                       F.concat(F.substring("text", F.lit(1), n - cut),
                                F.substring(F.col("next.text"), F.lit(1), cut)).alias("edited"))
    rows = choose(rows, "edited", "packed", k, w).withColumn("new", hashes("packed"))
    return rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                       as_text(F.col("own")).alias("fingerprint"), as_text(F.col("new")).alias("edited_fingerprint"),
                       likeness(F.col("own"), F.col("new")).alias("near_edited"),
                       likeness(F.col("own"), F.col("next_own")).alias("near_next"))
