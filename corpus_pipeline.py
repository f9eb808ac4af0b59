"""Corpus pipeline: toxicity, quality, near-duplicates, decontamination, packing.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` and works on what the stage
before it kept, written as Parquet and read again. All stages but the last
return the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from opslens.llm import decontaminate, gam, packing, simhash, toxicity
from opslens.llm.common import documents, settle
from opslens.llm.queries import tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, documents(spark, sf_dir, "labels")))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return gam.drop_low_quality(docs, gam.fit(docs, documents(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id (null last), of rows with
    that id one. Rows without an id and rows that share one are told apart by a number of their own."""
    return simhash.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.drop_documents(docs, documents(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences. The texts are encoded in smaller slices
    than the operator's default, as executors still hold the memory of the stages before."""
    return packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"), end_id=0, slice_bytes=4_000_000)


STAGES = [("toxicity", drop_toxic), ("quality classifier", keep_quality), ("SimHash near-dedup", drop_near_duplicates),
          ("benchmark decontamination", decontaminated), ("best-fit packing", packed)]

ORACLE_SQL = None  # classifiers, hashes and tokens are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
