"""Registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.llm import (bpe_count, curve, decontaminate, gam, importance, license_scan, packing, simhash, spelling,
                         token_store, toxicity, warc, winnow)
from opslens.llm.common import documents, settle


def tokenizer(name: str) -> str:
    """Path of a public tokenizer file on this machine; executors have the same package."""
    import public_tokenizers
    return str(public_tokenizers.path(name))


def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return gam.classify(docs, gam.fit(docs, documents(spark, sf_dir, "labels")))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = settle(license_scan.index(documents(spark, sf_dir)), "licence-words")
    return license_scan.summary(license_scan.scan(found, license_scan.fit(found)))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.count_tokens(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edited_pairs(documents(spark, sf_dir))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"), end_id=2)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.classify(docs, toxicity.fit(docs, documents(spark, sf_dir, "labels")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id")


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.derivatives(documents(spark, sf_dir, "pages"))
    return found.withColumn("content_sha256", F.sha2(F.col("content").cast("binary"), 256)).drop("content")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), end_id=0)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op12_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve.pack_documents(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), end_id=1)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_quality_gam, op2_license_scan, op3_token_counts, op4_winnowing, op5_token_files,
                                   op6_decontamination, op7_toxicity, op8_simhash, op9_warc_derivatives, op10_packing,
                                   op11_importance, op12_curve_packing, op13_spelling)}
ORACLES = {"op2_license_scan": license_scan.oracle(), "op6_decontamination": decontaminate.ORACLE,
           "op11_importance": importance.oracle(), "op13_spelling": spelling.oracle()}
