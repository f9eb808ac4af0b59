"""A bounded sample of labelled documents to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.llm.common import held_out, id_text


def sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, limit: int,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, label) of at most ``limit`` labelled rows outside the held-out fold for which
    ``keep`` holds, chosen by a hash of the id; only ids are ordered and broadcast (``limit`` rows)."""
    own = (labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("label"))
           .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")) & keep)
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    return id_text(docs, id_col, text_col).join(F.broadcast(own), "doc_id").select("text", "label")
