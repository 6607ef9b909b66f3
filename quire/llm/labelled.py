"""A bounded sample of labelled documents to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, max_rows: int) -> DataFrame:
    """doc_id, text and y of at most max_rows labelled documents, those of the smallest hash of doc_id.

    allowed says which doc_ids may be learnt from. Null labels are left out; of several labels the largest counts.
    The chosen ids are broadcast: max_rows bounds them.
    """
    chosen = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & allowed)
    chosen = chosen.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    chosen = chosen.select(F.col("doc_id").alias("__id"), "y")
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "y")
