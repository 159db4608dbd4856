"""The bounded sample of labelled rows that the classifiers learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.storage import staged

#: Documented bound: a classifier learns from this many labelled documents at most.
MOST_ROWS = 8000


def remainder(divisor: int) -> Column:
    """crc32 of the doc_id as text, modulo divisor: the fold of a document."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(divisor))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn_from: Column, most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id, text, label (0 or 1) of the labelled rows to learn from, whole texts, at most most_rows documents.

    The sample is drawn by a hash of doc_id. Rows without a label are left out; of repeated labels of a document
    the largest counts; of several rows of a document the one with the least text is learned from.
    """
    marks = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("label is not null and doc_id is not null").where(learn_from)
    marks = marks.groupBy("doc_id").agg(F.max("label").alias("label"))
    marks = staged(marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(marks), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))  # most_rows rows at most
    return found.select("doc_id", "text", F.col("label").cast("int").alias("label"))
