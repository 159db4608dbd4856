"""The corpus pipeline, over documents. Each stage works on all rows its predecessor kept.

Quality and toxicity rows that a stage rejects go, one document of each group of near copies stays, and the rest is packed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm import packing, quality, simhash, toxicity
from lodestrand.llm.samples import remainder
from lodestrand.session import ready
from lodestrand.storage import staged


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs has not."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a quality score under 0.3 go; the columns of docs, and repeated rows, stay as they are.

    Null and empty texts are scored like any other. No rows give no rows, and without labels every score is 0.5.
    """
    labels, name = ready(spark).read.parquet(f"{sf_dir}/labels.parquet"), _free(docs, "_quality")
    scored = quality.score(docs, quality.fit(docs, labels, remainder(5) != 0), name)
    return scored.where(F.col(name) >= 0.3).select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a toxicity score of 0.7 or more go; the columns of docs, and repeated rows, stay as they are.

    Null and empty texts are scored like any other. No rows give no rows, and without labels every score is 0.5.
    """
    labels, name = ready(spark).read.parquet(f"{sf_dir}/labels.parquet"), _free(docs, "_toxicity")
    scored = toxicity.score(docs, toxicity.fit(docs, labels, remainder(3) != 1), name)
    return scored.where(F.col(name) < 0.7).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (a Jaccard of 0.8 of the shingles of five words) the document with the smallest doc_id stays.

    Repeated rows stay once, rows of one doc_id with unlike texts all stay; null and empty texts are one group. See simhash.deduplicate.
    """
    ready(spark)
    return simhash.deduplicate(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest in sequences of at most 2048 tokens: a row for each piece, with its token ids. Null texts count as empty, repeated rows give repeated pieces."""
    ready(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=True)


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("near_dedup", near_dedup_stage), ("packing", packing_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))  # the next stage reads it more than once
    return STAGES[-1][1](spark, docs, sf_dir)
