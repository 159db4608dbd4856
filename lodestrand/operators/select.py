"""Filters and partitions of items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.functions.text import mentions


def eligible(items: DataFrame, now_ms: int, retention_ms: int) -> DataFrame:
    return items.where(~F.col("clickbait") & (F.col("published_at") >= now_ms - retention_ms) & (F.col("published_at") <= now_ms))


def exclusion_counts(items: DataFrame, text: Column, terms: list[str], share: float = 0.6) -> DataFrame:
    """A row for each term of two characters or more: hits, and whether it is too common to be applied (over `share` of the rows)."""
    terms = [t for t in dict.fromkeys(x.strip().lower() for x in terms) if len(t) >= 2]
    counts = items.agg(F.count("*").alias("n"), *(F.count_if(mentions(text, t)).alias(f"hits_{i}") for i, t in enumerate(terms)))
    rows = F.array(*(F.struct(F.lit(t).alias("term"), F.col(f"hits_{i}").alias("hits")) for i, t in enumerate(terms)))
    return counts.select("n", F.inline(rows)).select("term", "hits", (F.col("hits") > F.floor(F.col("n") * share)).alias("skipped"))


def without_excluded(items: DataFrame, text: Column, terms: list[str], share: float = 0.6) -> DataFrame:
    """Rows that match no term, where terms that hit over `share` of the rows aren't applied."""
    active = [r["term"] for r in exclusion_counts(items, text, terms, share).where("not skipped and hits > 0").collect()]  # as many as the terms
    return items.where(~reduce(lambda a, b: a | b, [mentions(text, t) for t in active])) if active else items
