"""Window-shaped operators: fair interleaving, recency buckets, caps, first-per-key, queues and state tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def interleave_by_provider(items: DataFrame, provider: str, order: list[Column], bucket: Column | None = None, cap: int | None = None) -> DataFrame:
    """Every provider's best, then every provider's second best, and so on; inside a bucket if one is given.

    Adds bucket and turn. Sort by (bucket, turn, *order) to read the result. cap: rows of a provider (and bucket) at most.
    """
    items = items.withColumn("bucket", F.lit(0).cast("long") if bucket is None else bucket)
    turn = F.row_number().over(Window.partitionBy("bucket", provider).orderBy(*order))
    items = items.withColumn("turn", turn)
    return items if cap is None else items.where(F.col("turn") <= cap)


def recency_bucket(published_at: Column, now_ms: int, width_ms: int = 7_200_000) -> Column:
    return F.floor(F.greatest(F.lit(0), F.lit(now_ms) - published_at) / width_ms)


def first_per_key(items: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return items.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def top_per_group(items: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return items.withColumn("rank", rank).where(F.col("rank") <= k)


def upsert(state: DataFrame, fresh: DataFrame, key: str, version: str) -> DataFrame:
    """State with the newest version of each key; fresh rows win ties."""
    both = state.withColumn("_fresh", F.lit(0)).unionByName(fresh.withColumn("_fresh", F.lit(1)))
    return first_per_key(both, [key], [F.col(version).desc(), F.col("_fresh").desc()]).drop("_fresh")


def prune(items: DataFrame, now_ms: int, retention_ms: int, most: int, group: str | None = None) -> DataFrame:
    """Rows within retention, the newest `most` of each group. One group is cut by a distributed top-k."""
    kept = items.where(F.col("published_at") >= now_ms - retention_ms)
    if group is None:
        return kept.orderBy(F.col("published_at").desc(), "id").limit(most)
    return top_per_group(kept, [group], [F.col("published_at").desc(), F.col("id")], most).drop("rank")


def merge_queue(queue: DataFrame, incoming: DataFrame, stored: DataFrame, cutoff_ms: int, most: int) -> DataFrame:
    """Queue then incoming, first row of each id, without what is stored or older than the cutoff; newest first, cut to `most`."""
    both = queue.withColumn("_from", F.lit(0)).unionByName(incoming.withColumn("_from", F.lit(1)))
    once = first_per_key(both, ["id"], [F.col("_from")]).drop("_from")
    fresh = once.join(stored.select("id"), "id", "left_anti").where(F.col("published_at") >= cutoff_ms)
    return fresh.orderBy(F.col("published_at").desc(), "id").limit(most)


def trailing(items: DataFrame, key: str, order: str, value: Column, rows: int = 30) -> Column:
    """Sum over this record and the `rows` before it."""
    return F.sum(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(-rows, 0))
