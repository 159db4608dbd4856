"""Queries on the whole chain from items to stories, and on its parts as rows arrive."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrand.functions import text as T
from lodestrand.operators import planning
from lodestrand.operators.retrieve import gated_pairs
from lodestrand.plans.adapters import NOW_MS, items
from lodestrand.plans.queries import SQL_ITEMS, r6, with_vectors
from lodestrand.plans.registry import query

DAY_MS = 86_400_000


def plan_inputs(spark, sf):
    """Items of each language's world with vectors; every eleventh was fetched for the one five ids before it."""
    rows = with_vectors(spark, sf, items(spark, sf)).withColumn("attach_to", F.when(F.col("id") % 11 == 0, F.col("id") - 5))
    return rows.select(F.col("lang").alias("world"), "id", "source_id", "title", "summary", "embedding", "importance", "published_at", "covered_by", "attach_to")


@query()
def chained_plan(spark, sf):
    """The stories planned of each world's items by the whole chain: copies, events, attached items, issues, plan."""
    told = planning.planned_stories(plan_inputs(spark, sf), NOW_MS)
    return told.select("world", "kind", "position", "key", F.size("ids").cast("long").alias("members"), F.size("events").cast("long").alias("events"), F.md5(F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")).alias("ids"))


def arrivals(spark, sf):
    """plan_inputs with words, and arrival: which of five batches an item comes in."""
    rows = plan_inputs(spark, sf).withColumn("tokens", T.title_tokens(F.col("title")))
    return rows.select(*planning.FACTS, (F.floor(F.col("id") * 31 / 7) % 5).cast("int").alias("arrival"))


@query()
def story_updates_by_delta(spark, sf):
    """Stories kept up to date over five batches of items: what each is after the last, and since which batch it goes on."""
    rows, table, told = arrivals(spark, sf), None, None
    for build in range(5):
        table, _ = planning.refreshed(table, rows.where(F.col("arrival") == build))
        told = planning.kept_stories(told, table, build)
    return told.select("world", "cluster", "story", F.element_at(F.split("story", "[.]"), 2).cast("int").alias("since"), "members", "vector_n", "first_at", "last_at", "coverage")


SQL_TITLE_WORDS = "list_distinct(list_filter(string_split_regex(lower(split_part(text, chr(10), 1)), '[^a-z0-9]+'), lambda t: length(t) >= 4))"


@query(
    f"""WITH {SQL_ITEMS}, s AS (SELECT id, published_at, {SQL_TITLE_WORDS} AS w FROM items), p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.w, b.w)) AS i, len(a.w) AS n, len(b.w) AS m FROM s a JOIN s b ON a.id < b.id AND abs(a.published_at - b.published_at) <= {DAY_MS})
    SELECT a, b, round(i / (n + m - i), 6) AS similarity FROM p WHERE i > 0 AND i / (n + m - i) >= 0.5"""
)
def gated_title_pairs(spark, sf):
    """Pairs of items with like titles that were published at most a day apart."""
    rows = items(spark, sf).select("id", F.array_distinct(T.ascii_tokens(F.split("text", "\n")[0], 4)).alias("tokens"), "published_at")
    return gated_pairs(rows, "tokens", 0.5, "published_at", DAY_MS).select("a", "b", r6(F.col("similarity")).alias("similarity"))
