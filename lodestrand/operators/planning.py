"""The chain from items to planned stories, at once or kept up to date as rows arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.functions.text import title_tokens
from lodestrand.operators import greedy, stories
from lodestrand.operators.graph import AT_ONCE, components
from lodestrand.operators.retrieve import vector_links
from lodestrand.operators.sets import hashed, word_links
from lodestrand.storage import staged

#: What of an item the folds need.
FACTS = ["world", "id", "source_id", "tokens", "embedding", "importance", "published_at", "covered_by", "attach_to"]


def without_copies(items: DataFrame) -> DataFrame:
    """The representatives of near copies, with covered_by: the sources that tell of each."""
    copies = greedy.near_clones(items).withColumnRenamed("id", "_id")
    told = items.select("id", "source_id").join(copies, F.col("id") == F.col("_id")).groupBy("representative").agg(F.count_distinct("source_id").alias("_told"))
    return items.drop("covered_by").join(told, F.col("id") == F.col("representative")).withColumnRenamed("_told", "covered_by").drop("representative")


def cluster_facts(members: DataFrame, keys: list[str]) -> DataFrame:
    """tokens, vector_sum, vector_n, coverage, first_at, last_at, members of each group: sums that can be added up.

    Vectors are summed component by component and words told apart before they are put together, so no task holds a group's rows.
    """
    of = [F.col(k).alias(f"_{k}") for k in keys]
    met = lambda other: [F.col(k).eqNullSafe(other[f"_{k}"]) for k in keys]
    parts = members.select(*of, F.posexplode("embedding").alias("_i", "_x")).groupBy(*(f"_{k}" for k in keys), "_i").agg(F.sum("_x").alias("_x"))
    sums = parts.groupBy(*(f"_{k}" for k in keys)).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda p: p["_x"]).alias("vector_sum"))
    words = members.select(*of, F.explode("tokens").alias("_w")).distinct().groupBy(*(f"_{k}" for k in keys)).agg(F.array_sort(F.collect_list("_w")).alias("tokens"))
    covered = F.sum(F.greatest(F.lit(1), F.coalesce("covered_by", F.lit(1)))).alias("coverage")
    base = members.groupBy(*keys).agg(F.count("embedding").alias("vector_n"), covered, F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at"), F.count("*").alias("members"))
    base = base.join(sums, met(sums), "left").drop(*(f"_{k}" for k in keys)).join(words, met(words), "left").drop(*(f"_{k}" for k in keys))
    return base.withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))


def planned_stories(items: DataFrame, now_ms: int, most_issues: int = 6, most_stories: int = 12, least: int = 2) -> DataFrame:
    """world, kind, position, key, ids, events: the stories that are planned of each world's items.

    items: world, id, source_id, title, summary, embedding, importance, published_at, attach_to (the item that one was fetched for; null). Copies become their
    representative, representatives are clustered to events, attached ones go to the event of their seed, events are grouped to issues, and
    of those the developing ones and then the widest events are planned. events: an issue's ids by event, earliest event first; of an event its own.
    """
    rows = without_copies(items).withColumn("tokens", title_tokens(F.col("title"))).select(*FACTS)
    rows = staged(rows)
    events = greedy.event_clusters(rows, "world")
    joined = stories.forced_joins(events.join(rows.select("world", "id", "attach_to"), ["world", "id"]))
    members = staged(rows.join(joined, ["world", "id"]))
    issues = greedy.issues(cluster_facts(members, ["world", "cluster"]), "world")
    members = staged(members.join(issues, ["world", "cluster"]))
    chosen = stories.plan(members, now_ms, most_issues, most_stories, least)
    of_issue = chosen.where("kind = 'issue'").join(members.withColumnRenamed("issue", "key"), ["world", "key"])
    of_event = chosen.where("kind = 'event'").join(members.withColumn("key", F.col("cluster")), ["world", "key"])
    told = of_issue.select("world", "kind", "position", "key", "cluster", "id", "published_at").unionByName(of_event.select("world", "kind", "position", "key", "cluster", "id", "published_at"))
    told = told.groupBy("world", "kind", "position", "key", "cluster").agg(F.min("published_at").alias("at"), F.array_sort(F.collect_list("id")).alias("ids"))  # ids of what is planned are the result
    told = told.groupBy("world", "kind", "position", "key").agg(F.array_sort(F.collect_list(F.struct("at", "cluster", "ids"))).alias("e"))
    parts = F.transform("e", lambda x: x["ids"])
    return told.select("world", "kind", "position", "key", F.array_sort(F.flatten(parts)).alias("ids"), parts.alias("events"))


def _nodes(rows: DataFrame) -> DataFrame:
    """rows with _bare (without vector) and _node: equal vectors of a world are one, and so are equal words without vector."""
    bare = F.col("embedding").isNull() | (F.size("embedding") == 0)
    rows = rows.withColumn("tokens", F.array_sort(F.array_distinct("tokens"))).withColumn("_bare", bare)
    what = F.when(~F.col("_bare"), F.xxhash64(F.lit("vector"), "embedding")).when(F.size("tokens") > 0, F.xxhash64(F.lit("words"), "tokens")).otherwise(F.xxhash64(F.lit("row"), "id"))
    return rows.withColumn("_node", F.xxhash64("world", what))


def _new_links(rows: DataFrame, cosine: float, text: float) -> DataFrame:
    """u, v: the links of greedy.event_groups with a row that is _fresh, over all time."""
    vectors = rows.where("not _bare").groupBy("world", F.col("_node").alias("id")).agg(F.first("embedding").alias("vector"), F.max("_fresh").alias("_fresh"))
    worded = rows.where("size(tokens) > 0").groupBy("world", F.col("_node").alias("id"), F.col("_bare").alias("bare"), F.xxhash64("tokens").alias("_key")).agg(F.first(hashed("tokens")).alias("words"), F.max("_fresh").alias("_fresh"))
    return vector_links(vectors, "world", cosine * cosine, F.col("_fresh")).unionByName(word_links(worded, "world", text, F.col("_fresh")))


def refreshed(known: DataFrame | None, delta: DataFrame, cosine: float = 0.82, text: float = 0.3, window_ms: int = 3 * greedy.DAY_MS) -> tuple[DataFrame, int]:
    """The table of clustered items after a delta, and how many of its rows were folded anew. The table is what clustering all rows at once would give.

    known: the table that the last call gave (None: nothing yet). delta: FACTS, with ids that aren't in it. The table has them with cluster and
    _root, the component of links that the row is in. Links of known rows never change, so only components that a new row links to are folded
    again, with all their rows; the others, and their clusters, are taken over. Links of new rows are looked for among all nodes (distinct vectors, distinct words).
    """
    fresh = _nodes(delta.select(*FACTS)).withColumn("_fresh", F.lit(True))
    rows = fresh if known is None else fresh.unionByName(known.select(*FACTS, "_bare", "_node").withColumn("_fresh", F.lit(False)))
    links = staged(_new_links(rows, cosine, text))
    nodes = fresh.select(F.col("_node").alias("node")).distinct()
    if known is not None:  # what a linked or repeated known node stands for: its component
        ends = links.select(F.col("u").alias("node")).unionByName(links.select(F.col("v").alias("node"))).unionByName(nodes).distinct()
        old = known.select("_node", "_root").distinct().join(ends, F.col("_node") == F.col("node"), "left_semi")
        links = links.unionByName(old.select(F.col("_node").alias("u"), F.col("_root").alias("v")))
    roots = staged(components(links, at_once=AT_ONCE).select(F.col("node").alias("_linked"), F.col("root").alias("_least")))
    again = fresh.drop("_fresh").withColumn("_by", F.col("_node"))
    if known is not None:
        reached = roots.select(F.col("_linked").alias("_reached")).unionByName(nodes.select(F.col("node").alias("_reached"))).distinct()
        touched = F.col("_root") == F.col("_reached")
        again = again.unionByName(known.join(reached, touched, "left_semi").select(*FACTS, "_bare", "_node", F.col("_root").alias("_by")))
        rest = known.join(reached, touched, "left_anti")
    again = staged(again.join(roots, F.col("_by") == F.col("_linked"), "left").withColumn("_root", F.coalesce("_least", "_by")).drop("_linked", "_least", "_by"))
    folded = again.join(greedy.folded_events(again, "world", cosine, text, window_ms), ["world", "id"])
    table = folded.select(*FACTS, "_bare", "_node", "_root", "cluster")
    if known is not None:
        table = table.unionByName(rest.select(*table.columns))
    return staged(table), again.count()


def kept_stories(known: DataFrame | None, clustered: DataFrame, build: int, least: float = 0.5) -> DataFrame:
    """world, story, cluster, ids and the sums of each cluster (cluster_facts); a cluster goes on as the known story that it shares most members with.

    known: world, story, ids of the last call (None: none). A new story is named by its cluster and the build; a story that no cluster continues is gone.
    """
    facts = cluster_facts(clustered, ["world", "cluster"])
    ids = clustered.groupBy(F.col("world").alias("_w"), F.col("cluster").alias("_c")).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    now = facts.join(ids, F.col("world").eqNullSafe(F.col("_w")) & (F.col("cluster") == F.col("_c"))).drop("_w", "_c")
    name = F.concat(F.lit("s"), F.col("cluster").cast("string"), F.lit(f".{build}"))
    if known is None:
        return staged(now.withColumn("story", name))
    now = staged(now)
    specs = now.select("world", F.lit("event").alias("kind"), F.col("cluster").alias("position"), F.col("cluster").alias("spec"), "ids")
    matched = stories.match_stories(specs, known.select("world", F.lit("event").alias("kind"), "story", "ids"), least)
    went_on = matched.select(F.col("world").alias("_w"), F.col("spec").alias("_c"), F.col("story").alias("_s"))
    told = now.join(went_on, F.col("world").eqNullSafe(F.col("_w")) & (F.col("cluster") == F.col("_c")), "left")
    return staged(told.withColumn("story", F.coalesce("_s", name)).drop("_w", "_c", "_s"))
