"""Stories from clusters of items: plans, identity, related stories, and what is told of them without a language model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrand.functions.numbers import cosine, lean_label
from lodestrand.functions.replies import clean, decode_entities
from lodestrand.functions.text import story_hash
from lodestrand.operators import aggregate
from lodestrand.operators.greedy import HOUR_MS, claims
from lodestrand.operators.ordering import first_per_key, top_per_group
from lodestrand.operators.retrieve import neighbours
from lodestrand.operators.sets import hashed, most_shared


def forced_joins(members: DataFrame) -> DataFrame:
    """world, id, cluster with attached members moved to their seed's cluster. members: world, id, cluster, attach_to.

    Destinations are those before any move; a member whose seed is missing stays where it is.
    """
    seeds = members.select("world", F.col("id").alias("attach_to"), F.col("cluster").alias("_to")).dropDuplicates(["world", "attach_to"])
    return members.join(seeds, ["world", "attach_to"], "left").select("world", "id", F.coalesce("_to", "cluster").alias("cluster"))


def rollup(members: DataFrame, keys: list[str]) -> DataFrame:
    """coverage, peak, first_at, last_at, sources of each group."""
    return members.groupBy(*keys).agg(
        aggregate.coverage(F.col("covered_by")).alias("coverage"), F.max("importance").alias("peak"), F.min("published_at").alias("first_at"),
        F.max("published_at").alias("last_at"), F.count_distinct("source_id").alias("sources"),
    )


def gates(issues: DataFrame, now_ms: int, events: int = 2, span_ms: int = 18 * HOUR_MS, coverage: int = 3, active_ms: int = 36 * HOUR_MS) -> DataFrame:
    """issues (clusters, coverage, first_at, last_at) with ok_events, ok_span, ok_sources, ok_active and developing (all four)."""
    told = issues.withColumns({
        "ok_events": F.col("clusters") >= events, "ok_span": F.col("last_at") - F.col("first_at") >= span_ms,
        "ok_sources": F.col("coverage") >= coverage, "ok_active": now_ms - F.col("last_at") <= active_ms,
    })
    return told.withColumn("developing", F.col("ok_events") & F.col("ok_span") & F.col("ok_sources") & F.col("ok_active"))


def plan(members: DataFrame, now_ms: int, most_issues: int = 6, most_stories: int = 12, least: int = 2) -> DataFrame:
    """world, kind, key, position: developing issues first, then events in the slots that are left.

    members: world, id, cluster, issue, covered_by, importance, published_at, source_id.
    """
    sized = members.groupBy("world", "issue").agg(F.count_distinct("cluster").alias("clusters"))
    issues = gates(rollup(members, ["world", "issue"]).join(sized, ["world", "issue"]), now_ms).where("developing")
    issues = top_per_group(issues, ["world"], [F.col("coverage").desc(), F.col("last_at").desc(), F.col("issue")], most_issues)
    events = rollup(members, ["world", "cluster"]).where(F.col("coverage") >= least)
    events = top_per_group(events, ["world"], [F.col("coverage").desc(), F.col("peak").desc(), F.col("last_at").desc(), F.col("cluster")], most_stories)
    used = issues.groupBy("world").agg(F.count("*").alias("used"))
    events = events.join(used, "world", "left").withColumn("used", F.coalesce("used", F.lit(0))).where(F.col("rank") <= most_stories - F.col("used"))
    first = issues.select("world", F.lit("issue").alias("kind"), F.col("issue").alias("key"), F.col("rank").cast("long").alias("position"))
    return first.unionByName(events.select("world", F.lit("event").alias("kind"), F.col("cluster").alias("key"), (F.col("used") + F.col("rank")).cast("long").alias("position")))


def match_stories(specs: DataFrame, stories: DataFrame, least: float = 0.5) -> DataFrame:
    """world, spec, story, score: which known story each planned one continues. specs: world, kind, position, spec, ids; stories: world, kind, story, ids.

    Candidates share an id; similarity divides by the lengths of the lists.
    """
    mine = specs.select("world", "kind", "position", "spec", F.size("ids").alias("_n"), F.explode(F.array_distinct("ids")).alias("_id"))
    known = stories.select("world", "kind", "story", F.size("ids").alias("_m"), F.explode(F.array_distinct("ids")).alias("_id"))
    shared = mine.join(known, ["world", "kind", "_id"]).groupBy("world", "position", "spec", "story", "_n", "_m").agg(F.count("*").alias("_shared"))
    score = F.col("_shared") / (F.col("_n") + F.col("_m") - F.col("_shared"))
    return claims(shared.select("world", "position", "spec", "story", score.alias("score")).where(F.col("score") >= least), "world")


def related(stories: DataFrame, k: int = 4) -> DataFrame:
    """story, other, score: the k nearest stories of the same world with a score over 0, ties by id.

    stories: world, story, tokens (distinct) and, where it has one, vector (its centroid). Two stories with a vector are compared by their cosine, others
    by the Jaccard of their tokens. Scores are rounded to nine places.
    """
    rows = stories.select("world", F.col("story").alias("id"), "tokens", "vector", (F.coalesce(F.size("vector"), F.lit(0)) <= 0).alias("bare"))
    near = neighbours(rows.where("not bare").select("world", "id", "vector"), "world", k).where("score > 0")
    exploded = rows.select("world", "id", "bare", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    other = exploded.select("world", F.col("id").alias("other"), F.col("bare").alias("_bare"), F.col("n").alias("m"), "token")
    shared = exploded.join(other, ["world", "token"]).where("id <> other and (bare or _bare)").groupBy("world", "id", "other", "n", "m").agg(F.count("*").alias("shared"))
    alike = shared.select("world", "id", "other", F.round(F.col("shared") / (F.col("n") + F.col("m") - F.col("shared")), 9).alias("score"))
    both = near.unionByName(alike).withColumnRenamed("id", "story")
    return top_per_group(both, ["world", "story"], [F.col("score").desc(), F.col("other")], k)


def related_items(rows: DataFrame, asks: Column, k: int = 6) -> DataFrame:
    """id, other, score: what to show beside each item for which `asks` holds, the k best, ties by id.

    rows: id, keywords, topic, vector. An item with a vector takes the nearest of those with one by cosine. One without takes what shares keywords
    or its topic: a point for each shared keyword, and one for the topic.
    """
    rows = rows.withColumn("_asks", asks).withColumn("_bare", F.coalesce(F.size("vector"), F.lit(0)) <= 0)
    near = neighbours(rows.where("not _bare").select(F.lit(0).alias("_all"), "id", "vector", "_asks"), "_all", k, F.col("_asks")).drop("_all")
    worded = rows.select("id", hashed(F.transform("keywords", F.lower)).alias("words"), "topic", "_asks", "_bare")
    scored = most_shared(worded, F.col("_asks") & F.col("_bare"), k)
    return top_per_group(near.unionByName(scored), ["id"], [F.col("score").desc(), F.col("other")], k)


def _strongest_first(*columns: Column) -> Column:
    """Members as an array of structs, by importance, then id."""
    return F.array_sort(F.collect_list(F.struct((-F.col("importance")).alias("_by"), F.col("id").alias("id"), *columns)))


def fallback_stories(members: DataFrame, story: str) -> DataFrame:
    """A story for each group of members, told by the members' own titles and summaries.

    members: story, id, title, summary, source_id, source_title, importance, published_at, topic, lean. Returns story, story_id, title,
    summary, synthesis, topic, lean, severity, source_ids (newest first), updated_at. A story's members are bounded by its cluster.
    """
    spoken = members.withColumns({"_said": clean(F.col("summary")), "_title": decode_entities(F.coalesce("title", F.lit("")))})
    told = spoken.groupBy(story).agg(
        _strongest_first(F.col("_title").alias("title"), F.col("_said").alias("said"), F.col("source_title").alias("outlet")).alias("m"),
        story_hash(F.collect_list(F.col("id").cast("string"))).alias("story_id"), aggregate.aggregate_lean(F.col("lean"), F.col("importance")).alias("lean"),
        aggregate.severity(F.col("importance"), F.col("source_id")).alias("severity"), F.max("published_at").alias("updated_at"),
        F.array_sort(F.collect_list(F.struct((-F.col("published_at")).alias("at"), F.col("id").alias("id"), "source_id"))).alias("s"),
    )
    said = F.filter("m", lambda x: x["said"] != "")
    first = F.filter(F.transform(said, lambda x, i: F.struct(x.alias("x"), (F.array_position(F.transform(said, lambda y: y["said"]), x["said"]) == i + 1).alias("new"))), lambda x: x["new"])
    lines = F.transform(first, lambda x: F.concat(x["x"]["outlet"], F.lit(": "), x["x"]["said"]))
    best = F.get("m", F.lit(0))
    told = told.select(
        story, "story_id", best["title"].alias("title"), F.coalesce(F.nullif(best["said"], F.lit("")), best["title"]).alias("summary"),
        F.when(F.size(lines) > 0, lines).otherwise(F.array(best["title"])).alias("synthesis"), "lean", "severity", F.transform("s", lambda x: x["source_id"]).alias("source_ids"), "updated_at",
    )
    topics = aggregate.majority(members, story, "topic", "id").select(F.col(story).alias("_story"), "topic")
    return told.join(topics, F.col(story).eqNullSafe(F.col("_story"))).drop("_story")


def timeline(members: DataFrame, replies: DataFrame | None = None, most: int = 10) -> DataFrame:
    """story, event, started_at, title, detail: the newest `most` events of each story by time. replies: story, event, title, detail override what isn't empty."""
    best = F.max_by(F.struct("title", "summary", "id"), F.struct("importance", (-F.col("id")).alias("i")))
    told = members.groupBy("story", "event").agg(F.min("published_at").alias("started_at"), best.alias("b"))
    told = told.select("story", "event", "started_at", decode_entities(F.col("b.title")).alias("title"), F.coalesce(F.nullif(clean(F.col("b.summary")), F.lit("")), "b.title").alias("detail"))
    if replies is not None:
        own = first_per_key(replies, ["story", "event"], [F.col("title"), F.col("detail")]).select("story", "event", F.nullif(clean(F.col("title")), F.lit("")).alias("_title"), F.nullif(clean(F.col("detail")), F.lit("")).alias("_detail"))
        told = told.join(own, ["story", "event"], "left").select("story", "event", "started_at", F.coalesce("_title", "title").alias("title"), F.coalesce("_detail", "detail").alias("detail"))
    return top_per_group(told, ["story"], [F.col("started_at").desc(), F.col("event")], most).drop("rank")


def resolve_outlets(named: DataFrame, members: DataFrame) -> DataFrame:
    """story, outlet, id: the member an outlet's name means, by the whole name, else by one name inside the other; the first wins.

    named: story, outlet; members: story, id, source_title, position.
    """
    want, title = F.lower(F.trim("outlet")), F.lower("source_title")
    met = named.where(F.trim("outlet") != "").join(members, "story").where((want == title) | F.contains(title, want) | F.contains(want, title))
    return first_per_key(met.withColumn("_exact", want == title), ["story", "outlet"], [F.col("_exact").desc(), F.col("position")]).select("story", "outlet", "id")


def fan_out(analyses: DataFrame, clones: DataFrame) -> DataFrame:
    """id and the representative's analysis for every row of clones (id, representative)."""
    return clones.join(analyses.withColumnRenamed("id", "representative"), "representative")


def deal(sources: DataFrame, budget: int, seed: int, repeat_share: float = 0.5) -> DataFrame:
    """The next batch of a registry of sources. sources: id, in_deck, seen (when it was dealt last; null if never).

    New ones come from the deck in a seeded order, which is dealt anew when it runs out; repeats are those seen longest ago;
    if they are too few, more of the deck fills the batch. Returns id, fresh. Top-k steps, so no row order passes through one task.
    """
    repeats = min(budget, int(budget * repeat_share + 0.5))
    shuffled = F.xxhash64("id", F.lit(seed))
    new = sources.orderBy(F.col("in_deck").desc(), shuffled, "id").limit(budget - repeats).select("id", F.lit(True).alias("fresh"))
    rest = sources.join(new, "id", "left_anti")
    again = rest.orderBy(F.col("seen").isNull(), F.when(F.col("seen").isNull(), ~F.col("in_deck")), "seen", shuffled, "id").limit(repeats)
    return new.unionByName(again.select("id", F.col("seen").isNull().alias("fresh")))


def assign_seeds(candidates: DataFrame, seeds: DataFrame, least_shared: int = 2, least_cosine: float = 0.5) -> DataFrame:
    """country, id, seed, score: each candidate's best seed of its country by 2 * cosine + shared / 10, if they share enough.

    candidates: country, id, tokens, vector; seeds: country, seed, position, tokens, vector, at most 40 a country.
    """
    met = candidates.join(seeds.select("country", "seed", "position", F.col("tokens").alias("_t"), F.col("vector").alias("_v")), "country")
    shared, near = F.size(F.array_intersect("tokens", "_t")), cosine(F.col("vector"), F.col("_v"))
    scored = met.withColumns({"shared": shared, "near": near}).where((F.col("shared") >= least_shared) | (F.col("near") >= least_cosine))
    scored = scored.withColumn("score", F.round(2 * F.col("near") + 0.1 * F.col("shared"), 9))
    best = F.max_by("seed", F.struct("score", (-F.col("position")).alias("p")))
    return scored.groupBy("country", "id").agg(best.alias("seed"), F.max("score").alias("score"))


def developing_stories(members: DataFrame, story: str, most: int = 10) -> DataFrame:
    """A developing story for each issue without a model: the fallback story, a little graver, with its beginning and timeline. members: as for fallback_stories and timeline."""
    base = fallback_stories(members, story).withColumn("severity", F.least(F.lit(1.0), F.col("severity") + 0.15)).withColumn("developing", F.lit(True))
    told = timeline(members, None, most)
    lines = told.groupBy("story").agg(F.array_sort(F.collect_list(F.struct("started_at", "event", "title", "detail"))).alias("timeline"))
    began = members.groupBy("story").agg(F.min("published_at").alias("started_at"))
    return base.join(lines, "story").join(began, "story")


def event_payloads(members: DataFrame, most_events: int = 10, most_outlets: int = 6, most_headlines: int = 3) -> DataFrame:
    """story, event, place, date, outlets, leans, headlines, summary: what a model is told of the newest events of a story, in time order.

    members: story, event, id, title, summary, source_title, importance, published_at, lean. An event's members are bounded by its cluster.
    """
    strongest = F.array_sort(F.collect_list(F.struct((-F.col("importance")).alias("by"), "id", "title", "summary", "source_title", lean_label(F.col("lean")).alias("lean"))))
    told = members.groupBy("story", "event").agg(F.min("published_at").alias("at"), strongest.alias("m"))
    told = top_per_group(told, ["story"], [F.col("at").desc(), F.col("event")], most_events)
    each = lambda name: F.transform("m", lambda x: x[name])
    place = F.row_number().over(Window.partitionBy("story").orderBy("at", "event")) - 1
    return told.select(
        "story", "event", place.alias("place"), F.date_format(F.timestamp_millis("at"), "yyyy-MM-dd").alias("date"), F.slice(F.array_distinct(each("source_title")), 1, most_outlets).alias("outlets"),
        F.array_distinct(each("lean")).alias("leans"), F.slice(each("title"), 1, most_headlines).alias("headlines"), F.substring(F.coalesce(F.get(each("summary"), F.lit(0)), F.lit("")), 1, 220).alias("summary"),
    )
