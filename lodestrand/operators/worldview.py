"""Stories as markers and arcs of a globe: alerts, what stacks at one place, layers and their legends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.operators.ordering import first_per_key

#: Categories of events in the order of the legend.
CATEGORY_ORDER = ("conflict", "unrest", "diplomacy", "health", "tech", "disaster", "economy", "other")
#: How far back each lens looks, in milliseconds.
LENSES = {"now": 21_600_000, "day": 86_400_000, "week": 604_800_000}


def alerts(stories: DataFrame, places: DataFrame, least: float = 0.0, most: int | None = None) -> DataFrame:
    """Stories that have a place, strongest first: the nation of the protagonist (with its flag), else where it happens (without).

    stories: story, severity (null: 0.5), protagonist, located, category (blank: none), guessed, and others; places: iso2, x, y, z (one row a country).
    """
    rows = stories.withColumn("severity", F.coalesce("severity", F.lit(0.5))).where(F.col("severity") >= least)
    at = lambda name: places.select(F.col("iso2").alias(f"_{name}"), F.struct("x", "y", "z").alias(f"_at_{name}"))
    rows = rows.join(at("protagonist"), F.col("protagonist") == F.col("_protagonist"), "left").join(at("located"), F.col("located") == F.col("_located"), "left")
    rows = rows.withColumns({"at": F.coalesce("_at_protagonist", "_at_located"), "flag": F.col("_protagonist"), "category": F.coalesce(F.nullif(F.trim("category"), F.lit("")), "guessed")})
    rows = rows.where("at is not null").drop("_protagonist", "_at_protagonist", "_located", "_at_located").orderBy(F.col("severity").desc(), "story")
    return rows if most is None else rows.limit(most)


def stacked(found: DataFrame, most: int = 40) -> DataFrame:
    """What lies at one place (to two decimals) as one row under its strongest: n, stories, updated_at, developing; the strongest `most` places."""
    key = F.concat_ws("|", *(F.format_string("%.2f", F.round(F.col(f"at.{c}"), 2) + 0.0) for c in "xyz"))
    order = F.struct((-F.col("severity")).alias("by"), F.col("story").alias("story"))
    told = found.groupBy(key.alias("place")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(order)).alias("s"), F.max("updated_at").alias("updated_at"), F.bool_or("developing").alias("developing"))
    told = told.select("place", "n", (-F.get("s", F.lit(0))["by"]).alias("severity"), F.get("s", F.lit(0))["story"].alias("story"), F.transform("s", lambda x: x["story"]).alias("stories"), "updated_at", "developing")
    return told.orderBy(F.col("severity").desc(), "story").limit(most)


def legend(found: DataFrame, kind: str, order: tuple[str, ...] = CATEGORY_ORDER) -> DataFrame:
    """The distinct kinds that are shown, known ones in their order, then the others by label, with position."""
    place = F.array_position(F.array(*(F.lit(x) for x in order)), F.col(kind))
    label = F.initcap(F.translate(F.col(kind), "-", " "))
    told = found.select(kind).where(F.col(kind).isNotNull()).distinct().withColumns({"label": label, "_by": F.when(place > 0, place).otherwise(999)})
    return told.orderBy("_by", "label", kind).drop("_by")


def within(updated_at: Column, lens: str, now_ms: int) -> Column:
    return F.lit(now_ms) - updated_at <= LENSES[lens]


def link_layer(stories: DataFrame, links: DataFrame, places: DataFrame, now_ms: int, lens: str = "week", most_stories: int = 10, most: int = 20) -> DataFrame:
    """story, at, from, to, kind: the links of the strongest stories in the lens whose ends both have a place and aren't one.

    stories: story, severity, updated_at; links: story, at, from, to, kind; places: iso2, x, y, z.
    """
    rows = stories.join(links.select("story").distinct(), "story", "left_semi").where(within(F.col("updated_at"), lens, now_ms))
    rows = rows.orderBy(F.coalesce("severity", F.lit(0.0)).desc(), "story").limit(most_stories)
    end = lambda name: places.select(F.col("iso2").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in "xyz"))
    told = links.join(F.broadcast(rows.select("story", F.coalesce("severity", F.lit(0.0)).alias("severity"))), "story").join(end("from"), "from").join(end("to"), "to")  # most_stories rows
    told = told.where(sum(F.col(f"from_{c}") * F.col(f"to_{c}") for c in "xyz") <= 0.9999)
    return told.orderBy(F.col("severity").desc(), "story", "at").limit(most).select("story", "at", "from", "to", "kind")


def gathering_layer(stories: DataFrame, gatherings: DataFrame, now_ms: int, lens: str = "week", most_stories: int = 12, most: int = 14) -> DataFrame:
    """story, at, kind: the gatherings of the strongest stories in the lens, the first at each point (to two decimals). gatherings: story, at, kind, x, y, z (null: no place)."""
    rows = stories.join(gatherings.select("story").distinct(), "story", "left_semi").where(within(F.col("updated_at"), lens, now_ms))
    rows = rows.select("story", F.coalesce("severity", F.lit(0.0)).alias("severity")).orderBy(F.col("severity").desc(), "story").limit(most_stories)
    order = [F.col("severity").desc(), F.col("story"), F.col("at")]
    told = gatherings.where("x is not null").join(F.broadcast(rows), "story").withColumns({f"_{c}": F.round(c, 2) + 0.0 for c in "xyz"})  # most_stories rows
    return first_per_key(told, ["_x", "_y", "_z"], order).orderBy(*order).limit(most).select("story", "at", "kind")


def visible(layer: DataFrame, kind: str, hidden: list[str], answered: bool = False) -> DataFrame:
    """A layer without the kinds that are switched off; empty while an answer shows its own places."""
    return layer.where(~F.col(kind).isin(hidden) if hidden else F.lit(True)).where(F.lit(not answered))


def story_list(stories: DataFrame, most: int = 12) -> DataFrame:
    """Developing stories first, then the newest."""
    return stories.orderBy(F.col("developing").desc(), F.col("updated_at").desc(), "story").limit(most)


def ongoing(stories: DataFrame, late: DataFrame, feed: DataFrame | None, members: DataFrame, topic=None, most: int = 12) -> DataFrame:
    """Developing stories that aren't told as last-minute already, of a topic if one is chosen, and with a member in the feed if one is searched. late: story; feed: id; members: story, id."""
    rows = stories.where("developing").join(late.select("story"), "story", "left_anti")
    rows = rows if topic is None else rows.where(F.col("topic") == topic)
    rows = rows if feed is None else rows.join(members.join(feed.select("id"), "id", "left_semi").select("story").distinct(), "story", "left_semi")
    return rows.orderBy(F.col("updated_at").desc(), "story").limit(most)


def story_scores(members: DataFrame, floor: float = 0.5) -> DataFrame:
    """story, score: the most relevant member's relevance, the floor at least. members: story, relevance."""
    return members.groupBy("story").agg(F.greatest(F.lit(floor), F.max(F.coalesce("relevance", F.lit(floor)))).alias("score"))


def thumbnails(members: DataFrame) -> DataFrame:
    """story, thumbnail: the image of the strongest member that has a web address for one."""
    rows = members.where(F.col("thumbnail").rlike("(?i)^https?://"))
    return rows.groupBy("story").agg(F.max_by("thumbnail", F.struct("importance", (-F.col("id")).alias("i"))).alias("thumbnail"))


def country_votes(members: DataFrame, sides: DataFrame, protagonists: DataFrame) -> DataFrame:
    """story, country, votes: what a story's members name, its sides' zones and its protagonist. members: story, countries; sides: story, zone; protagonists: story, iso2."""
    votes = members.select("story", F.explode("countries").alias("country")).unionByName(sides.select("story", F.col("zone").alias("country"))).unionByName(protagonists.select("story", F.col("iso2").alias("country")))
    return votes.where(F.col("country").rlike("^[a-z]{2}$")).groupBy("story", "country").agg(F.count("*").alias("votes"))
