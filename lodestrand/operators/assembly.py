"""From stored rows to what a reader is shown: eligibility, the pooled corpus, candidates of a question, views and feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrand.functions.numbers import DAY_MS, HOUR_MS, base_score, cosine
from lodestrand.functions.reading import relevance
from lodestrand.functions.replies import decode_entities
from lodestrand.operators.greedy import near_clones, rank_items
from lodestrand.operators.ordering import first_per_key, interleave_by_provider, recency_bucket, top_per_group
from lodestrand.operators.retrieve import lexical_rank

FRONT = "front"


def is_geo(pool: Column) -> Column:
    return F.startswith(pool, F.lit("geo-")) & (F.length(pool) > 4)


def is_place(pool: Column) -> Column:
    return pool.rlike("^place-[a-z]{2}$")


def pool_node(pool: Column) -> Column:
    """The node of a geographic pool, the country of a regional one; null for others."""
    return F.when(is_geo(pool), F.substring(pool, F.lit(5), F.length(pool))).when(is_place(pool), F.substring(pool, 7, 2))


def settled(row_analyzed: bool = True) -> Column:
    """No clickbait, no clone, and analysed (or not yet)."""
    return ~F.col("clickbait") & F.col("clone_of").isNull() & (F.col("analyzed") if row_analyzed else ~F.col("analyzed"))


def eligible(stored: DataFrame, now_ms: int, retention_ms: int = 14 * DAY_MS) -> DataFrame:
    """What a pool's feed may show: settled, within retention, and in a regional pool not judged global."""
    return stored.where(settled() & (F.lit(now_ms) - F.col("published_at") <= retention_ms) & ~(is_place(F.col("pool")) & F.coalesce("global", F.lit(False))))


def story_eligible(stored: DataFrame, pool: str, now_ms: int, window_ms: int = 10 * DAY_MS) -> DataFrame:
    """What a pool's stories are made of. The front pool draws on every geographic and regional pool, each id once (the front's own row first)."""
    rows = stored.where(settled() & (F.lit(now_ms) - F.col("published_at") <= window_ms))
    if pool != FRONT:
        return rows.where(F.col("pool") == pool)
    rows = rows.where((F.col("pool") == FRONT) | is_geo(F.col("pool")) | is_place(F.col("pool")))
    return first_per_key(rows, ["id"], [F.col("pool") != FRONT, F.col("pool")])


def corpus(stored: DataFrame, most: int = 6000) -> DataFrame:
    """The newest settled rows of all pools, each id once (the front's own row first)."""
    rows = first_per_key(stored.where(settled()), ["id"], [F.col("pool") != FRONT, F.col("pool")])
    return rows.orderBy(F.col("published_at").desc(), "id").limit(most)


def candidates(rows: DataFrame, text: str, query: str, vector: list[float] | None, most: int = 150) -> DataFrame:
    """id, turn: words and vectors in turn, then the newest, each id once. rows: id, published_at, embedding and the text."""
    newest = [F.col("published_at").desc(), F.col("id")]
    place = lambda df, order: df.select("id", F.row_number().over(Window.orderBy(*order)).alias("rank"))  # noqa: E731  of `most` rows
    words = place(lexical_rank(rows, text, query, most, newest), [F.col("hits").desc(), *newest])
    turns = words.select("id", (F.col("rank") * 2).alias("turn"))
    if vector:
        scored = rows.where(F.size("embedding") > 0).withColumn("score", F.round(cosine(F.col("embedding"), F.array(*(F.lit(float(x)) for x in vector))), 9))
        order = [F.col("score").desc(), *newest]
        turns = turns.unionByName(place(scored.orderBy(*order).limit(most), order).select("id", (F.col("rank") * 2 + 1).alias("turn")))
    late = place(rows.orderBy(*newest).limit(most), newest).select("id", (F.col("rank") + 2 * most + 2).alias("turn"))
    return first_per_key(turns.unionByName(late), ["id"], [F.col("turn")]).orderBy("turn").limit(most)


def feed_items(rows: DataFrame, match: Column | None, provisional: bool = False) -> DataFrame:
    """Stored rows as items of a feed: entities decoded, relevance to an interest (match, if there is one), provenance, coverage by more than one outlet only."""
    more = F.when(F.col("covered_by") > 1, F.col("covered_by"))
    return rows.select(
        "id", "pool", "source_id", decode_entities(F.coalesce("title", F.lit(""))).alias("title"), decode_entities(F.col("summary")).alias("summary"), "topic", "lean",
        F.coalesce("lean_source", F.lit("source")).alias("lean_source"), relevance(F.col("importance"), match, F.lit(provisional), F.col("prescreen")).alias("relevance"), "published_at",
        more.alias("covered_by"), F.lit("provisional" if provisional else "analyzed").alias("enrichment"),
    )


def backlog(rows: DataFrame, now_ms: int, group: str = "pool", width_ms: int = 2 * HOUR_MS) -> DataFrame:
    """rows with bucket, turn: freshest bucket first, in it every provider's best, then second best. Sort by (bucket, turn, weight desc, newest, id)."""
    rows = rows.withColumn("weight", F.coalesce("prescreen", F.lit(0.5)))
    bucket = F.struct(F.col(group).alias("group"), recency_bucket(F.col("published_at"), now_ms, width_ms).alias("at"))
    told = interleave_by_provider(rows, "source_id", [F.col("weight").desc(), F.col("published_at").desc(), F.col("id")], bucket)
    return told.withColumn("bucket", F.col("bucket.at"))


def provisional(stored: DataFrame, now_ms: int, most: int = 120, retention_ms: int = 14 * DAY_MS) -> DataFrame:
    """The first `most` rows of each pool's backlog that analysis hasn't reached, with position."""
    rows = stored.where(settled(False) & (F.lit(now_ms) - F.col("published_at") <= retention_ms) & ~(is_place(F.col("pool")) & F.coalesce("global", F.lit(False))))
    order = ["bucket", "turn", F.col("weight").desc(), F.col("published_at").desc(), "id"]
    told = backlog(rows, now_ms).withColumn("position", F.row_number().over(Window.partitionBy("pool").orderBy(*order)))
    return told.where(F.col("position") <= most)


def view(stored: DataFrame, now_ms: int, match=None, limit: int = 200, most_provisional: int = 120) -> DataFrame:
    """pool, segment, position, id: what is analysed, diversified, and strictly below it the provisional rows, diversified too.

    match: a function that adds a column `match` (a reader's interest) to rows, or none.
    """
    found = []
    for segment, rows, early in ((0, eligible(stored, now_ms), False), (1, provisional(stored, now_ms, most_provisional).drop("position"), True)):
        rows = rows if match is None else match(rows)
        told = feed_items(rows.withColumn("lean_source", F.lit(None).cast("string")) if "lean_source" not in rows.columns else rows, None if match is None else F.col("match"), early)
        told = told.withColumn("base", F.round(base_score(F.col("relevance"), F.col("published_at"), now_ms), 9))
        ranked = rank_items(told, "pool", limit if not early else most_provisional)
        found.append(ranked.select("pool", F.lit(segment).alias("segment"), "position", "id"))
    return found[0].unionByName(found[1])


def feed_candidates(items: DataFrame, completed: DataFrame, topics: list, kinds: list, now_ms: int, age_ms: int = 14 * DAY_MS) -> DataFrame:
    """items with `read` (whether completed): enabled topic and kind, not of the future, not too old, each id once. Fresh ones enter a feed, read ones are shown after it."""
    rows = items.where(F.col("topic").isin(topics) & F.col("kind").isin(kinds) & (F.col("published_at") <= now_ms) & (F.lit(now_ms) - F.col("published_at") <= age_ms))
    once = first_per_key(rows, ["id"], [F.col("relevance").desc(), F.col("published_at").desc()])
    done = completed.select(F.col("id").alias("_id")).distinct()
    return once.join(done, F.col("id") == F.col("_id"), "left").withColumn("read", F.col("_id").isNotNull()).drop("_id")


def political_reason(side: Column, need: Column, topic: Column, drifting: Column) -> Column:
    """Why a political item is shown: a counterweight only where its side is the needed one. side, need: left, right, center."""
    view_ = F.concat(side, F.lit("-leaning"))
    counter = F.when(drifting, F.concat(F.lit("Counterweight — a "), view_, F.lit(" view to balance your day"))).otherwise(F.concat(F.lit("Balancing perspectives — a "), view_, F.lit(" take on "), topic))
    return F.when(side == "center", F.concat(F.lit("A center take on "), topic)).when(side == need, counter).otherwise(F.concat(F.lit("A "), view_, F.lit(" take on "), topic))


def analysis_plan(stored: DataFrame, now_ms: int, keep: int = 200, age_ms: int = DAY_MS) -> DataFrame:
    """representative, members, sources, weight, published_at: of the `keep` strongest clusters of near copies, those with rows yet to be analysed.

    stored: one pool. Clusters are of what is in the window and no clickbait, ranked by their representative's weight, newest, id.
    """
    rows = stored.where(~F.col("clickbait") & (F.col("published_at") >= now_ms - age_ms)).withColumn("importance", F.coalesce("prescreen", F.lit(0.5)))
    members = near_clones(rows).join(rows.select("id", "source_id", "analyzed"), "id")
    rolled = members.groupBy("representative").agg(F.count("*").alias("members"), F.count_distinct("source_id").alias("sources"), F.bool_and("analyzed").alias("done"))
    told = rolled.join(rows.select(F.col("id").alias("representative"), F.col("importance").alias("weight"), "published_at"), "representative")
    return told.orderBy(F.col("weight").desc(), F.col("published_at").desc(), "representative").limit(keep).where("not done").drop("done")


def seeds(stored: DataFrame, now_ms: int, most: int = 40, least: float = 0.55, age_ms: int = 3 * DAY_MS) -> DataFrame:
    """The strongest fresh representatives without a zone: what side coverage is searched for."""
    rows = stored.where(settled() & F.col("zone").isNull() & (F.col("importance") >= least) & (F.lit(now_ms) - F.col("published_at") <= age_ms))
    return rows.orderBy(F.col("importance").desc(), F.col("published_at").desc(), "id").limit(most)


def involved(rows: DataFrame, tokens: Column) -> DataFrame:
    """country, score, tokens, vectors: how many of the rows name each country, their words, and how many of them have a vector."""
    told = rows.withColumn("_tokens", tokens).withColumn("country", F.explode("countries"))
    return told.groupBy("country").agg(F.count("*").alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_tokens")))).alias("tokens"), F.count_if(F.size("embedding") > 0).alias("vectors"))


def pick_video(hits: DataFrame, sources: DataFrame, least_cosine: float = 0.5, least_shared: int = 2) -> DataFrame:
    """source, video, score: each source's most fitting hit, by cosine where the source has a vector, else by shared words; none below the least.

    hits: source, video, position, tokens, vector (a search's few hits); sources: source, tokens, vector.
    """
    met = hits.join(sources.select("source", F.col("tokens").alias("_t"), F.col("vector").alias("_v")), "source")
    near = F.when(F.size("vector") > 0, F.round(cosine(F.col("vector"), F.col("_v")), 9))
    shared = F.size(F.filter("tokens", lambda t: F.array_contains(F.col("_t"), t))).cast("double")
    by_vector = F.coalesce(F.size("_v"), F.lit(0)) > 0
    told = met.withColumns({"score": F.when(by_vector, near).otherwise(shared), "least": F.when(by_vector, least_cosine).otherwise(float(least_shared))})
    return first_per_key(told.where("score is not null"), ["source"], [F.col("score").desc(), F.col("position")]).where("score >= least").select("source", "video", "score")


def pool_sources(pools: DataFrame, nodes: DataFrame, outlets: DataFrame, curated: DataFrame, default: str = "frontpage", most: int = 6) -> DataFrame:
    """pool, source: what each pool draws on.

    A geographic pool takes the outlets of its node: of a country, of a country's region, or of a continent's countries (the first `most` of each). A regional
    pool takes those of its country, any other the curated sources of the world of its name, or of the default one. Unknown nodes have none.
    pools: pool; nodes: node, parent, level, cc, region; outlets: cc, region, source, position; curated: world, source.
    """
    told = pools.select("pool", is_geo(F.col("pool")).alias("geo"), F.when(is_geo(F.col("pool")), F.substring("pool", F.lit(5), F.length("pool"))).alias("node"), F.when(F.startswith("pool", F.lit("place-")), F.substring("pool", F.lit(7), F.length("pool"))).alias("of"))
    here = nodes.where("level <> 'continent'").select("node", "cc", F.col("region").alias("_region"))
    by_node = told.where("geo").join(here, "node").join(outlets, "cc").where("_region is null or region = _region").select("pool", "source")
    first = top_per_group(outlets, ["cc"], [F.col("position")], most).select("cc", "source")
    countries = nodes.where("level = 'country'").select(F.col("parent").alias("node"), "cc")
    by_continent = told.where("geo").join(nodes.where("level = 'continent'").select("node"), "node").join(countries, "node").join(first, "cc").select("pool", "source")
    known = outlets.select(F.col("cc").alias("of")).unionByName(nodes.where("cc is not null").select(F.col("cc").alias("of"))).distinct()
    regional = told.where("not geo").join(known, "of", "left_semi")
    by_country = regional.join(outlets.withColumnRenamed("cc", "of"), "of").select("pool", "source")
    topical = told.where("not geo").select("pool").join(regional.select("pool"), "pool", "left_anti")
    worlds = curated.select(F.col("world").alias("_world")).distinct()
    named = topical.join(worlds, F.col("pool") == F.col("_world"), "left").select("pool", F.coalesce("_world", F.lit(default)).alias("world"))
    return by_node.unionByName(by_continent).unionByName(by_country).unionByName(named.join(curated, "world").select("pool", "source"))


#: A topic's name and colour, in the order in which topics are shown; what an unknown one looks like.
TOPIC_LOOKS = {
    "world": ("World", "#6EA8FE"), "politics": ("Politics", "#E0A94B"), "economics": ("Economics", "#5BD6A6"), "technology": ("Technology", "#56C2D6"),
    "science": ("Science", "#9B8CFF"), "health": ("Health", "#E08AA8"), "history": ("History", "#C9A06B"), "culture": ("Culture", "#D98C5F"),
}
UNKNOWN_COLOR = "#9AA4B2"


def topic_shelf(items: DataFrame) -> DataFrame:
    """topic, label, color, n, position: the topics that items have, in the order in which they are shown, unknown ones last by name. items: topic."""
    look = lambda i: F.element_at(F.create_map(*(F.lit(x) for k, v in TOPIC_LOOKS.items() for x in (k, v[i]))), F.col("topic"))
    place = F.array_position(F.array(*(F.lit(k) for k in TOPIC_LOOKS)), F.col("topic"))
    counted = items.groupBy("topic").agg(F.count("*").alias("n"))
    order = Window.orderBy(F.when(place > 0, place).asc_nulls_last(), "topic")  # a row for each topic
    return counted.select("topic", F.coalesce(look(0), "topic").alias("label"), F.coalesce(look(1), F.lit(UNKNOWN_COLOR)).alias("color"), "n", F.row_number().over(order).cast("long").alias("position"))


def marked_global(stored: DataFrame, named: DataFrame, now_ms: int, window_ms: int = 7 * DAY_MS) -> DataFrame:
    """stored with `global` filled in where it was asked for: analysed rows of regional pools, no clickbait, within the window, that have no mark yet.

    named: pool, id of the rows that were judged global; what was asked about and isn't named is local. asked tells which rows changed.
    """
    asked = is_place(F.col("pool")) & F.col("analyzed") & ~F.col("clickbait") & F.col("global").isNull() & (F.col("published_at") >= now_ms - window_ms)
    told = named.select("pool", "id").distinct().withColumn("_named", F.lit(True))
    rows = stored.join(told, ["pool", "id"], "left").withColumn("asked", asked)
    return rows.withColumn("global", F.when(F.col("asked"), F.coalesce("_named", F.lit(False))).otherwise(F.col("global"))).drop("_named")
