"""State tables: entries that expire, stories that go on under one id, registries of sources, and what analysis did to an item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrand.functions.text import slug
from lodestrand.operators.ordering import first_per_key, upsert

#: The states of an item, in order.
STATES = ("fetched", "triaged", "analyzed", "embedded")


def unexpired(entries: DataFrame, at: str, now_ms: int, ttl_ms: int) -> DataFrame:
    """Entries that are no older than their time to live."""
    return entries.where(F.lit(now_ms) - F.col(at) <= ttl_ms)


def save_entries(kept: DataFrame, fresh: DataFrame, key: str, at: str, now_ms: int, ttl_ms: int) -> DataFrame:
    """The table of entries after a save: the newest of each key, none that has expired."""
    return unexpired(upsert(kept, fresh, key, at), at, now_ms, ttl_ms)


def save_stories(kept: DataFrame, built: DataFrame, now_ms: int, retention_ms: int) -> DataFrame:
    """world, story, updated_at, ...: a build's stories under the id they continue (`continues`, else their own), and older ones within retention."""
    named = built.withColumn("story", F.coalesce("continues", "story")).drop("continues")
    named = first_per_key(named, ["world", "story"], [F.col("updated_at").desc()])
    old = kept.join(named.select("world", "story"), ["world", "story"], "left_anti").where(F.lit(now_ms) - F.col("updated_at") <= retention_ms)
    return named.unionByName(old)


def registry(found: DataFrame) -> DataFrame:
    """cc, id, title, url: the working feeds of each country, each URL once; ids from the title, the second of a name with -2. found: cc, position, title, url, ok."""
    once = first_per_key(found.where("ok and url is not null"), ["cc", "url"], [F.col("position")])
    base = F.concat("cc", F.lit("-"), slug(F.col("title"), 40, "src"))
    place = F.row_number().over(Window.partitionBy("cc", "_base").orderBy("position"))
    told = once.withColumn("_base", base).withColumn("_n", place)
    return told.select("cc", F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("-"), F.col("_n").cast("string"))).alias("id"), "title", "url")


def advance(items: DataFrame, events: DataFrame) -> DataFrame:
    """id, state, at: each item in the farthest state that it or an event reached, and when it first did; states don't go back. Both: id, state, at."""
    place = F.array_position(F.array(*(F.lit(s) for s in STATES)), F.col("state"))
    both = items.select("id", "state", "at").unionByName(events.select("id", "state", "at")).where(F.col("state").isin(*STATES))
    return first_per_key(both, ["id"], [place.desc(), F.col("at")])


def matched_replies(asked: DataFrame, replies: DataFrame) -> DataFrame:
    """batch, position, id, and the reply's columns: a reply belongs to the id that it names, or, where it names none of its batch, to the row at its place.

    asked: batch, position, id; replies: batch, position, said_id and others. A later reply to one id overwrites an earlier one.
    """
    others = [c for c in replies.columns if c not in ("batch", "position", "said_id")]
    told = replies.select("batch", F.col("position").alias("_at"), "said_id", *others)
    named = asked.join(told, (asked["batch"] == told["batch"]) & (asked["id"] == told["said_id"])).select(asked["batch"], asked["position"], "id", "_at", *others)
    known = asked.select(F.col("batch").alias("_b"), F.col("id").alias("_i"))
    lost = told.join(known, (told["batch"] == known["_b"]) & (told["said_id"] == known["_i"]), "left_anti")
    placed = asked.join(lost, (asked["batch"] == lost["batch"]) & (asked["position"] == lost["_at"])).select(asked["batch"], asked["position"], "id", "_at", *others)
    return first_per_key(named.unionByName(placed), ["batch", "id"], [F.col("_at").desc()]).drop("_at")


def analysed(items: DataFrame, refine: bool = True) -> DataFrame:
    """items with what their analysis (a struct `a`; null: none) makes of them: topic, lean and its source and reason, importance, coverage.

    items: lean, a, source_rationale, covered (outlets of its cluster), covered_by. A lean counts as refined only if the analysis gave one.
    """
    done = F.col("a").isNotNull()
    refined = done & F.lit(refine) & F.col("a.lean_refined") & F.col("a.lean").isNotNull()
    lean = F.when(refined, F.col("a.lean")).otherwise(F.col("lean"))
    reason = F.when(lean.isNotNull(), F.when(refined, F.coalesce(F.nullif(F.col("a.rationale"), F.lit("")), "source_rationale")).otherwise(F.col("source_rationale")))
    return items.withColumns({
        "analyzed": done, "lean_rationale": reason, "lean_source": F.when(refined, "llm").otherwise("source"), "topic": F.coalesce("a.topic", "topic"),
        "importance": F.coalesce("a.importance", F.lit(0.0)), "covered_by": F.when(F.col("covered") > 1, F.col("covered")).otherwise(F.col("covered_by")), "lean": lean,
    })


def in_chunks(rows: DataFrame, group: str, order: list[Column], size: int) -> DataFrame:
    """rows with chunk: batches of `size` in order, in each group."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("chunk", F.floor((place - 1) / max(1, size)).cast("long"))


def in_id_order(lists: DataFrame, items: DataFrame) -> DataFrame:
    """key, position, and the item's columns: lists of ids (key, ids) as rows in order; ids that no item has are dropped."""
    return lists.select("key", F.posexplode("ids").alias("position", "id")).join(items, "id")
