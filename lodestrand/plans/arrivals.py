"""Queries on rows as they arrive: streams with late rows and lives that end, a backlog drained in rounds, a pool filled from a deck."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrand.operators import drain
from lodestrand.operators.state import STATES
from lodestrand.plans.adapters import NOW_MS, items, table
from lodestrand.plans.queries import SQL_ITEMS
from lodestrand.plans.registry import query
from lodestrand.storage import shared_dir
from lodestrand.streaming import intake

DAY_US, BASE_US = 86_400_000_000, 1_704_067_200_000_000  # 2024-01-01
SQL_BATCH = f"((epoch_us(ts) + wait * 3600000000 - {BASE_US}) // {5 * DAY_US})"


def _folder(spark, name):
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _landing(rows, wait):
    """rows with batch: the five days in which each arrives, `wait` hours after its time."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) + wait * 3_600_000_000
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("batch", F.floor((at - BASE_US) / (5 * DAY_US)).cast("int"))


@query(
    f"""WITH e AS (SELECT event_id, user_id, ts, (event_id * 7) % 20 + CASE WHEN event_id % 50 = 0 THEN 100 ELSE 0 END AS wait FROM events), a AS (SELECT *, {SQL_BATCH} AS batch FROM (SELECT * FROM e UNION ALL SELECT event_id, user_id, ts, wait + 30 FROM e WHERE event_id % 3 = 0)),
    w AS (SELECT batch, max(max(epoch_us(ts)) // 1000 * 1000) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {DAY_US} AS mark FROM a GROUP BY batch)
    SELECT DISTINCT event_id, user_id FROM a JOIN w USING (batch) WHERE mark IS NULL OR epoch_us(ts) > mark"""
)
def late_events(spark, sf):
    """Events as a stream in order of arrival, some days late, a third sent twice: each once, without those behind the watermark of what had arrived before."""
    n, events = F.col("event_id"), table(spark, sf, "events").select("event_id", "user_id", "ts")
    wait = n * 7 % 20 + F.when(n % 50 == 0, 100).otherwise(0)
    arrived = _landing(events, wait).unionByName(_landing(events.where(n % 3 == 0), wait + 30))
    return intake.replayed(arrived, "batch", lambda s: intake.deduplicated(s, ["event_id"]), _folder(spark, "late")).select("event_id", "user_id")


SQL_STATE = "CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 ELSE 0 END"


@query(
    f"""WITH e AS (SELECT event_id // 4 AS id, ts, {SQL_STATE} AS place FROM events), g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY id ORDER BY ts) + INTERVAL 5 DAY THEN 0 ELSE 1 END AS new FROM e),
    s AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY ts) AS life FROM g), l AS (SELECT id, life, min(ts) AS began, max(ts) AS ended, max(place) AS place, count_if(place = 0) AS failures, max(ts) FILTER (place = 0) AS failed_at, max(ts) FILTER (place > 0) AS went_on FROM s GROUP BY ALL)
    SELECT l.id, epoch_us(began) AS began, epoch_us(ended) AS ended, CASE l.place WHEN 1 THEN 'fetched' WHEN 2 THEN 'triaged' WHEN 3 THEN 'analyzed' WHEN 4 THEN 'embedded' END AS state, CASE WHEN l.place > 0 THEN epoch_us(min(ts) FILTER (s.place = l.place)) END AS reached_at, failures,
    CASE WHEN failed_at IS NOT NULL AND (went_on IS NULL OR failed_at > went_on) THEN epoch_us(failed_at) + 3600000000 * (2 ** (failures - 1))::BIGINT END AS retry_at FROM l JOIN s ON s.id = l.id AND s.life = l.life
    WHERE epoch_us(ended) + {5 * DAY_US} <= (SELECT max(epoch_us(ts)) // 1000 * 1000 - {DAY_US} FROM events) GROUP BY l.id, l.life, began, ended, l.place, failures, failed_at, went_on"""
)
def item_lifetimes(spark, sf):
    """Four events in a row are what happened to an item; they arrive up to twenty hours late. The lives that had ended when the stream did."""
    n, events = F.col("event_id"), table(spark, sf, "events")
    state = F.element_at(F.array(*(F.lit(s) for s in ("failed", *STATES))), F.array_position(F.array(*(F.lit(x) for x in ("error", "view", "click", "signup", "purchase"))), F.col("event_type")).cast("int"))
    arrived = _landing(events.select("event_id", "ts", state.alias("state")), n * 13 % 20).select(F.expr("event_id div 4").alias("id"), "state", F.col("ts").alias("at"), "batch")
    told = intake.replayed(arrived, "batch", lambda s: intake.lifetimes(s, STATES), _folder(spark, "lives"))
    us = lambda c: F.unix_micros(c).alias(c)
    return told.select("id", us("began"), us("ended"), "state", us("reached_at"), "failures", us("retry_at"))


SQL_ORDER = "(id * 29) % 101 DESC, published_at DESC, id"


@query(
    f"""WITH {SQL_ITEMS}, b AS (SELECT id, row_number() OVER (ORDER BY {SQL_ORDER}) - 1 AS place FROM items WHERE NOT clickbait AND id % 9 = 0), n AS (SELECT count(*) // 7 + 1 AS size, count(*) // 2 AS target FROM b)
    SELECT id, (place // size)::INTEGER AS round FROM b, n WHERE place // size < ceil(target / size) AND id % 5 <> 0"""
)
def drained_backlog(spark, sf):
    """The backlog of items that aren't analysed yet, worked off in rounds of a seventh until half is done; what can't be analysed (every fifth id) is tried once."""
    n = F.col("id")
    backlog = items(spark, sf).where("not clickbait and id % 9 = 0").select("id", "published_at", (n * 29 % 101).alias("prescreen"))
    rows = backlog.count()
    done = drain.drain(backlog, "id", [F.col("prescreen").desc(), F.col("published_at").desc(), n], lambda batch: batch.where("id % 5 <> 0").select("id"), _folder(spark, "drain"), rows // 7 + 1, rows // 2)
    return done.select("id", F.col("round").cast("int").alias("round"))


@query(
    f"""WITH {SQL_ITEMS}, d AS (SELECT source_id, row_number() OVER (ORDER BY md5(coalesce(source_id, '')), source_id) - 1 AS place FROM (SELECT DISTINCT source_id FROM items)), p AS (SELECT i.id, (place // 3)::INTEGER AS round, NOT clickbait AND published_at >= {NOW_MS} - 604800000 AS servable FROM items i JOIN d ON i.source_id = d.source_id),
    c AS (SELECT round, sum(count_if(servable)) OVER (ORDER BY round) AS so_far FROM p GROUP BY round), s AS (SELECT coalesce(min(round), (SELECT max(round) FROM p)) AS last FROM c WHERE so_far >= (SELECT count(*) // 4 FROM items))
    SELECT id, round FROM p, s WHERE round <= last"""
)
def cold_filled_pool(spark, sf):
    """A pool filled from a deck of its sources, three a round, until a fourth of all items is there to be shown."""
    rows = items(spark, sf).select("id", "source_id", (~F.col("clickbait") & (F.col("published_at") >= NOW_MS - 604_800_000)).alias("servable"))
    deck = rows.select(F.col("source_id").alias("source")).distinct().withColumn("place", F.row_number().over(Window.orderBy(F.md5(F.coalesce("source", F.lit(""))), "source")) - 1)  # a registry of sources
    pulled = drain.cold_fill(deck, lambda some: rows.join(some.select("source"), F.col("source_id") == F.col("source")).drop("source"), F.col("servable"), _folder(spark, "fill"), 3, rows.count() // 4)
    return pulled.select("id", F.col("round").cast("int").alias("round"))
