"""Queries on readers, states of items and the layers of the globe. Twelve documents in a row are a story, nations are the countries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrand.functions import numbers as N
from lodestrand.operators import reader, state
from lodestrand.operators import worldview as W
from lodestrand.operators.places import paths
from lodestrand.plans.adapters import NOW_MS, geo_nodes, items, stored, table
from lodestrand.plans.assembly import SQL_STORED
from lodestrand.plans.queries import SQL_GEO, SQL_ITEMS, r6
from lodestrand.plans.registry import query

SQL_DONE = "done AS (SELECT user_id, event_id % 300 AS item, event_id AS made, value AS minutes, CASE WHEN event_id % 5 = 1 THEN 0.0 WHEN event_id % 5 <> 0 THEN ((event_id * 37) % 201)::DOUBLE / 100 - 1 END AS lean FROM events)"


def _done(spark, sf):
    n = F.col("event_id")
    lean = F.when(n % 5 == 1, 0.0).when(n % 5 != 0, (n * 37) % 201 / 100.0 - 1)
    return table(spark, sf, "events").select("user_id", (n % 300).alias("item"), n.alias("at"), F.col("value").alias("minutes"), lean.alias("lean"))


SQL_FOLD = f"""{SQL_DONE}, once AS (SELECT * FROM done QUALIFY row_number() OVER (PARTITION BY user_id, item ORDER BY made) = 1), f AS (SELECT user_id, sum(minutes) AS consumed, coalesce(sum(lean * minutes), 0) AS w, coalesce(sum(minutes) FILTER (lean IS NOT NULL), 0) AS m,
    coalesce(sum(CASE WHEN lean < 0 THEN minutes WHEN lean = 0 THEN minutes / 2 END), 0) AS l, coalesce(sum(CASE WHEN lean > 0 THEN minutes WHEN lean = 0 THEN minutes / 2 END), 0) AS r FROM once GROUP BY user_id)"""


@query(f"WITH {SQL_FOLD} SELECT user_id, round(consumed, 4) AS consumed, round(w, 4) AS lean_weight, round(m, 4) AS lean_minutes, round(l, 4) AS left_minutes, round(r, 4) AS right_minutes FROM f")
def reader_tally(spark, sf):
    """Each reader's tally of completed items; what is completed twice counts once."""
    told = reader.fold_completions(_done(spark, sf), ["user_id"])
    return told.select("user_id", *(F.round(c, 4).alias(c) for c in ("consumed", "lean_weight", "lean_minutes", "left_minutes", "right_minutes")))


@query(f"WITH {SQL_FOLD} SELECT user_id, CASE WHEN m > 0 THEN round(w / m, 4) END AS mean, coalesce(abs(CASE WHEN m > 0 THEN w / m END) > 0.1, false) AS warn, CASE WHEN coalesce(abs(w / nullif(m, 0)) > 0.1, false) THEN CASE WHEN w / m < 0 THEN 'left' ELSE 'right' END ELSE 'balanced' END AS direction, CASE WHEN l + r > 0 THEN round(l / (l + r), 4) ELSE 0.5 END AS left_share FROM f")
def reader_drift(spark, sf):
    told = reader.fold_completions(_done(spark, sf), ["user_id"])
    d = reader.drift(F.col("lean_weight"), F.col("lean_minutes"), F.col("left_minutes"), F.col("right_minutes"), 0.1)
    return told.select("user_id", d.alias("d")).select("user_id", F.round("d.mean", 4).alias("mean"), "d.warn", "d.direction", F.round("d.left_share", 4).alias("left_share"))


@query(
    """WITH g AS (SELECT conv_id % 6 AS topic, length(text) % 101 AS score FROM conversations WHERE role = 'assistant'), t AS (SELECT topic, count(*) AS answers, floor(avg(score) + 0.5)::BIGINT AS mean_score FROM g GROUP BY topic), e AS (SELECT unnest(range(0, 8)) AS topic)
    SELECT topic, coalesce(answers, 0) AS answers, mean_score, coalesce(mean_score < 50, true) AS weak, (SELECT coalesce(floor(avg(score) + 0.5), 0)::BIGINT FROM g) AS overall FROM e FULL JOIN t USING (topic)"""
)
def knowledge_profile(spark, sf):
    graded = table(spark, sf, "conversations").where("role = 'assistant'").select((F.col("conv_id") % 6).alias("topic"), (F.length("text") % 101).alias("score"))
    return reader.profile(graded, list(range(8)), 50)


@query(
    """WITH k AS (SELECT user_id, event_id % 97 AS item, max(event_id) AS seen FROM events WHERE event_id % 2 = 0 GROUP BY ALL), f AS (SELECT user_id, event_id % 97 AS item, max(event_id) AS seen FROM events WHERE event_id % 2 = 1 GROUP BY ALL),
    b AS (SELECT * FROM f UNION ALL SELECT k.* FROM k LEFT JOIN f USING (user_id, item) WHERE f.item IS NULL) SELECT user_id, item, seen FROM b QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seen DESC, item) <= 20"""
)
def capped_views(spark, sf):
    """Each reader's last-seen records after an upsert, the newest twenty."""
    seen = table(spark, sf, "events").withColumn("item", F.col("event_id") % 97)
    rows = lambda odd: seen.where(F.col("event_id") % 2 == odd).groupBy("user_id", "item").agg(F.max("event_id").alias("seen"))
    return reader.capped(rows(0), rows(1), "user_id", "item", "seen", 20)


@query(f"WITH e AS (SELECT doc_id AS key, {NOW_MS} - (doc_id * 7919) % 2419200 * 1000 AS made, 0 AS v FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, {NOW_MS} - (doc_id * 104729) % 2419200 * 1000, 1 FROM documents WHERE doc_id % 2 = 0) SELECT key, made, v FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY key ORDER BY made DESC, v DESC) = 1) WHERE {NOW_MS} - made <= 14 * 86400000")
def unexpired_entries(spark, sf):
    """Cached entries after a save: the newest of each key, none past its fortnight."""
    n, docs = F.col("doc_id"), table(spark, sf, "documents")
    entry = lambda where, k, v: docs.where(where).select(n.alias("key"), (F.lit(NOW_MS) - (n * k) % 2419200 * 1000).alias("made"), F.lit(v).alias("v"))
    return state.save_entries(entry("doc_id % 3 <> 0", 7919, 0), entry("doc_id % 2 = 0", 104729, 1), "key", "made", NOW_MS, 14 * N.DAY_MS)


@query(
    f"""WITH k AS (SELECT source AS world, doc_id // 12 AS story, max({NOW_MS} - (doc_id * 7919) % 1209600 * 1000) AS updated_at FROM documents GROUP BY ALL), b AS (SELECT world, story - story % 2 AS story, max(updated_at) + 1 AS updated_at FROM k WHERE story % 3 = 0 GROUP BY ALL)
    SELECT * FROM b UNION ALL SELECT k.* FROM k LEFT JOIN b USING (world, story) WHERE b.story IS NULL AND {NOW_MS} - k.updated_at <= 5 * 86400000"""
)
def saved_stories(spark, sf):
    """Stories after a build: every third goes on (odd ones under the id before them), others stay for five days."""
    n = F.col("doc_id")
    kept = table(spark, sf, "documents").groupBy(F.col("source").alias("world"), F.expr("doc_id div 12").alias("story")).agg(F.max(F.lit(NOW_MS) - (n * 7919) % 1209600 * 1000).alias("updated_at"))
    built = kept.where("story % 3 = 0").select("world", "story", (F.col("updated_at") + 1).alias("updated_at"), F.when(F.col("story") % 2 == 1, F.col("story") - 1).alias("continues"))
    return state.save_stories(kept, built, NOW_MS, 5 * N.DAY_MS)


@query(
    """WITH f AS (SELECT 'n' || c_nationkey AS cc, c_custkey AS position, 'Thé  Paper ' || (c_custkey % 7) AS title, 'https://f/' || (c_custkey % 40) AS url FROM customer WHERE c_custkey % 9 <> 0), o AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY cc, url ORDER BY position) = 1),
    n AS (SELECT *, cc || '-the-paper-' || right(title, 1) AS base, row_number() OVER (PARTITION BY cc, title ORDER BY position) AS k FROM o) SELECT cc, CASE WHEN k = 1 THEN base ELSE base || '-' || k END AS id, title, url FROM n"""
)
def source_registry(spark, sf):
    """The registry of each country from discovered feeds: each address once, ids made unique."""
    k = F.col("c_custkey")
    found = table(spark, sf, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("cc"), k.alias("position"), F.concat(F.lit("Thé  Paper "), (k % 7).cast("string")).alias("title"), F.concat(F.lit("https://f/"), (k % 40).cast("string")).alias("url"), (k % 9 != 0).alias("ok"))
    return state.registry(found)


@query(
    """WITH e AS (SELECT user_id AS id, event_type, event_id AS made, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 END AS p FROM events WHERE event_type <> 'error')
    SELECT id, CASE p WHEN 1 THEN 'fetched' WHEN 2 THEN 'triaged' WHEN 3 THEN 'analyzed' ELSE 'embedded' END AS state, made AS at FROM e QUALIFY row_number() OVER (PARTITION BY id ORDER BY p DESC, made) = 1""".replace("made AS at", "made AS \"at\"")
)
def item_states(spark, sf):
    """Where each item stands: the farthest state reached, and since when. Half of the events are the state before, half come new."""
    names = F.create_map(*(F.lit(x) for pair in (("view", "fetched"), ("click", "triaged"), ("signup", "analyzed"), ("purchase", "embedded"), ("error", "failed")) for x in pair))
    rows = table(spark, sf, "events").select(F.col("user_id").alias("id"), F.element_at(names, F.col("event_type")).alias("state"), F.col("event_id").alias("at"))
    return state.advance(rows.where("at % 2 = 0"), rows.where("at % 2 = 1"))


@query(
    """WITH a AS (SELECT doc_id // 8 AS batch, doc_id % 8 AS position, doc_id AS id FROM documents), r AS (SELECT doc_id // 8 AS batch, doc_id % 8 AS position, CASE WHEN doc_id % 3 = 0 THEN -1 WHEN doc_id % 3 = 1 AND doc_id % 8 < 7 THEN doc_id + 1 ELSE doc_id END AS said, doc_id * 2 AS score FROM documents WHERE doc_id % 10 <> 9),
    t AS (SELECT r.batch, coalesce(a.id, p.id) AS id, r.position, score FROM r LEFT JOIN a ON a.batch = r.batch AND a.id = said LEFT JOIN a p ON a.id IS NULL AND p.batch = r.batch AND p.position = r.position)
    SELECT t.batch, a.position, t.id, score FROM t JOIN a USING (batch, id) QUALIFY row_number() OVER (PARTITION BY t.batch, t.id ORDER BY t.position DESC) = 1"""
)
def matched_replies(spark, sf):
    """Replies to batches of eight: by the id that they name, else by place; the last reply to an id counts."""
    n = F.col("doc_id")
    asked = table(spark, sf, "documents").select(F.expr("doc_id div 8").alias("batch"), (n % 8).alias("position"), n.alias("id"))
    said = F.when(n % 3 == 0, -1).when((n % 3 == 1) & (n % 8 < 7), n + 1).otherwise(n)
    replies = table(spark, sf, "documents").where("doc_id % 10 <> 9").select(F.expr("doc_id div 8").alias("batch"), (n % 8).alias("position"), said.alias("said_id"), (n * 2).alias("score"))
    return state.matched_replies(asked, replies)


@query(
    f"""WITH {SQL_ITEMS}, a AS (SELECT *, id % 5 <> 0 AS has, CASE WHEN id % 3 <> 0 THEN 0.5 END AS alean, id % 2 = 0 AS refined FROM items), r AS (SELECT *, has AND refined AND alean IS NOT NULL AS ref FROM a)
    SELECT id, has AS analyzed, CASE WHEN ref THEN 'llm' ELSE 'source' END AS lean_source, CASE WHEN ref THEN alean ELSE lean END AS lean, CASE WHEN (CASE WHEN ref THEN alean ELSE lean END) IS NULL THEN NULL WHEN ref AND id % 4 = 0 THEN 'said' ELSE 'own' END AS reason,
    CASE WHEN has THEN 3 ELSE topic END AS topic, CASE WHEN id % 6 > 1 THEN id % 6 ELSE covered_by END AS covered_by FROM r"""
)
def analysed_items(spark, sf):
    n, rows = F.col("id"), items(spark, sf)
    a = F.when(n % 5 != 0, F.struct(F.lit(3).cast("long").alias("topic"), F.when(n % 3 != 0, 0.5).alias("lean"), (n % 2 == 0).alias("lean_refined"), F.when(n % 4 == 0, "said").otherwise("").alias("rationale"), F.lit(0.7).alias("importance")))
    told = state.analysed(rows.withColumns({"a": a, "source_rationale": F.lit("own"), "covered": n % 6}))
    return told.select("id", "analyzed", "lean_source", "lean", F.col("lean_rationale").alias("reason"), "topic", "covered_by")


@query("SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 24 AS chunk FROM documents")
def batches(spark, sf):
    return state.in_chunks(table(spark, sf, "documents").select("source", "doc_id"), "source", [F.col("doc_id")], 24)


@query("WITH l AS (SELECT doc_id // 12 AS key, list(doc_id * 3 ORDER BY doc_id) AS ids FROM documents GROUP BY 1), e AS (SELECT key, unnest(ids) AS id, generate_subscripts(ids, 1) - 1 AS position FROM l) SELECT key, position, id, source FROM e JOIN documents ON doc_id = id")
def listed_items(spark, sf):
    """The items that lists of ids name, in order; what isn't there is dropped."""
    docs = table(spark, sf, "documents")
    lists = docs.groupBy(F.expr("doc_id div 12").alias("key")).agg(F.array_sort(F.collect_list(F.col("doc_id") * 3)).alias("ids"))
    return state.in_id_order(lists, docs.select(F.col("doc_id").alias("id"), "source")).select("key", F.col("position").cast("long").alias("position"), "id", "source")


SQL_STORIES = f"""{SQL_ITEMS}, stories AS (SELECT id // 12 AS story, max(published_at) AS updated_at, CASE WHEN (id // 12) % 7 <> 0 THEN round(max(importance) * 0.9, 2) END AS severity, (id // 12) % 3 = 0 AS developing, (id // 12) % 8 AS topic FROM items GROUP BY id // 12)"""
SQL_NATIONS = "places AS (SELECT chr(97 + n_nationkey) || 'x' AS iso2, cos(radians(n_nationkey * 7 - 80)) AS x, sin(radians(n_nationkey * 7 - 80)) AS y, 0.0::DOUBLE AS z FROM nation WHERE n_nationkey % 6 <> 5)"


def _stories(spark, sf):
    k = F.col("story")
    rows = items(spark, sf).groupBy(F.expr("id div 12").alias("story")).agg(F.max("published_at").alias("updated_at"), F.max("importance").alias("peak"))
    return rows.select("story", "updated_at", F.when(k % 7 != 0, F.round(F.col("peak") * 0.9, 2)).alias("severity"), (k % 3 == 0).alias("developing"), (k % 8).alias("topic"))


def _places(spark, sf):
    k = F.col("n_nationkey")
    angle = F.radians(k * 7 - 80)
    return table(spark, sf, "nation").where("n_nationkey % 6 <> 5").select(F.concat(F.char(k + 97), F.lit("x")).alias("iso2"), F.cos(angle).alias("x"), F.sin(angle).alias("y"), F.lit(0.0).alias("z"))


@query(f"WITH {SQL_STORIES} SELECT story, developing, updated_at FROM stories ORDER BY developing DESC, updated_at DESC, story LIMIT 12")
def told_stories(spark, sf):
    return W.story_list(_stories(spark, sf)).select("story", "developing", "updated_at")


@query(f"WITH {SQL_STORIES}, f AS (SELECT DISTINCT id // 12 AS story FROM items WHERE id % 5 = 0) SELECT story, updated_at FROM stories SEMI JOIN f USING (story) WHERE developing AND updated_at < {NOW_MS} - 7200000 ORDER BY updated_at DESC, story LIMIT 12")
def ongoing_stories(spark, sf):
    rows, members = _stories(spark, sf), items(spark, sf).select("id", F.expr("id div 12").alias("story"))
    late = rows.where(F.col("updated_at") >= NOW_MS - 7_200_000)
    return W.ongoing(rows, late, members.where("id % 5 = 0").select("id"), members).select("story", "updated_at")


@query(f"WITH {SQL_ITEMS} SELECT id // 12 AS story, greatest(0.5, max(CASE WHEN id % 3 = 0 THEN 0.5 ELSE importance END)) AS score FROM items GROUP BY 1")
def story_relevance(spark, sf):
    return W.story_scores(items(spark, sf).select(F.expr("id div 12").alias("story"), F.when(F.col("id") % 3 != 0, F.col("importance")).alias("relevance")))


@query(f"WITH {SQL_STORED} SELECT id // 12 AS story, thumbnail FROM base WHERE starts_with(thumbnail, 'http') QUALIFY row_number() OVER (PARTITION BY story ORDER BY importance DESC, id) = 1")
def story_images(spark, sf):
    return W.thumbnails(stored(spark, sf).withColumn("story", F.expr("id div 12")))


@query(
    f"""WITH {SQL_STORED}, v AS (SELECT id // 12 AS story, unnest(countries) AS country FROM base UNION ALL SELECT id // 12, zone FROM base WHERE zone IS NOT NULL UNION ALL SELECT DISTINCT id // 12, 'us' FROM base WHERE (id // 12) % 2 = 0)
    SELECT story, country, count(*) AS votes FROM v WHERE regexp_full_match(country, '[a-z]{{2}}') GROUP BY ALL"""
)
def story_countries(spark, sf):
    """Which countries a story is about, by its members, its sides and its protagonist."""
    rows = stored(spark, sf).dropDuplicates(["id"]).withColumn("story", F.expr("id div 12"))
    return W.country_votes(rows, rows.where("zone is not null").select("story", "zone"), rows.where("story % 2 = 0").select("story", F.lit("us").alias("iso2")).distinct())


SQL_ALERTS = f"""{SQL_STORIES}, {SQL_NATIONS}, a AS (SELECT story, coalesce(severity, 0.5) AS severity, updated_at, developing, CASE WHEN story % 2 = 0 THEN chr((97 + story % 26)::INT) || 'x' END AS protagonist, chr((97 + (story // 2) % 25)::INT) || 'x' AS located,
    CASE story % 4 WHEN 0 THEN 'naval-blockade' WHEN 1 THEN 'tech' WHEN 2 THEN 'health' ELSE 'conflict' END AS category FROM stories),
    alerts AS (SELECT a.*, p.iso2 AS flag, coalesce(p.x, q.x) AS x, coalesce(p.y, q.y) AS y, coalesce(p.z, q.z) AS z FROM a LEFT JOIN places p ON p.iso2 = protagonist LEFT JOIN places q ON q.iso2 = located WHERE severity >= 0.3 AND (p.iso2 IS NOT NULL OR q.iso2 IS NOT NULL))"""


def _alerts(spark, sf):
    k = F.col("story")
    rows = _stories(spark, sf).withColumns({
        "protagonist": F.when(k % 2 == 0, F.concat(F.char(k % 26 + 97), F.lit("x"))), "located": F.concat(F.char(F.expr("story div 2 % 25") + 97), F.lit("x")),
        "category": F.when(k % 4 == 0, "naval-blockade").when(k % 4 == 1, " tech ").when(k % 4 == 2, " "), "guessed": F.when(k % 4 == 2, "health").otherwise("conflict"),
    })
    return W.alerts(rows, _places(spark, sf), 0.3)


@query(f"WITH {SQL_ALERTS} SELECT story, severity, category, flag, round(x, 6) AS x FROM alerts")
def world_alerts(spark, sf):
    return _alerts(spark, sf).select("story", "severity", "category", "flag", r6(F.col("at.x")).alias("x"))


@query(
    f"""WITH {SQL_ALERTS}, k AS (SELECT *, round(x, 2) + 0.0 AS kx, round(y, 2) + 0.0 AS ky, round(z, 2) + 0.0 AS kz FROM alerts), g AS (SELECT kx, ky, kz, count(*) AS n, max(severity) AS severity, arg_min(story, (-severity, story)) AS story, string_agg(story::VARCHAR, ',' ORDER BY severity DESC, story) AS stories, max(updated_at) AS updated_at, bool_or(developing) AS developing FROM k GROUP BY ALL)
    SELECT n, severity, story, stories, updated_at, developing FROM g ORDER BY severity DESC, story LIMIT 40"""
)
def stacked_alerts(spark, sf):
    told = W.stacked(_alerts(spark, sf))
    return told.select("n", "severity", "story", F.array_join(F.transform("stories", lambda s: s.cast("string")), ",").alias("stories"), "updated_at", "developing")


@query(f"WITH {SQL_ALERTS}, c AS (SELECT DISTINCT category FROM alerts WHERE category <> 'tech') SELECT category, CASE category WHEN 'naval-blockade' THEN 'Naval Blockade' WHEN 'health' THEN 'Health' ELSE 'Conflict' END AS label FROM c")
def alert_legend(spark, sf):
    """The categories shown while one is switched off."""
    return W.legend(W.visible(_alerts(spark, sf), "category", ["tech"]), "category")


@query(
    f"""WITH {SQL_STORIES}, {SQL_NATIONS}, l AS (SELECT id // 12 AS story, id % 12 AS made, chr((97 + id % 27)::INT) || 'x' AS a, chr((97 + (id * 5) % 23)::INT) || 'x' AS b FROM items WHERE id % 4 = 1), s AS (SELECT story, coalesce(severity, 0) AS severity FROM stories SEMI JOIN l USING (story) WHERE {NOW_MS} - updated_at <= 86400000 ORDER BY 2 DESC, 1 LIMIT 10)
    SELECT story, made, a AS from_cc, b AS to_cc FROM l JOIN s USING (story) JOIN places p ON p.iso2 = a JOIN places q ON q.iso2 = b WHERE p.x * q.x + p.y * q.y + p.z * q.z <= 0.9999 ORDER BY severity DESC, story, made LIMIT 20"""
)
def shown_links(spark, sf):
    n = F.col("id")
    links = items(spark, sf).where("id % 4 = 1").select(F.expr("id div 12").alias("story"), (n % 12).alias("at"), F.concat(F.char(n % 27 + 97), F.lit("x")).alias("from"), F.concat(F.char(n * 5 % 23 + 97), F.lit("x")).alias("to"), F.lit("trade").alias("kind"))
    return W.link_layer(_stories(spark, sf), links, _places(spark, sf), NOW_MS, "day").select("story", F.col("at").alias("made"), F.col("from").alias("from_cc"), F.col("to").alias("to_cc"))


@query(
    f"""WITH {SQL_STORIES}, g AS (SELECT id // 12 AS story, id % 12 AS made, CASE WHEN id % 5 <> 0 THEN ((id * 3) % 40)::DOUBLE / 40 END AS x FROM items WHERE id % 3 = 1), s AS (SELECT story, coalesce(severity, 0) AS severity FROM stories SEMI JOIN g USING (story) WHERE {NOW_MS} - updated_at <= 7 * 86400000 ORDER BY 2 DESC, 1 LIMIT 12),
    k AS (SELECT g.*, severity FROM g JOIN s USING (story) WHERE x IS NOT NULL QUALIFY row_number() OVER (PARTITION BY round(x, 2) ORDER BY severity DESC, story, made) = 1) SELECT story, made FROM k ORDER BY severity DESC, story, made LIMIT 14"""
)
def shown_gatherings(spark, sf):
    n = F.col("id")
    rows = items(spark, sf).where("id % 3 = 1").select(F.expr("id div 12").alias("story"), (n % 12).alias("at"), F.lit("talks").alias("kind"), F.when(n % 5 != 0, (n * 3) % 40 / 40.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    return W.gathering_layer(_stories(spark, sf), rows, NOW_MS).select("story", F.col("at").alias("made"))


@query(
    f"""WITH {SQL_GEO}, o AS (SELECT 'n' || s_nationkey AS node, count(*) AS n FROM supplier GROUP BY 1 UNION ALL SELECT 'r' || n_regionkey, count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1), c AS (SELECT parent AS node, count(*) AS children FROM nodes GROUP BY 1)
    SELECT n.node, 'geo-' || n.node AS pool, n.label, n.level, CASE WHEN coalesce(o.n, 0) > 0 THEN 'ready' ELSE 'unknown' END AS state, coalesce(children, 0) > 0 AS has_children, CASE WHEN p.label IS NULL THEN n.label ELSE p.label || ' > ' || n.label END AS crumbs
    FROM nodes n LEFT JOIN o USING (node) LEFT JOIN c USING (node) LEFT JOIN nodes p ON p.node = n.parent"""
)
def coverage_nodes(spark, sf):
    """Every place with its pool, state, breadcrumb and whether it has places below."""
    nodes, nation = geo_nodes(spark, sf), table(spark, sf, "nation")
    outlets = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    counts = outlets.groupBy(F.concat(F.lit("n"), "s_nationkey").alias("node")).count().unionByName(outlets.groupBy(F.concat(F.lit("r"), "n_regionkey").alias("node")).count())
    below = nodes.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children"))
    told = nodes.join(counts, "node", "left").join(below, "node", "left").join(paths(nodes), "node")
    return told.select("node", F.concat(F.lit("geo-"), "node").alias("pool"), "label", "level", F.when(F.col("count") > 0, "ready").otherwise("unknown").alias("state"), (F.coalesce("children", F.lit(0)) > 0).alias("has_children"), F.array_join("labels", " > ").alias("crumbs"))
