"""Queries on stories. Twelve documents in a row are the members of one story, three in a row one event."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrand.functions import numbers as N
from lodestrand.functions import text as T
from lodestrand.operators import greedy, ordering, stories
from lodestrand.plans.adapters import NOW_MS, items, table
from lodestrand.plans.queries import SQL_ITEMS, r6, with_vectors
from lodestrand.plans.registry import query

#: In the form that Spark and DuckDB both read.
SAID = "CASE WHEN id % 4 = 0 THEN 'Line ' || (id % 8) || '  of   words' WHEN id % 4 = 1 THEN '!!!!!!!!' ELSE 'It was told by ' || source_id END"
SQL_CLEAN = "CASE WHEN id % 4 = 1 THEN '' ELSE regexp_replace(said, '\\s+', ' ', 'g') END"
SQL_MEMBERS = f"{SQL_ITEMS}, m AS (SELECT id, id // 12 AS story, id // 3 AS event, 'Title &amp; ' || id AS title, {SAID} AS said, source_id, importance, published_at, topic, lean, covered_by FROM items)"


def _members(spark, sf):
    rows = items(spark, sf).withColumn("summary", F.expr(SAID)).withColumn("title", F.concat(F.lit("Title &amp; "), F.col("id").cast("string")))
    return rows.withColumns({"story": F.expr("id div 12"), "event": F.expr("id div 3"), "source_title": F.col("source_id")})


@query(
    f"""WITH {SQL_MEMBERS}, c AS (SELECT *, {SQL_CLEAN} AS told, row_number() OVER (PARTITION BY story ORDER BY importance DESC, id) AS k FROM m),
    b AS (SELECT story, 'Title & ' || id AS title, CASE WHEN told = '' THEN 'Title & ' || id ELSE told END AS summary FROM c WHERE k = 1),
    f AS (SELECT story, told, min(k) AS k FROM c WHERE told <> '' GROUP BY ALL), s AS (SELECT story, string_agg(f.told, '|' ORDER BY f.k) AS said FROM f GROUP BY story),
    a AS (SELECT story, max(published_at) AS updated_at, string_agg(source_id, ',' ORDER BY published_at DESC, id) AS sources, round(greatest(0, least(1, 0.6 * max(importance) + 0.4 * least(1, count(DISTINCT source_id) / 8))), 6) AS severity FROM m GROUP BY story)
    SELECT a.story, title, summary, coalesce(said, title) AS said, updated_at, sources, severity FROM a JOIN b USING (story) LEFT JOIN s USING (story)"""
)
def fallback_stories(spark, sf):
    told = stories.fallback_stories(_members(spark, sf), "story")
    said = F.array_join(F.transform("synthesis", lambda x: F.when(F.contains(x, F.lit(": ")), F.regexp_extract(x, "(?s)^.*?: (.*)$", 1)).otherwise(x)), "|")
    return told.select("story", "title", "summary", said.alias("said"), "updated_at", F.array_join("source_ids", ",").alias("sources"), r6(F.col("severity")).alias("severity"))


@query(
    f"""WITH {SQL_MEMBERS}, c AS (SELECT *, {SQL_CLEAN} AS told, row_number() OVER (PARTITION BY story, event ORDER BY importance DESC, id) AS k, min(published_at) OVER (PARTITION BY story, event) AS started_at FROM m)
    SELECT story, event, started_at, CASE WHEN event % 5 = 0 THEN 'Own title' ELSE 'Title & ' || id END AS title, CASE WHEN told = '' THEN 'Title &amp; ' || id ELSE told END AS detail FROM c WHERE k = 1
    QUALIFY row_number() OVER (PARTITION BY story ORDER BY started_at DESC, event) <= 3"""
)
def story_timelines(spark, sf):
    rows = _members(spark, sf)
    own = rows.where("event % 5 = 0").select("story", "event", F.lit("Own  title").alias("title"), F.lit("????????").alias("detail")).distinct()
    return stories.timeline(rows, own, 3)


@query(f"WITH {SQL_ITEMS}, m AS (SELECT id, lang AS world, id // 3 AS cluster, CASE WHEN id % 7 = 0 THEN id - 5 END AS attach_to FROM items) SELECT m.world, m.id, coalesce(s.cluster, m.cluster) AS cluster FROM m LEFT JOIN m s ON m.attach_to = s.id AND m.world = s.world")
def forced_joins(spark, sf):
    rows = items(spark, sf).select(F.col("lang").alias("world"), "id", F.expr("id div 3").alias("cluster"), F.when(F.col("id") % 7 == 0, F.col("id") - 5).alias("attach_to"))
    return stories.forced_joins(rows)


SQL_GATES = f"""g AS (SELECT lang AS world, id % 23 AS issue, count(DISTINCT id // 3) AS clusters, sum(greatest(1, coalesce(covered_by, 1)))::BIGINT AS coverage, min(published_at) AS first_at, max(published_at) AS last_at FROM items GROUP BY ALL),
    d AS (SELECT *, clusters >= 2 AND last_at - first_at >= 64800000 AND coverage >= 3 AND {NOW_MS} - last_at <= 129600000 AS developing FROM g)"""


def _planned(spark, sf):
    return items(spark, sf).select(F.col("lang").alias("world"), "id", F.expr("id div 3").alias("cluster"), (F.col("id") % 23).alias("issue"), "covered_by", "importance", "published_at", "source_id")


@query(
    f"""WITH {SQL_ITEMS}, {SQL_GATES}, i AS (SELECT world, 'issue' AS kind, issue AS key, row_number() OVER (PARTITION BY world ORDER BY coverage DESC, last_at DESC, issue) AS position FROM d WHERE developing QUALIFY position <= 6),
    u AS (SELECT world, count(*) AS used FROM i GROUP BY world), e AS (SELECT lang AS world, id // 3 AS cluster, sum(greatest(1, coalesce(covered_by, 1))) AS coverage, max(importance) AS peak, max(published_at) AS last_at FROM items GROUP BY ALL HAVING coverage >= 2),
    r AS (SELECT e.world, cluster, coalesce(used, 0) AS used, row_number() OVER (PARTITION BY e.world ORDER BY coverage DESC, peak DESC, last_at DESC, cluster) AS k FROM e LEFT JOIN u USING (world))
    SELECT * FROM i UNION ALL SELECT world, 'event', cluster, used + k FROM r WHERE k <= 12 - used"""
)
def story_plan(spark, sf):
    return stories.plan(_planned(spark, sf), NOW_MS)


@query(
    f"""WITH {SQL_ITEMS}, {SQL_GATES} SELECT world, count(*) AS issues, count_if(developing) AS developing, count_if(NOT developing AND clusters < 2) AS fail_events, count_if(NOT developing AND last_at - first_at < 64800000) AS fail_span,
    count_if(NOT developing AND coverage < 3) AS fail_sources, count_if(NOT developing AND {NOW_MS} - last_at > 129600000) AS fail_active FROM d GROUP BY world"""
)
def plan_gates(spark, sf):
    rows = _planned(spark, sf)
    sized = rows.groupBy("world", "issue").agg(F.count_distinct("cluster").alias("clusters"))
    told = stories.gates(stories.rollup(rows, ["world", "issue"]).join(sized, ["world", "issue"]), NOW_MS)
    return told.groupBy("world").agg(
        F.count("*").alias("issues"), F.count_if("developing").alias("developing"), *(F.count_if(~F.col(f"ok_{x}")).alias(f"fail_{x}") for x in ("events", "span", "sources", "active"))
    )


@query(
    """WITH s AS (SELECT source AS world, doc_id // 12 AS spec, list(doc_id) AS ids, count(*) AS n FROM documents GROUP BY ALL), k AS (SELECT source AS world, (doc_id + 3) // 12 AS story, list(doc_id) AS ids, count(*) AS m FROM documents WHERE doc_id % 11 <> 0 GROUP BY ALL),
    p AS (SELECT world, spec, story, len(list_intersect(s.ids, k.ids)) / (n + m - len(list_intersect(s.ids, k.ids))) AS score FROM s JOIN k USING (world) WHERE story IN (spec, spec + 1)),
    o AS (SELECT * FROM p WHERE score >= 0.5), b AS (SELECT *, row_number() OVER (PARTITION BY world, spec ORDER BY score DESC, story) AS x, count(*) OVER (PARTITION BY world, story) AS rivals FROM o)
    SELECT world, spec, story, round(score, 6) AS score FROM b WHERE x = 1 AND (rivals = 1 OR score > 0.5 OR story = spec + 1)"""
)
def matched_stories(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("source").alias("world"), "doc_id", F.lit("event").alias("kind"))
    specs = docs.groupBy("world", "kind", F.expr("doc_id div 12").alias("spec")).agg(F.collect_list("doc_id").alias("ids")).withColumn("position", F.col("spec"))
    known = docs.where("doc_id % 11 <> 0").groupBy("world", "kind", F.expr("(doc_id + 3) div 12").alias("story")).agg(F.collect_list("doc_id").alias("ids"))
    return stories.match_stories(specs, known).select("world", "spec", "story", r6(F.col("score")).alias("score"))


@query(
    """WITH o AS (SELECT doc_id // 12 AS story, doc_id AS id, 'Outlet ' || source || ' ' || (doc_id % 12) AS title, doc_id % 12 AS position FROM documents), n AS (SELECT story, outlet FROM (SELECT DISTINCT story FROM o), (SELECT unnest(['outlet', ' OUTLET CRAWL 1', 'nobody']) AS outlet)),
    j AS (SELECT n.story, outlet, id, lower(trim(outlet)) = lower(title) AS e, position FROM n JOIN o USING (story) WHERE contains(lower(title), lower(trim(outlet))) OR contains(lower(trim(outlet)), lower(title)))
    SELECT story, outlet, id FROM j QUALIFY row_number() OVER (PARTITION BY story, outlet ORDER BY e DESC, position) = 1"""
)
def resolved_outlets(spark, sf):
    n = F.col("doc_id")
    members = table(spark, sf, "documents").select(F.expr("doc_id div 12").alias("story"), n.alias("id"), F.concat(F.lit("Outlet "), "source", F.lit(" "), (n % 12).cast("string")).alias("source_title"), (n % 12).alias("position"))
    named = members.select("story").distinct().select("story", F.explode(F.array(F.lit("outlet"), F.lit(" OUTLET CRAWL 1"), F.lit("nobody"))).alias("outlet"))
    return stories.resolve_outlets(named, members)


@query("SELECT a.doc_id AS id, a.doc_id - a.doc_id % 4 AS representative, length(b.text) AS importance FROM documents a JOIN documents b ON b.doc_id = a.doc_id - a.doc_id % 4 WHERE a.doc_id % 4 <> 0")
def clone_fan_out(spark, sf):
    docs = table(spark, sf, "documents")
    clones = docs.where("doc_id % 4 <> 0").select(F.col("doc_id").alias("id"), (F.col("doc_id") - F.col("doc_id") % 4).alias("representative"))
    return stories.fan_out(docs.select(F.col("doc_id").alias("id"), F.length("text").cast("long").alias("importance")), clones)


@query(
    """WITH s AS (SELECT c_custkey AS id, c_custkey % 3 <> 0 AS in_deck, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 50 END AS seen FROM customer)
    SELECT count(*) AS n, count_if(seen IS NULL) AS fresh, max(seen) AS latest FROM (SELECT * FROM (SELECT id, seen FROM s WHERE in_deck LIMIT 5) UNION ALL SELECT * FROM (SELECT id, seen FROM s WHERE seen IS NOT NULL ORDER BY seen, id LIMIT 5))"""
)
def dealt_batch(spark, sf):
    k = F.col("c_custkey")
    sources = table(spark, sf, "customer").select(k.alias("id"), (k % 3 != 0).alias("in_deck"), F.when(k % 3 == 0, k % 50).alias("seen"))
    told = stories.deal(sources, 10, 7).join(sources.select("id", "seen"), "id")
    return told.agg(F.count("*").alias("n"), F.count_if("fresh").alias("fresh"), F.max("seen").alias("latest"))


SQL_TITLE = "list_sort(list_distinct(list_filter(string_split_regex(lower(split_part(text, chr(10), 1)), '[^a-z0-9]+'), lambda t: length(t) >= 4)))"


@query(
    f"""WITH c AS (SELECT label AS country, vec_id AS id, CASE WHEN vec_id % 4 <> 0 THEN embedding::DOUBLE[] END AS v, {SQL_TITLE} AS w FROM embeddings JOIN documents ON doc_id = vec_id), s AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY id) AS position FROM c QUALIFY position <= 5),
    p AS (SELECT c.country, c.id, s.id AS seed, position, len(list_intersect(c.w, s.w)) AS shared, coalesce(list_cosine_similarity(c.v, s.v), 0) AS near FROM c JOIN s USING (country))
    SELECT country, id, seed, round(2 * near + 0.1 * shared, 6) AS score FROM p WHERE shared >= 2 OR near >= 0.5 QUALIFY row_number() OVER (PARTITION BY country, id ORDER BY round(2 * near + 0.1 * shared, 9) DESC, position) = 1"""
)
def assigned_seeds(spark, sf):
    """Documents with their vectors (every fourth has none): the seed of its group that each shares most with, by words of titles or by vector."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.array_distinct(T.ascii_tokens(F.split("text", "\n")[0], 4)).alias("tokens"))
    rows = table(spark, sf, "embeddings").select(F.col("label").alias("country"), F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 4 != 0, F.col("embedding").cast("array<double>")).alias("vector")).join(docs, "id")
    seeds = ordering.top_per_group(rows, ["country"], [F.col("id")], 5).select("country", F.col("id").alias("seed"), F.col("rank").alias("position"), "tokens", "vector")
    return stories.assign_seeds(rows, seeds).select("country", "id", "seed", r6(F.col("score")).alias("score"))


SQL_WORDS = "list_sort(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda t: length(t) >= 6)))"


@query(
    f"""WITH s AS (SELECT doc_id // 12 AS world, doc_id AS story, {SQL_WORDS} AS w, embedding::DOUBLE[] AS v FROM documents LEFT JOIN embeddings ON doc_id % 4 <> 0 AND vec_id = doc_id // 5 * 5), p AS (SELECT a.story, b.story AS other, len(list_intersect(a.w, b.w)) AS i, len(a.w) AS n, len(b.w) AS m, a.v AS v, b.v AS u FROM s a JOIN s b ON a.world = b.world AND a.story <> b.story),
    r AS (SELECT story, other, round(CASE WHEN v IS NOT NULL AND u IS NOT NULL THEN list_cosine_similarity(v, u) WHEN i > 0 THEN i / (n + m - i) ELSE 0 END, 9) AS score FROM p)
    SELECT story, other, round(score, 6) AS score FROM r WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY story ORDER BY score DESC, other) <= 4"""
)
def related_stories(spark, sf):
    """Stories of a world with theirs nearest: by vectors where both have one, else by words."""
    docs = with_vectors(spark, sf, table(spark, sf, "documents").withColumn("id", F.col("doc_id"))).withColumnRenamed("embedding", "vector")
    rows = docs.select(F.expr("doc_id div 12").alias("world"), F.col("doc_id").alias("story"), F.array_distinct(T.ascii_tokens(F.col("text"), 6)).alias("tokens"), "vector")
    return stories.related(rows).select("story", "other", r6(F.col("score")).alias("score"))


def issue_inputs(spark, sf):
    """The events (of sixty items in a row) of each source with their words, the sum and number of their vectors, coverage and span."""
    rows = with_vectors(spark, sf, items(spark, sf)).withColumn("cluster", F.expr("id div 60"))
    add = F.reduce(F.collect_list("embedding"), F.lit(None).cast("array<double>"), lambda a, v: F.when(a.isNull(), v).otherwise(F.zip_with(a, v, lambda x, y: x + y)))
    return rows.groupBy("source_id", "cluster").agg(
        F.array_distinct(F.flatten(F.collect_list(T.title_tokens(F.col("title"))))).alias("tokens"), add.alias("vector_sum"), F.count("embedding").alias("vector_n"),
        F.count_distinct("id").alias("coverage"), F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at"),
    )


@query()
def issue_groups(spark, sf):
    """Events of each source grouped to issues by their members' mean vectors, else by the words of their titles."""
    return greedy.issues(issue_inputs(spark, sf), "source_id")


@query()
def interest_feeds(spark, sf):
    """A feed on one interest for the reader of each language."""
    rows = items(spark, sf).where("not clickbait").withColumn("minutes", N.read_minutes(F.col("text")).cast("double"))
    rows = rows.withColumn("relevance", F.round(N.base_score(F.col("importance"), F.col("published_at"), NOW_MS), 9))
    return greedy.interest_feeds(rows, "lang", 60.0, NOW_MS)
