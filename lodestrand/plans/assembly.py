"""Queries on stored rows: the corpus, candidates of a question, views, feeds and their plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrand.functions import numbers as N
from lodestrand.functions import reading as R
from lodestrand.functions import text as T
from lodestrand.functions.replies import TOPICS
from lodestrand.operators import assembly as A
from lodestrand.plans.adapters import NOW_MS, items, stored, table
from lodestrand.plans.queries import SQL_BUCKET, SQL_ITEMS, SQL_TOKENS, r6, with_vectors
from lodestrand.plans.reading import STOP
from lodestrand.plans.registry import query

SQL_STORED = f"""{SQL_ITEMS}, base AS (SELECT *, id % 9 <> 0 AS analyzed, CASE WHEN id % 13 = 0 THEN id - 1 END AS clone_of, CASE WHEN id % 6 = 0 THEN true WHEN id % 6 = 1 THEN false END AS global,
    CASE WHEN id % 3 <> 0 THEN ((id * 29) % 101)::DOUBLE / 100 END AS prescreen, CASE WHEN id % 7 = 0 THEN 'ua' END AS zone, CASE id % 3 WHEN 0 THEN 'https://img/' || id WHEN 1 THEN 'data:x' END AS thumbnail,
    CASE WHEN id % 2 = 0 THEN [lang] ELSE [lang, 'us'] END AS countries FROM items),
    stored AS (SELECT *, CASE id % 4 WHEN 0 THEN 'front' WHEN 1 THEN 'place-' || lang WHEN 2 THEN 'geo-n' || (id % 25) ELSE 'geo-r1' END AS pool FROM base UNION ALL SELECT *, 'front' FROM base WHERE id % 5 = 0 AND id % 4 <> 0)"""
SETTLED = "NOT clickbait AND clone_of IS NULL AND analyzed"
PLACE = "regexp_matches(pool, '^place-[a-z]{2}$')"
SQL_ONCE = "QUALIFY row_number() OVER (PARTITION BY id ORDER BY pool <> 'front', pool) = 1"
SQL_CORPUS = f"{SQL_STORED}, corpus AS (SELECT * FROM (SELECT * FROM stored WHERE {SETTLED} {SQL_ONCE}) ORDER BY published_at DESC, id LIMIT 6000)"
SQL_LEX = "len(list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda t: t IN ({})))"


@query(f"WITH {SQL_STORED} SELECT pool, id FROM stored WHERE {SETTLED} AND {NOW_MS} - published_at <= 14 * 86400000 AND NOT ({PLACE} AND coalesce(global, false))")
def pool_feed_rows(spark, sf):
    return A.eligible(stored(spark, sf), NOW_MS).select("pool", "id")


@query(f"WITH {SQL_STORED} SELECT id, pool FROM stored WHERE {SETTLED} AND {NOW_MS} - published_at <= 10 * 86400000 {SQL_ONCE}")
def front_story_rows(spark, sf):
    return A.story_eligible(stored(spark, sf), A.FRONT, NOW_MS).select("id", "pool")


@query(f"WITH {SQL_CORPUS} SELECT id, pool FROM corpus")
def news_corpus(spark, sf):
    return A.corpus(stored(spark, sf)).select("id", "pool")


SQL_VECTORS = "LEFT JOIN embeddings e ON CASE WHEN c.id % 4 <> 0 THEN c.id // 5 * 5 END = e.vec_id"


@query(
    f"""WITH {SQL_CORPUS}, q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0), l AS (SELECT id, published_at, {SQL_LEX.format('text', "'thing', 'free', 'casino', 'stupid'")} AS hits FROM corpus),
    a AS (SELECT id, row_number() OVER (ORDER BY hits DESC, published_at DESC, id) AS r FROM l WHERE hits > 0 QUALIFY r <= 150), s AS (SELECT c.id, c.published_at, round(list_cosine_similarity(e.embedding::DOUBLE[], q.v), 9) AS score FROM corpus c {SQL_VECTORS}, q WHERE e.embedding IS NOT NULL),
    b AS (SELECT id, row_number() OVER (ORDER BY score DESC, published_at DESC, id) AS r FROM s QUALIFY r <= 150), n AS (SELECT id, row_number() OVER (ORDER BY published_at DESC, id) AS r FROM corpus QUALIFY r <= 150),
    t AS (SELECT id, r * 2 AS turn FROM a UNION ALL SELECT id, r * 2 + 1 FROM b UNION ALL SELECT id, r + 302 FROM n) SELECT id, min(turn) AS turn FROM t GROUP BY id ORDER BY 2 LIMIT 150"""
)
def question_candidates(spark, sf):
    """What a question is answered from: words and vectors in turn, then the newest, over the pooled corpus."""
    asked = table(spark, sf, "embeddings").where("vec_id = 0").agg(F.min(F.col("embedding").cast("array<double>")).alias("v")).first()["v"]  # one row
    told = A.candidates(with_vectors(spark, sf, A.corpus(stored(spark, sf))), "text", "thing free casino stupid", asked)
    return told.select("id", F.col("turn").cast("long").alias("turn"))


SQL_PENDING = f"""p AS (SELECT *, coalesce(prescreen, 0.5) AS weight, (greatest(0, {NOW_MS} - published_at) // 7200000)::BIGINT AS bucket FROM stored WHERE NOT clickbait AND clone_of IS NULL AND NOT analyzed AND {NOW_MS} - published_at <= 14 * 86400000 AND NOT ({PLACE} AND coalesce(global, false))),
    o AS (SELECT *, row_number() OVER (PARTITION BY pool, bucket, source_id ORDER BY weight DESC, published_at DESC, id) AS turn FROM p)"""


@query(f"WITH {SQL_STORED}, {SQL_PENDING} SELECT pool, id, row_number() OVER (PARTITION BY pool ORDER BY bucket, turn, weight DESC, published_at DESC, id) AS position FROM o QUALIFY position <= 120")
def provisional_rows(spark, sf):
    return A.provisional(stored(spark, sf), NOW_MS).select("pool", "id", F.col("position").cast("long").alias("position"))


@query()
def pool_views(spark, sf):
    """Each pool's whole view for one interest: analysed rows diversified, provisional ones below."""
    match = lambda rows: rows.withColumn("match", R.interest_match("energy of the free things", R.interest_words(F.concat_ws(" ", "title", "summary"))))
    return A.view(stored(spark, sf), NOW_MS, match)


SQL_ASKED = f"""{SQL_ITEMS}, done AS (SELECT id FROM items WHERE id % 10 = 3), c AS (SELECT i.*, done.id IS NOT NULL AS read FROM (SELECT *, importance AS relevance FROM items) i LEFT JOIN done USING (id) WHERE topic IN (0, 1, 2, 3, 5) AND kind IN (0, 2) AND published_at <= {NOW_MS} - 3600000 AND {NOW_MS} - 3600000 - published_at <= 14 * 86400000)"""


@query(f"WITH {SQL_ASKED} SELECT id, read, CASE WHEN read THEN 'Already read — revisit your summary anytime' END AS reason FROM c")
def reader_candidates(spark, sf):
    """What may enter a reader's feed, and what is read already and shown after it."""
    rows = items(spark, sf).withColumn("relevance", F.col("importance"))
    told = A.feed_candidates(rows, rows.where("id % 10 = 3"), [0, 1, 2, 3, 5], [0, 2], NOW_MS - N.HOUR_MS)
    return told.select("id", "read", F.when(F.col("read"), "Already read — revisit your summary anytime").alias("reason"))


@query(
    f"""WITH {SQL_ITEMS}, s AS (SELECT id, topic::VARCHAR AS topic, CASE WHEN lean <= -0.2 THEN 'left' WHEN lean >= 0.2 THEN 'right' ELSE 'center' END AS side, id % 2 = 0 AS drifting FROM items WHERE lean IS NOT NULL)
    SELECT id, CASE WHEN side = 'center' THEN 'A center take on ' || topic WHEN side = 'left' AND drifting THEN 'Counterweight — a left-leaning view to balance your day' WHEN side = 'left' THEN 'Balancing perspectives — a left-leaning take on ' || topic
    ELSE 'A ' || side || '-leaning take on ' || topic END AS reason FROM s"""
)
def pick_reasons(spark, sf):
    side = F.when(F.col("lean") <= -0.2, "left").when(F.col("lean") >= 0.2, "right").otherwise("center")
    return items(spark, sf).where(N.political(F.col("lean"))).select("id", A.political_reason(side, F.lit("left"), F.col("topic").cast("string"), F.col("id") % 2 == 0).alias("reason"))


@query()
def analysis_plans(spark, sf):
    """The clusters of near copies whose representative is to be analysed next, over all pools' rows."""
    return A.analysis_plan(items(spark, sf).withColumns({"analyzed": F.col("id") % 3 == 0, "prescreen": F.when(F.col("id") % 3 != 0, (F.col("id") * 29) % 101 / 100.0)}), NOW_MS, 400, 5 * N.DAY_MS).select("representative", "members", "sources")


SQL_SEEDS = f"seeds AS (SELECT * FROM stored WHERE {SETTLED} AND zone IS NULL AND importance >= 0.55 AND {NOW_MS} - published_at <= 3 * 86400000 AND pool = 'front' ORDER BY importance DESC, published_at DESC, id LIMIT 40)"


@query(
    f"""WITH {SQL_STORED}, {SQL_SEEDS}, x AS (SELECT *, unnest(countries) AS country, {SQL_TOKENS} AS w FROM seeds), v AS (SELECT c.country, count(e.vec_id) AS vectors, count(*) AS score FROM x c {SQL_VECTORS} GROUP BY 1)
    SELECT country, score, vectors, coalesce((SELECT string_agg(t, ' ' ORDER BY t) FROM (SELECT DISTINCT unnest(w) AS t FROM x WHERE x.country = v.country)), '') AS tokens FROM v"""
)
def side_countries(spark, sf):
    """The countries that the strongest fresh stories of the front pool name, with their words."""
    rows = with_vectors(spark, sf, A.seeds(stored(spark, sf).where("pool = 'front'"), NOW_MS))
    told = A.involved(rows, T.title_tokens(F.col("title")))
    return told.select("country", "score", "vectors", F.array_join("tokens", " ").alias("tokens"))


@query(
    f"""WITH {SQL_ITEMS}, i AS (SELECT id, {SQL_TOKENS} AS t, embedding::DOUBLE[] AS v FROM items LEFT JOIN embeddings ON vec_id = id // 5 * 5), p AS (SELECT s.id AS source, h.id AS video, h.id % 4 AS position, s.id % 8 = 4 AND s.v IS NOT NULL AS near, len(list_filter(h.t, lambda x: list_contains(s.t, x)))::DOUBLE AS shared, round(list_cosine_similarity(s.v, h.v), 9) AS cosine
    FROM i s JOIN i h ON h.id // 4 * 4 = s.id AND h.id <> s.id), m AS (SELECT source, video, position, near, CASE WHEN near THEN cosine ELSE shared END AS score FROM p), k AS (SELECT * FROM m WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, position) = 1)
    SELECT source, video, round(score, 6) AS score FROM k WHERE score >= CASE WHEN near THEN 0.5 ELSE 2 END"""
)
def fitting_videos(spark, sf):
    """Of the three items after every fourth, the one that fits it: by words for every other, by vectors for the rest where they have one."""
    rows = items(spark, sf).withColumns({"tokens": T.title_tokens(F.col("title")), "_k": F.expr("id div 5 * 5")}).select("id", "tokens", "_k")
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("_k"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.join(vectors, "_k", "left")
    sources = rows.where("id % 4 = 0").select(F.col("id").alias("source"), "tokens", F.when(F.col("id") % 8 == 4, F.col("vector")).alias("vector"))
    hits = rows.where("id % 4 <> 0").select(F.expr("id div 4 * 4").alias("source"), F.col("id").alias("video"), (F.col("id") % 4).alias("position"), "tokens", "vector")
    return A.pick_video(hits, sources).select("source", "video", r6(F.col("score")).alias("score"))


@query(
    f"""WITH {SQL_STORED}, w AS (SELECT *, list_filter(string_split_regex(lower(coalesce(title, '') || ' ' || coalesce(summary, '')), '[^a-z0-9]+'), lambda t: length(t) >= 2 AND t NOT IN ({STOP})) AS w FROM stored WHERE pool = 'geo-r1'),
    m AS (SELECT *, (list_contains(w, 'der')::INT + list_contains(w, 'free')::INT) / 2 AS match FROM w) SELECT id, topic, CASE WHEN id % 2 = 0 THEN 'llm' ELSE 'source' END AS lean_source, round(greatest(0, least(1, 0.6 * match + 0.4 * importance)), 6) AS relevance,
    CASE WHEN covered_by > 1 THEN covered_by END AS covered_by, 'analyzed' AS enrichment, md5(title) AS title FROM m"""
)
def shown_items(spark, sf):
    """A pool's rows as items of a feed for one interest. The texts hold no entities that a title would change by."""
    rows = stored(spark, sf).where("pool = 'geo-r1'").withColumn("lean_source", F.when(F.col("id") % 2 == 0, "llm"))
    told = A.feed_items(rows, R.interest_match("der free", R.interest_words(F.concat_ws(" ", "title", "summary"))))
    return told.select("id", "topic", "lean_source", r6(F.col("relevance")).alias("relevance"), "covered_by", "enrichment", F.md5("title").alias("title"))


@query(
    f"""WITH {SQL_STORED} SELECT pool, CASE WHEN starts_with(pool, 'geo-') THEN substr(pool, 5) WHEN {PLACE} THEN substr(pool, 7) END AS node, count(*) AS n, count(DISTINCT source_id) AS sources,
    count(*) FILTER (analyzed AND NOT clickbait AND published_at >= {NOW_MS} - 86400000) AS analyzed, count(*) FILTER (NOT analyzed AND NOT clickbait AND clone_of IS NULL AND published_at >= {NOW_MS} - 86400000) AS pending,
    max(published_at) AS built_at FROM stored GROUP BY pool"""
)
def pool_status(spark, sf):
    """Each pool's sources, rows analysed and pending in the window, and build time."""
    recent = ~F.col("clickbait") & (F.col("published_at") >= NOW_MS - N.DAY_MS)
    told = stored(spark, sf).groupBy("pool").agg(
        F.count("*").alias("n"), F.count_distinct("source_id").alias("sources"), F.count_if(recent & F.col("analyzed")).alias("analyzed"),
        F.count_if(recent & ~F.col("analyzed") & F.col("clone_of").isNull()).alias("pending"), F.max("published_at").alias("built_at"),
    )
    return told.withColumn("node", A.pool_node(F.col("pool")))


@query(f"WITH {SQL_STORED}, v AS (SELECT pool, max(published_at) AS made FROM stored GROUP BY pool) SELECT pool, CASE WHEN pool = 'front' THEN (SELECT max(made) FROM v) ELSE made END AS version FROM v")
def story_versions(spark, sf):
    """When each pool's stories are of: the front's, of the newest build of any pool that it draws on."""
    built = stored(spark, sf).groupBy("pool").agg(F.max("published_at").alias("at"))
    draws = (F.col("pool") == A.FRONT) | A.is_geo(F.col("pool")) | A.is_place(F.col("pool"))
    newest = built.agg(F.max(F.when(draws, F.col("at"))).alias("newest"))
    return built.join(newest).select("pool", F.when(F.col("pool") == A.FRONT, F.col("newest")).otherwise(F.col("at")).alias("version"))  # one row


@query(f"WITH {SQL_STORED} SELECT id FROM (SELECT c.id, published_at FROM (SELECT * FROM stored WHERE pool = 'front' AND NOT clickbait AND analyzed AND published_at >= {NOW_MS} - 3 * 86400000) c {SQL_VECTORS} WHERE e.vec_id IS NULL)")
def pending_vectors(spark, sf):
    """Analysed rows of the front pool, in the window, that have no vector yet."""
    rows = stored(spark, sf).where((F.col("pool") == A.FRONT) & ~F.col("clickbait") & F.col("analyzed") & (F.col("published_at") >= NOW_MS - 3 * N.DAY_MS))
    return with_vectors(spark, sf, rows).where("embedding is null").select("id")


@query(f"WITH {SQL_STORED} SELECT id, importance FROM stored WHERE {SETTLED} AND kind IN (1, 2) AND importance >= 0.5 AND id % 4 <> 3 AND published_at >= {NOW_MS} - 86400000 * 3 AND pool = 'front' ORDER BY importance DESC, published_at DESC, id LIMIT 8")
def pending_transcripts(spark, sf):
    """The eight strongest recordings of the front pool that a transcript may deepen."""
    rows = stored(spark, sf).where(A.settled() & F.col("kind").isin(1, 2) & (F.col("importance") >= 0.5) & (F.col("id") % 4 != 3) & (F.col("published_at") >= NOW_MS - 3 * N.DAY_MS) & (F.col("pool") == A.FRONT))
    return rows.orderBy(F.col("importance").desc(), F.col("published_at").desc(), "id").limit(8).select("id", "importance")


@query(f"WITH {SQL_STORED}, b AS (SELECT {SQL_BUCKET} AS bucket, * FROM stored WHERE id % 11 = 0) SELECT id, pool FROM b WHERE id % 11 = 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY pool <> 'place-de', pool <> 'front', pool) = 1")
def stored_anywhere(spark, sf):
    """Rows by id from whatever pool has them, one pool preferred."""
    asked = items(spark, sf).where("id % 11 = 0").select("id")
    rows = stored(spark, sf).join(asked, "id", "left_semi")
    return A.first_per_key(rows, ["id"], [F.col("pool") != "place-de", F.col("pool") != A.FRONT, F.col("pool")]).select("id", "pool")


SQL_CC = "substr(n_name, 1, 1) || substr(n_name, length(n_name), 1)"


@query(
    f"""WITH n AS (SELECT n_nationkey AS k, n_regionkey AS r, lower({SQL_CC}) || n_nationkey AS cc FROM nation), o AS (SELECT cc, CASE WHEN s_suppkey % 3 = 0 THEN 'north' WHEN s_suppkey % 3 = 1 THEN 'south' END AS region, 's' || s_suppkey AS source, s_suppkey AS position FROM supplier JOIN n ON k = s_nationkey),
    c AS (SELECT CASE WHEN p_partkey % 5 = 0 THEN 'frontpage' ELSE lower(p_brand) END AS world, 'p' || p_partkey AS source, p_partkey AS position FROM part),
    p AS (SELECT 'geo-n' || k AS pool FROM n UNION ALL SELECT 'geo-n' || k || '-north' FROM n UNION ALL SELECT 'place-' || cc FROM n UNION ALL SELECT 'geo-r' || r_regionkey FROM region UNION ALL SELECT DISTINCT world FROM c UNION ALL SELECT unnest(['nowhere', 'geo-unknown', 'geo-'])),
    d AS (SELECT 'n' || k AS node, cc, NULL AS region FROM n UNION ALL SELECT 'n' || k || '-north', cc, 'north' FROM n)
    SELECT pool, source FROM p JOIN d ON pool = 'geo-' || node JOIN o ON o.cc = d.cc AND (d.region IS NULL OR o.region = d.region) UNION ALL SELECT pool, source FROM p JOIN o ON pool = 'place-' || o.cc
    UNION ALL SELECT pool, source FROM (SELECT 'geo-r' || r AS pool, source FROM n JOIN o USING (cc) QUALIFY row_number() OVER (PARTITION BY cc ORDER BY position) <= 6)
    UNION ALL SELECT pool, source FROM p JOIN c ON c.world = CASE WHEN pool IN (SELECT world FROM c) THEN pool ELSE 'frontpage' END WHERE NOT (starts_with(pool, 'geo-') AND length(pool) > 4) AND pool NOT IN (SELECT 'place-' || cc FROM n)"""
)
def pool_sources(spark, sf):
    """The sources that each pool draws on: outlets of a node, of its continent's countries or of a country, or a world's curated ones (the front page's, if there is no such world)."""
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r"), F.concat(F.lower(F.concat(F.substring("n_name", 1, 1), F.substring("n_name", -1, 1))), F.col("n_nationkey").cast("string")).alias("cc"))
    k = F.col("s_suppkey")
    outlets = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("k")).select("cc", F.when(k % 3 == 0, "north").when(k % 3 == 1, "south").alias("region"), F.concat(F.lit("s"), k.cast("string")).alias("source"), k.alias("position"))
    curated = table(spark, sf, "part").select(F.when(F.col("p_partkey") % 5 == 0, "frontpage").otherwise(F.lower("p_brand")).alias("world"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("source"))
    country = F.concat(F.lit("n"), F.col("k").cast("string"))
    continent = F.concat(F.lit("r"), F.col("r").cast("string"))
    nodes = nation.select(country.alias("node"), continent.alias("parent"), F.lit("country").alias("level"), "cc", F.lit(None).cast("string").alias("region"))
    nodes = nodes.unionByName(nation.select(F.concat(country, F.lit("-north")).alias("node"), country.alias("parent"), F.lit("region").alias("level"), "cc", F.lit("north").alias("region")))
    nodes = nodes.unionByName(table(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"), F.lit("world").alias("parent"), F.lit("continent").alias("level"), F.lit(None).cast("string").alias("cc"), F.lit(None).cast("string").alias("region")))
    pools = nodes.select(F.concat(F.lit("geo-"), "node").alias("pool")).unionByName(nation.select(F.concat(F.lit("place-"), "cc").alias("pool"))).unionByName(curated.select(F.col("world").alias("pool")).distinct())
    pools = pools.unionByName(spark.createDataFrame([("nowhere",), ("geo-unknown",), ("geo-",)], "pool string"))
    return A.pool_sources(pools, nodes, outlets, curated).select("pool", "source")


TOPIC_ROWS = ", ".join(f"({i}, '{n}', '{c}', {o})" for i, n, c, o in [(0, "World", "#6EA8FE", 0), (1, "Politics", "#E0A94B", 1), (2, "Economics", "#5BD6A6", 2), (3, "Science", "#9B8CFF", 4), (4, "Technology", "#56C2D6", 3), (5, "History", "#C9A06B", 6), (6, "Health", "#E08AA8", 5)])


@query(
    f"""WITH {SQL_ITEMS}, t(topic, label, color, place) AS (VALUES {TOPIC_ROWS}), c AS (SELECT topic, count(*) AS n FROM items GROUP BY topic)
    SELECT coalesce(label, 'weather') AS label, coalesce(color, '#9AA4B2') AS color, n, row_number() OVER (ORDER BY place NULLS LAST) AS position FROM c LEFT JOIN t USING (topic)"""
)
def topic_shelf(spark, sf):
    """How many items each topic has, with its name and colour, in the order in which topics are shown; the eighth is one that no table has."""
    rows = items(spark, sf).withColumn("topic", F.element_at(F.array(*(F.lit(x) for x in (*TOPICS[:7], "weather"))), (F.col("topic") + 1).cast("int")))
    return A.topic_shelf(rows).select("label", "color", "n", "position")


@query(
    f"""WITH {SQL_STORED}, d AS (SELECT *, {PLACE} AND analyzed AND NOT clickbait AND global IS NULL AND published_at >= {NOW_MS} - 604800000 AS asked FROM stored)
    SELECT pool, id, CASE WHEN asked THEN id % 4 = 1 ELSE global END AS global, asked FROM d"""
)
def marked_scopes(spark, sf):
    """Regional pools' items with what a model said of their scope: those it names are global, others that it was asked about are local."""
    rows = stored(spark, sf)
    named = rows.where("id % 4 = 1").select("pool", "id")
    return A.marked_global(rows, named, NOW_MS).select("pool", "id", "global", "asked")
