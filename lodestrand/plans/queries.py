"""Registered queries over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrand.functions import numbers as N
from lodestrand.functions import text as T
from lodestrand.functions.replies import TOPICS
from lodestrand.operators import aggregate, greedy, ordering, places, retrieve, select
from lodestrand.plans.adapters import NOW_MS, geo_nodes, items, progress, table
from lodestrand.plans.registry import query

SQL_ITEMS = f"""items AS (
  SELECT d.doc_id AS id, d.source AS source_id, split_part(d.text, chr(10), 1) AS title, d.text AS summary, d.text, d.lang,
    d.doc_id % 8 AS topic, d.doc_id % 3 AS kind, {NOW_MS} - (d.doc_id * 7919) % 1209600 * 1000 AS published_at,
    CASE WHEN d.doc_id % 5 <> 0 THEN ((d.doc_id * 37) % 201)::DOUBLE / 100 - 1 END AS lean, ((d.doc_id * 53) % 101)::DOUBLE / 100 AS importance,
    nullif((d.doc_id * 31) % 4, 0) AS covered_by, coalesce(l.quality = 0, false) AS clickbait
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in T.TITLE_STOP)
SQL_TOKENS = f"list_distinct(list_filter(string_split_regex(lower(title), '[^a-z0-9]+'), lambda t: length(t) >= 3 AND t NOT IN ({STOP})))"
SQL_BUCKET = "CASE WHEN lean IS NULL THEN 'non-political' WHEN lean <= -0.6 THEN 'left' WHEN lean <= -0.2 THEN 'lean-left' WHEN lean < 0.2 THEN 'center' WHEN lean < 0.6 THEN 'lean-right' ELSE 'right' END"
SQL_HOST = "nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '^www\\.', ''), '')"


def _case(column: str, values: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


def r6(x: Column) -> Column:
    return F.round(x.cast("double"), 6)


def backlog_order() -> list[Column]:
    return [F.col("importance").desc(), F.col("published_at").desc(), F.col("id")]


@query(f"WITH {SQL_ITEMS} SELECT id, source_id, row_number() OVER (PARTITION BY source_id ORDER BY importance DESC, published_at DESC, id) AS turn FROM items")
def fair_interleave(spark, sf):
    return ordering.interleave_by_provider(items(spark, sf), "source_id", backlog_order()).select("id", "source_id", F.col("turn").cast("long").alias("turn"))


@query(f"WITH {SQL_ITEMS}, b AS (SELECT *, (({NOW_MS} - published_at) // 7200000)::BIGINT AS bucket FROM items WHERE NOT clickbait) SELECT id, bucket, row_number() OVER (PARTITION BY bucket, source_id ORDER BY importance DESC, published_at DESC, id) AS turn FROM b")
def fair_recency_buckets(spark, sf):
    rows = items(spark, sf).where("not clickbait")
    return ordering.interleave_by_provider(rows, "source_id", backlog_order(), ordering.recency_bucket(F.col("published_at"), NOW_MS)).select("id", F.col("bucket").cast("long").alias("bucket"), F.col("turn").cast("long").alias("turn"))


@query(f"WITH {SQL_ITEMS}, r AS (SELECT * FROM items ORDER BY importance DESC, published_at DESC, id LIMIT 200) SELECT id FROM r WHERE clickbait = false")
def top_local_backlog(spark, sf):
    return items(spark, sf).orderBy(*backlog_order()).limit(200).where("not clickbait").select("id")


@query(f"WITH {SQL_ITEMS} SELECT id, published_at FROM items WHERE NOT clickbait AND published_at >= {NOW_MS} - 7 * 86400000")
def feed_eligibility(spark, sf):
    return select.eligible(items(spark, sf), NOW_MS, 7 * N.DAY_MS).select("id", "published_at")


@query(
    f"""WITH {SQL_ITEMS}, t AS (SELECT unnest(['the', 'idiot', 'free', 'die der']) AS term), n AS (SELECT count(*) AS n FROM items),
    h AS (SELECT term, (SELECT count(*) FROM items WHERE regexp_matches(title || ' ' || summary, '\\b' || replace(term, ' ', '\\s+') || '\\b', 'i')) AS hits FROM t)
    SELECT term, hits, hits > floor(n * 0.6) AS skipped FROM h, n"""
)
def exclusion_counts(spark, sf):
    return select.exclusion_counts(items(spark, sf), F.concat_ws(" ", "title", "summary"), ["the", "idiot", "free", "die der"])


@query(f"WITH {SQL_ITEMS} SELECT id FROM items WHERE NOT regexp_matches(title || ' ' || summary, '\\bidiot\\b', 'i')")
def exclusion_partition(spark, sf):
    return select.without_excluded(items(spark, sf), F.concat_ws(" ", "title", "summary"), ["idiot"]).select("id")


@query(f"WITH {SQL_ITEMS} SELECT {SQL_BUCKET} AS bucket, count(*) AS n, round(avg(importance), 6) AS importance FROM items GROUP BY 1")
def lean_buckets(spark, sf):
    return items(spark, sf).groupBy(N.lean_bucket(F.col("lean")).alias("bucket")).agg(F.count("*").alias("n"), r6(F.avg("importance")).alias("importance"))


SQL_PROGRESS = "progress AS (SELECT user_id, event_id, ts::DATE AS day, value AS minutes, CASE WHEN event_id % 5 <> 0 THEN ((event_id * 37) % 201)::DOUBLE / 100 - 1 END AS lean FROM events)"
SQL_DAILY = f"{SQL_PROGRESS}, daily AS (SELECT day, sum(lean * minutes) AS weight, sum(minutes) AS minutes FROM progress WHERE lean IS NOT NULL GROUP BY day)"


def _daily(spark, sf):
    return progress(spark, sf).where("lean is not null").groupBy("day").agg(F.sum(F.col("lean") * F.col("minutes")).alias("weight"), F.sum("minutes").alias("minutes"))


@query(f"WITH {SQL_DAILY} SELECT strftime(day, '%Y-%m-%d') AS day, round(weight, 4) AS weight, round(minutes, 4) AS minutes FROM daily")
def daily_lean(spark, sf):
    return _daily(spark, sf).select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("weight", 4).alias("weight"), F.round("minutes", 4).alias("minutes"))


@query(
    f"""WITH {SQL_PROGRESS}, d AS (SELECT user_id, day, sum(lean * minutes) AS weight, sum(minutes) AS minutes FROM progress WHERE lean IS NOT NULL GROUP BY ALL),
    w AS (SELECT user_id, day, sum(weight) OVER x AS weight, sum(minutes) OVER x AS minutes FROM d WINDOW x AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 30 PRECEDING AND CURRENT ROW))
    SELECT user_id, strftime(day, '%Y-%m-%d') AS day, CASE WHEN abs(minutes) > 0 THEN round(weight / minutes, 4) END AS mean FROM w"""
)
def trailing_drift(spark, sf):
    daily = progress(spark, sf).where("lean is not null").groupBy("user_id", "day").agg(F.sum(F.col("lean") * F.col("minutes")).alias("weight"), F.sum("minutes").alias("minutes"))
    told = daily.select("user_id", "day", ordering.trailing(daily, "user_id", "day", F.col("weight")).alias("weight"), ordering.trailing(daily, "user_id", "day", F.col("minutes")).alias("minutes"))
    return told.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.when(F.abs("minutes") > 0, F.round(F.col("weight") / F.col("minutes"), 4)).alias("mean"))


@query(
    f"""WITH {SQL_PROGRESS} SELECT user_id, round(coalesce(sum(minutes) FILTER (lean <= -0.2), 0), 4) AS left_minutes, round(coalesce(sum(minutes) FILTER (lean >= 0.2), 0), 4) AS right_minutes,
    round(coalesce(sum(minutes) FILTER (lean > -0.2 AND lean < 0.2), 0), 4) AS center_minutes, round(coalesce(sum(minutes) FILTER (lean IS NULL), 0), 4) AS other_minutes FROM progress GROUP BY user_id"""
)
def feed_lean_breakdown(spark, sf):
    told = progress(spark, sf).groupBy("user_id").agg(*aggregate.lean_minutes(F.col("lean"), F.col("minutes")))
    return told.select("user_id", *(F.round(c, 4).alias(c) for c in ("left_minutes", "right_minutes", "center_minutes", "other_minutes")))


SQL_MINUTES = "greatest(1, floor(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) / 200 + 0.5))::BIGINT"


@query(f"WITH {SQL_ITEMS} SELECT id, {SQL_MINUTES} AS minutes FROM items")
def read_minutes(spark, sf):
    return items(spark, sf).select("id", N.read_minutes(F.col("text")).alias("minutes"))


@query(f"WITH {SQL_ITEMS}, t AS (SELECT topic, sum({SQL_MINUTES})::BIGINT AS minutes FROM items GROUP BY topic) SELECT topic, minutes, round(minutes / sum(minutes) OVER (), 6) AS share FROM t")
def topic_share(spark, sf):
    told = items(spark, sf).groupBy("topic").agg(F.sum(N.read_minutes(F.col("text"))).alias("minutes"))
    return told.select("topic", "minutes", r6(F.col("minutes") / F.sum("minutes").over(Window.partitionBy())).alias("share"))  # a row for each topic


@query("SELECT conv_id % 8 AS topic, count(*) AS answers, floor(avg(length(text) % 101) + 0.5)::BIGINT AS mean_score, avg(length(text) % 101) < 50 AS weak FROM conversations WHERE role = 'assistant' GROUP BY 1")
def knowledge_topics(spark, sf):
    graded = table(spark, sf, "conversations").where("role = 'assistant'").select((F.col("conv_id") % 8).alias("topic"), (F.length("text") % 101).alias("score"))
    return aggregate.knowledge(graded, "topic", "score", 50)


@query(
    """WITH t AS (SELECT unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda t: length(t) >= 4)) AS token FROM conversations WHERE role = 'user')
    SELECT token, count(*) AS n FROM t GROUP BY token HAVING count(*) >= 2 ORDER BY n DESC, token LIMIT 12"""
)
def weak_concepts(spark, sf):
    tokens = table(spark, sf, "conversations").where("role = 'user'").select(F.explode(T.ascii_tokens(F.col("text"), 4)).alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("n")).where("n >= 2").orderBy(F.col("n").desc(), "token").limit(12)


@query(
    f"""WITH {SQL_ITEMS} SELECT source_id, sum(greatest(1, coalesce(covered_by, 1)))::BIGINT AS coverage, round(greatest(0, least(1, 0.6 * max(importance) + 0.4 * least(1, count(DISTINCT topic) / 8))), 6) AS severity,
    round(sum(greatest(0.1, importance) * lean) FILTER (lean IS NOT NULL) / sum(greatest(0.1, importance)) FILTER (lean IS NOT NULL), 6) AS lean, min(published_at) AS first_at, max(published_at) AS last_at FROM items GROUP BY source_id"""
)
def cluster_rollup(spark, sf):
    return items(spark, sf).groupBy("source_id").agg(
        aggregate.coverage(F.col("covered_by")).alias("coverage"), r6(aggregate.severity(F.col("importance"), F.col("topic"))).alias("severity"),
        r6(aggregate.aggregate_lean(F.col("lean"), F.col("importance"))).alias("lean"), F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at"),
    )


@query(
    f"""WITH {SQL_ITEMS}, c AS (SELECT source_id, topic, count(*) AS n, min(id) AS f FROM items GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY n DESC, f) AS k FROM c)
    SELECT source_id, topic, n FROM r WHERE k = 1"""
)
def majority_topic(spark, sf):
    return aggregate.majority(items(spark, sf), "source_id", "topic", "id")


@query(f"WITH {SQL_ITEMS} SELECT id, array_to_string(list_sort({SQL_TOKENS}), ' ') AS tokens FROM items")
def title_tokens(spark, sf):
    return items(spark, sf).select("id", F.array_join(F.array_sort(T.title_tokens(F.col("title"))), " ").alias("tokens"))


@query(
    f"""WITH {SQL_ITEMS}, t AS (SELECT id, list_sort({SQL_TOKENS}) AS s FROM items), d AS (SELECT min(id) AS id, s FROM t WHERE len(s) > 0 GROUP BY s), e AS (SELECT id, unnest(s) AS token, len(s) AS n FROM d),
    p AS (SELECT x.id AS a, y.id AS b, x.n AS na, y.n AS nb, count(*) AS i FROM e x JOIN e y ON x.token = y.token AND x.id < y.id GROUP BY ALL)
    SELECT a, b, round(i / (na + nb - i), 6) AS similarity FROM p WHERE i / (na + nb - i) >= 0.5 - 1e-12"""
)
def token_jaccard_pairs(spark, sf):
    titled = items(spark, sf).withColumn("tokens", T.title_tokens(F.col("title"))).where(F.size("tokens") > 0)
    kinds = titled.withColumn("key", F.array_join(F.array_sort("tokens"), " ")).groupBy("key").agg(F.min("id").alias("id"), F.first("tokens").alias("tokens"))
    return retrieve.token_pairs(kinds, "tokens", 0.5).select("a", "b", r6(F.col("similarity")).alias("similarity"))


@query(
    """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 6) AS score FROM embeddings, q
    ORDER BY list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) DESC, vec_id LIMIT 20"""
)
def cosine_topk(spark, sf):
    pool = table(spark, sf, "embeddings")
    asked = pool.where("vec_id = 0").agg(F.min(F.col("embedding").cast("array<double>")).alias("v")).first()["v"] or []  # one row
    return retrieve.nearest(pool, asked, 20).select("vec_id", r6(F.col("score")).alias("score"))


@query(
    """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(greatest(0, least(1, (list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) - 0.2) / 0.6)), 6) AS match FROM embeddings, q"""
)
def semantic_match(spark, sf):
    pool = table(spark, sf, "embeddings")
    asked = pool.where("vec_id = 0").agg(F.min("embedding").alias("e"))
    return pool.join(F.broadcast(asked)).select("vec_id", r6(N.semantic_match(N.cosine(F.col("embedding"), F.col("e")))).alias("match"))  # one row


SQL_LEXICAL = "len(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda t: t IN ('thing', 'free', 'casino', 'the', 'stupid')))"


@query(f"WITH {SQL_ITEMS}, h AS (SELECT id, {SQL_LEXICAL} AS hits FROM items) SELECT id, hits FROM h WHERE hits > 0 ORDER BY hits DESC, id LIMIT 50")
def lexical_rank(spark, sf):
    return retrieve.lexical_rank(items(spark, sf), "text", "thing free casino the stupid", 50).select("id", "hits")


@query(
    f"""WITH {SQL_ITEMS}, h AS (SELECT id, {SQL_LEXICAL} AS hits FROM items), a AS (SELECT id, row_number() OVER (ORDER BY hits DESC, id) AS rank FROM h WHERE hits > 0 QUALIFY rank <= 30),
    b AS (SELECT id, row_number() OVER (ORDER BY published_at DESC, id) AS rank FROM items QUALIFY rank <= 30), t AS (SELECT id, rank * 2 AS turn FROM a UNION ALL SELECT id, rank * 2 + 1 FROM b)
    SELECT id, min(turn) AS turn FROM t GROUP BY id ORDER BY 2 LIMIT 40"""
)
def hybrid_candidates(spark, sf):
    rows = items(spark, sf)
    rank = lambda df, *order: df.select("id", F.row_number().over(Window.orderBy(*order)).alias("rank"))  # noqa: E731  of 30 rows
    words = rank(retrieve.lexical_rank(rows, "text", "thing free casino the stupid", 30), F.col("hits").desc(), "id")
    newest = rows.orderBy(F.col("published_at").desc(), "id").limit(30)
    return retrieve.alternate(words, rank(newest, F.col("published_at").desc(), "id"), "id", 40).select("id", F.col("turn").cast("long").alias("turn"))


@query(f"WITH {SQL_ITEMS} SELECT id, round(0.7 * importance + 0.3 * pow(2, -(({NOW_MS} - published_at)::DOUBLE / 3600000) / 24), 6) AS base FROM items")
def recency_score(spark, sf):
    return items(spark, sf).select("id", r6(N.base_score(F.col("importance"), F.col("published_at"), NOW_MS)).alias("base"))


@query(
    f"""WITH {SQL_ITEMS}, b AS (SELECT id, published_at, 0 AS f FROM items WHERE id % 2 = 0 UNION ALL SELECT id, published_at, 1 FROM items WHERE id % 3 = 0),
    u AS (SELECT id, min(published_at) AS published_at FROM b GROUP BY id) SELECT id, published_at FROM u WHERE id % 10 <> 0 AND published_at >= {NOW_MS} - 86400000 * 5 ORDER BY published_at DESC, id LIMIT 300"""
)
def queue_merge(spark, sf):
    rows = items(spark, sf).select("id", "published_at")
    return ordering.merge_queue(rows.where("id % 2 = 0"), rows.where("id % 3 = 0"), rows.where("id % 10 = 0"), NOW_MS - 5 * N.DAY_MS, 300)


@query(f"WITH {SQL_ITEMS} SELECT id, source_id FROM items WHERE published_at >= {NOW_MS} - 86400000 * 10 QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY published_at DESC, id) <= 20")
def retention_prune(spark, sf):
    return ordering.prune(items(spark, sf), NOW_MS, 10 * N.DAY_MS, 20, "source_id").select("id", "source_id")


@query(f"WITH {SQL_ITEMS} SELECT id, source_id, round(importance, 2) AS importance FROM items QUALIFY row_number() OVER (PARTITION BY title ORDER BY importance DESC, id) = 1")
def first_per_headline(spark, sf):
    return ordering.first_per_key(items(spark, sf), ["title"], [F.col("importance").desc(), F.col("id")]).select("id", "source_id", F.round("importance", 2).alias("importance"))


SQL_GEO = "nodes AS (SELECT 'r' || r_regionkey AS node, 'world' AS parent, 'continent' AS level, r_name AS label FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'country', n_name FROM nation)"


@query(f"WITH {SQL_GEO}, o AS (SELECT 'n' || s_nationkey AS node, count(*) AS n FROM supplier GROUP BY 1) SELECT nodes.node, parent, level, label, coalesce(n, 0) AS outlets, CASE WHEN coalesce(n, 0) > 0 THEN 'ready' ELSE 'unknown' END AS state FROM nodes LEFT JOIN o USING (node)")
def geo_tree(spark, sf):
    outlets = table(spark, sf, "supplier").groupBy(F.concat(F.lit("n"), "s_nationkey").alias("node")).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return geo_nodes(spark, sf).join(outlets, "node", "left").select("node", "parent", "level", "label", n.alias("outlets"), F.when(n > 0, "ready").otherwise("unknown").alias("state"))


@query(f"WITH RECURSIVE {SQL_GEO}, p AS (SELECT node, parent, label AS path, 1 AS depth FROM nodes WHERE parent = 'world' UNION ALL SELECT n.node, n.parent, p.path || ' > ' || n.label, p.depth + 1 FROM nodes n JOIN p ON n.parent = p.node WHERE p.depth < 8) SELECT node, path FROM p")
def geo_path(spark, sf):
    return places.paths(geo_nodes(spark, sf)).select("node", F.array_join("labels", " > ").alias("path"))


@query("SELECT n_regionkey AS continent, s_nationkey AS country, s_suppkey AS outlet FROM supplier JOIN nation ON s_nationkey = n_nationkey QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) <= 6")
def continent_outlets_capped(spark, sf):
    told = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    told = ordering.top_per_group(told, ["s_nationkey"], [F.col("s_suppkey")], 6)
    return told.select(F.col("n_regionkey").alias("continent"), F.col("s_nationkey").alias("country"), F.col("s_suppkey").alias("outlet"))


@query("SELECT s_nationkey AS country, s_suppkey AS outlet, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS n FROM supplier")
def citation_index(spark, sf):
    n = F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.col("s_acctbal").desc(), "s_suppkey"))
    return table(spark, sf, "supplier").select(F.col("s_nationkey").alias("country"), F.col("s_suppkey").alias("outlet"), n.cast("long").alias("n"))


@query(
    f"""WITH {SQL_ITEMS} SELECT id, CASE WHEN {NOW_MS} - published_at <= 21600000 THEN 'fresh' WHEN {NOW_MS} - published_at <= 86400000 THEN 'recent' WHEN {NOW_MS} - published_at <= 604800000 OR importance > 0.9 THEN 'week' ELSE 'stale' END AS band FROM items"""
)
def recency_bands(spark, sf):
    return items(spark, sf).select("id", N.recency_band(F.col("published_at"), F.col("importance") > 0.9, NOW_MS).alias("band"))


@query(f"WITH {SQL_ITEMS}, v AS (SELECT id, published_at - 3600000 * (id % 5) AS seen FROM items WHERE id % 4 = 0) SELECT i.id FROM items i LEFT JOIN v USING (id) WHERE (v.seen IS NOT NULL AND i.published_at > v.seen) OR i.published_at >= {NOW_MS} - 7200000 ORDER BY published_at DESC, id LIMIT 100")
def last_minute(spark, sf):
    rows = items(spark, sf).select("id", "published_at")
    views = rows.where("id % 4 = 0").select("id", (F.col("published_at") - 3_600_000 * (F.col("id") % 5)).alias("seen"))
    changed = F.col("seen").isNotNull() & (F.col("published_at") > F.col("seen"))
    told = rows.join(views, "id", "left").where(changed | (F.col("published_at") >= NOW_MS - 7_200_000))
    return told.orderBy(F.col("published_at").desc(), "id").limit(100).select("id")


SQL_CODES = "list_transform(list_filter(string_split(s, ''), lambda c: c <> ''), lambda c: ascii(c)::BIGINT)"


@query(f"WITH k AS (SELECT doc_id AS id, 'https://news.example/' || doc_id AS s FROM documents) SELECT id, list_reduce(list_prepend(2166136261::BIGINT, {SQL_CODES}), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS fnv, list_reduce(list_prepend(5381::BIGINT, {SQL_CODES}), lambda h, c: xor((h * 33) % 4294967296, c)) AS mixed FROM k")
def item_hash(spark, sf):
    s = F.concat(F.lit("https://news.example/"), F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), T.fnv1a(s).alias("fnv"), F.conv(T.item_hash(s), 36, 10).cast("long").alias("mixed"))


@query("SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")
def html_title(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.html_title(F.col("html")).alias("title"))


def _sql_paragraphs() -> str:
    bare = "regexp_replace(html, '(?is)<!--.*?-->', ' ', 'g')"
    for e in T.BOILERPLATE:
        bare = f"regexp_replace({bare}, '(?is)<{e}\\b[^>]*>.*?</{e}>', ' ', 'g')"
    text = f"regexp_replace(regexp_replace(regexp_replace({bare}, '(?i)</(p|div|section|li|h[1-6]|br|tr)>', chr(10) || chr(10), 'g'), '(?i)<br\\s*/?>', chr(10), 'g'), '<[^>]*>', ' ', 'g')"
    for entity, sign in (("nbsp", " "), ("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''")):
        text = f"regexp_replace({text}, '&{entity};', '{sign}', 'gi')"
    return f"list_filter(list_transform(string_split_regex({text}, '\\n{{2,}}'), lambda p: trim(regexp_replace(regexp_replace(p, '[ \\t]+', ' ', 'g'), '\\s*\\n\\s*', ' ', 'g'))), lambda p: length(p) >= 40)"


@query(f"SELECT page_id, len(p)::BIGINT AS paragraphs, md5(array_to_string(p, chr(10))) AS digest FROM (SELECT page_id, {_sql_paragraphs()} AS p FROM pages)")
def html_text(spark, sf):
    p = T.html_paragraphs(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.size(p).cast("long").alias("paragraphs"), F.md5(F.array_join(p, "\n")).alias("digest"))


@query(f"SELECT page_id, {SQL_HOST} AS host, coalesce({SQL_HOST} = 'example.net' OR ends_with({SQL_HOST}, '.example.net'), false) AS paywall FROM pages")
def url_host_paywall(spark, sf):
    host = T.url_host(F.col("url"))
    return table(spark, sf, "pages").select("page_id", host.alias("host"), T.host_is_under(host, ["example.net"]).alias("paywall"))


@query("SELECT c_custkey AS id, round(cos(radians(lat)) * cos(radians(-lon)), 6) + 0.0 AS x, round(sin(radians(lat)), 6) + 0.0 AS y, round(cos(radians(lat)) * sin(radians(-lon)), 6) + 0.0 AS z FROM (SELECT c_custkey, (c_custkey * 37) % 181 - 90 AS lat, (c_custkey * 101) % 361 - 180 AS lon FROM customer)")
def latlon_vec3(spark, sf):
    k = F.col("c_custkey")
    x, y, z = N.on_sphere(((k * 37) % 181 - 90).cast("double"), ((k * 101) % 361 - 180).cast("double"))
    return table(spark, sf, "customer").select(k.alias("id"), (r6(x) + 0.0).alias("x"), (r6(y) + 0.0).alias("y"), (r6(z) + 0.0).alias("z"))


@query("SELECT label, j - 1 AS j, round(avg(e), 6) + 0.0 AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) AS j FROM embeddings) GROUP BY ALL")
def centroid_by_label(spark, sf):
    exploded = table(spark, sf, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("j", "e"))
    return exploded.groupBy("label", F.col("j").cast("long").alias("j")).agg((r6(F.avg("e")) + 0.0).alias("mean"))


@query("SELECT (c_custkey * 37) % 19 AS x, (c_custkey * 101) % 23 AS y, count(*) AS n, round(max(c_acctbal), 2) AS top, bool_or(c_mktsegment = 'BUILDING') AS developing FROM customer GROUP BY 1, 2")
def location_rollup(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").groupBy(((k * 37) % 19).alias("x"), ((k * 101) % 23).alias("y")).agg(F.count("*").alias("n"), F.round(F.max("c_acctbal"), 2).alias("top"), F.bool_or(F.col("c_mktsegment") == "BUILDING").alias("developing"))


@query("SELECT o_custkey AS provider, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate DESC, o_orderkey) AS turn FROM orders QUALIFY turn <= 3")
def order_backlog(spark, sf):
    told = ordering.interleave_by_provider(table(spark, sf, "orders"), "o_custkey", [F.col("o_orderpriority"), F.col("o_orderdate").desc(), F.col("o_orderkey")], cap=3)
    return told.select(F.col("o_custkey").alias("provider"), F.col("o_orderkey").alias("id"), F.col("turn").cast("long").alias("turn"))


@query("SELECT event_type, epoch_ms(time_bucket(INTERVAL 2 HOUR, ts)) AS start_ms, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_activity(spark, sf):
    events = table(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))
    told = events.groupBy("event_type", F.window("t", "2 hours").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return told.select("event_type", F.unix_millis("w.start").alias("start_ms"), "n", "total")


#: The driver's kinds of events as stages.
STAGE_OF = {"purchase": "analyzing", "signup": "triage", "error": "embedding", "click": "synthesizing", "view": "fetching"}


@query(
    f"""WITH t AS (SELECT user_id, event_id, {_case('event_type', STAGE_OF)} AS stage FROM events WHERE event_id % 3 = 0), p AS (SELECT *, list_position(['analyzing', 'triage', 'transcripts', 'embedding', 'synthesizing', 'fetching'], stage) AS p FROM t)
    SELECT u.user_id, stage, event_id FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY p, event_id) = 1) USING (user_id)"""
)
def dominant_activity(spark, sf):
    """The stage that is told of each reader: of the running tasks (every third event) the first stage in the fixed order, its first task; null without any."""
    events = table(spark, sf, "events")
    stage = F.element_at(F.create_map(*(F.lit(x) for pair in STAGE_OF.items() for x in pair)), F.col("event_type"))
    tasks = events.where("event_id % 3 = 0").select("user_id", "event_id", stage.alias("stage"))
    told = aggregate.dominant(tasks, "user_id", "stage", "event_id")
    return events.select("user_id").distinct().join(told, "user_id", "left")


@query(f"WITH {SQL_ITEMS} SELECT lang, {SQL_BUCKET} AS bucket, grouping_id(lang, bucket) AS level, count(*) AS n FROM items GROUP BY ROLLUP (lang, bucket)")
def topic_lean_rollup(spark, sf):
    rows = items(spark, sf).withColumn("bucket", N.lean_bucket(F.col("lean")))
    return rows.rollup("lang", "bucket").agg(F.grouping_id().alias("level"), F.count("*").alias("n"))


@query()
def event_categories(spark, sf):
    topic = F.element_at(F.array(*(F.lit(x) for x in TOPICS)), (F.col("topic") + 1).cast("int"))
    told = items(spark, sf).withColumn("category", T.event_category(F.concat_ws(" ", "title", "summary"), topic))
    return told.groupBy("category").agg(F.count("*").alias("n"))


def with_vectors(spark, sf, rows):
    """Items with a vector: five ids in a row share that of the first; every fourth item has none."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("_v"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.withColumn("_k", F.when(F.col("id") % 4 != 0, F.expr("id div 5 * 5"))).join(vectors, F.col("_k") == F.col("_v"), "left").drop("_k", "_v")


def _ranked(spark, sf):
    rows = items(spark, sf).where("not clickbait")
    return rows.withColumn("base", F.round(N.base_score(F.col("importance"), F.col("published_at"), NOW_MS), 9))


@query()
def rank_mmr(spark, sf):
    """The diversified ranking of each language's world."""
    return greedy.rank_items(_ranked(spark, sf), "lang", 50).select("lang", "position", "id", r6(F.col("adjusted")).alias("adjusted"))


@query()
def near_clones(spark, sf):
    return greedy.near_clones(items(spark, sf))


@query()
def event_clusters(spark, sf):
    """Items of each source clustered to events, by vectors where they have one, else by the words of their titles."""
    rows = with_vectors(spark, sf, items(spark, sf)).withColumn("tokens", T.title_tokens(F.col("title")))
    return greedy.event_clusters(rows, "source_id")


@query()
def build_feeds(spark, sf):
    """A balanced feed for the reader of each language."""
    rows = _ranked(spark, sf).withColumn("minutes", N.read_minutes(F.col("text")).cast("double"))
    return greedy.build_feeds(rows.withColumn("relevance", F.col("base")), "lang", 60.0)
