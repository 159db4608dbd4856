"""Queries on places. Nations are the countries, customers the cities, suppliers the gatherings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrand.functions import numbers as N
from lodestrand.operators import greedy, places
from lodestrand.plans.adapters import geo_nodes, items, table
from lodestrand.plans.queries import SQL_GEO, SQL_ITEMS, r6
from lodestrand.plans.registry import query

CHAIN = [{"level": "country", "label": "Free", "aliases": ["the", "free"]}, {"level": "region", "label": "Casino", "aliases": ["casino", "Der "]}, {"level": "locality", "label": "Of the", "aliases": ["of the", "thing"]}]


def _sql_score(text: str) -> str:
    has = lambda w: f"list_contains(w, '{w}')::INT"
    return f"(SELECT {has('the')} + {has('free')} + 2 * ({has('casino')} + {has('der')}) + 3 * (contains(' ' || lower({text}) || ' ', 'of the')::INT + {has('thing')}) FROM (SELECT string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}]+') AS w))"


@query(f"WITH {SQL_ITEMS}, s AS (SELECT id, importance, {_sql_score("coalesce(text, '')")}::BIGINT AS score FROM items) SELECT id, score, round(CASE WHEN score > 0 THEN least(1, importance + 0.5 * least(1, score / 3) * (1 - importance)) ELSE importance END, 6) AS relevance FROM s")
def place_scores(spark, sf):
    told = items(spark, sf).select("id", "importance", places.place_score(F.col("text"), CHAIN).cast("long").alias("score"))
    return told.select("id", "score", r6(places.boosted(F.col("importance"), F.col("score"))).alias("relevance"))


SQL_CITIES = "cities AS (SELECT 'town ' || (c_custkey % 40) AS key, 'n' || c_nationkey AS cc, (c_custkey * 37) % 181 - 90.0 AS lat, (c_custkey * 101) % 361 - 180.0 AS lon, c_custkey % 97 AS pop FROM customer)"
SQL_WANTED = "wanted AS (SELECT s_suppkey AS id, 'Tówn-' || (s_suppkey % 45) AS place, 'n' || s_nationkey AS iso2, (s_suppkey * 7) % 150 - 75.0 AS said_lat, (s_suppkey * 11) % 300 - 150.0 AS said_lon FROM supplier)"
SQL_FOUND = f"""{SQL_CITIES}, {SQL_WANTED}, f AS (SELECT w.*, c.lat, c.lon FROM wanted w LEFT JOIN cities c ON c.key = replace(replace(lower(w.place), 'ó', 'o'), '-', ' ')
    QUALIFY row_number() OVER (PARTITION BY w.id ORDER BY c.cc = w.iso2 DESC NULLS LAST, pop DESC, c.lat DESC, c.lon DESC) = 1)"""


def _cities(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(F.concat(F.lit("town "), (k % 40).cast("string")).alias("key"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("cc"), ((k * 37) % 181 - 90.0).alias("lat"), ((k * 101) % 361 - 180.0).alias("lon"), (k % 97).alias("pop"))


def _wanted(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(k.alias("id"), F.concat(F.lit("Tówn-"), (k % 45).cast("string")).alias("place"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("iso2"), ((k * 7) % 150 - 75.0).alias("said_lat"), ((k * 11) % 300 - 150.0).alias("said_lon"))


@query(f"WITH {SQL_FOUND} SELECT id, lat::DOUBLE AS lat, lon::DOUBLE AS lon FROM f")
def city_lookup(spark, sf):
    return places.lookup_cities(_wanted(spark, sf), _cities(spark, sf)).select("id", "lat", "lon")


@query(
    f"""WITH {SQL_FOUND}, n AS (SELECT 'n' || n_nationkey AS iso2, n_nationkey AS k FROM nation), b AS (SELECT iso2, k * 5 - 60.0 AS lo FROM n WHERE k % 3 <> 0)
    SELECT f.id, CASE WHEN lat IS NOT NULL THEN 'city' WHEN b.iso2 IS NULL OR (said_lat BETWEEN lo - 1.5 AND lo + 31.5) THEN 'said' WHEN n.k % 2 = 0 THEN 'country' END AS by,
    CASE WHEN lat IS NOT NULL THEN lat WHEN b.iso2 IS NULL OR (said_lat BETWEEN lo - 1.5 AND lo + 31.5) THEN said_lat WHEN n.k % 2 = 0 THEN n.k END::DOUBLE AS lat FROM f LEFT JOIN b USING (iso2) LEFT JOIN n USING (iso2)"""
)
def gathering_points(spark, sf):
    k = F.col("n_nationkey")
    nations = table(spark, sf, "nation").select(k.alias("k"), F.concat(F.lit("n"), k.cast("string")).alias("iso2"))
    boxes = nations.where("k % 3 <> 0").select("iso2", (F.col("k") * 5 - 60.0).alias("min_lat"), (F.col("k") * 5 - 30.0).alias("max_lat"), F.lit(-180.0).alias("min_lon"), F.lit(180.0).alias("max_lon"))
    centres = nations.where("k % 2 = 0").select("iso2", F.col("k").cast("double").alias("lat"), F.lit(0.0).alias("lon"))
    return places.geocode(_wanted(spark, sf), _cities(spark, sf), boxes, centres).select("id", "by", "lat")


SQL_TOLD = "told AS (SELECT o_orderkey AS story, 'News of ' || lower(a.n_name) || ' and ' || b.n_name || '.' AS title, o_orderkey % 7 = 0 AS zoned, 'n' || (o_orderkey % 30) AS zone FROM orders JOIN nation a ON a.n_nationkey = o_orderkey % 25 JOIN nation b ON b.n_nationkey = (o_orderkey // 25) % 25)"
SQL_NAMES = "names AS (SELECT lower(n_name) AS name, 'n' || n_nationkey AS key FROM nation)"


def _told(spark, sf):
    k, nation = F.col("o_orderkey"), table(spark, sf, "nation")
    a, b = nation.select(F.col("n_nationkey").alias("ka"), F.col("n_name").alias("a")), nation.select(F.col("n_nationkey").alias("kb"), F.col("n_name").alias("b"))
    rows = table(spark, sf, "orders").select(k.alias("story"))
    rows = rows.join(a, F.col("story") % 25 == F.col("ka")).join(b, F.expr("(story div 25) % 25") == F.col("kb"))
    return rows.select("story", F.concat(F.lit("News of "), F.lower("a"), F.lit(" and "), "b", F.lit(".")).alias("title"), F.lit("").alias("summary"))


def _names(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("key"))


@query(
    f"""WITH {SQL_TOLD}, {SQL_NAMES}, l AS (SELECT story, key FROM told JOIN names ON contains(lower(title), name) QUALIFY row_number() OVER (PARTITION BY story ORDER BY length(name) DESC, name) = 1)
    SELECT told.story, CASE WHEN zoned AND zone IN (SELECT key FROM names) THEN zone ELSE key END AS iso2 FROM told LEFT JOIN l USING (story)"""
)
def located_stories(spark, sf):
    zones = table(spark, sf, "orders").where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("story"), F.posexplode(F.array(F.lit("zz"), F.concat(F.lit("n"), (F.col("o_orderkey") % 30).cast("string")))).alias("position", "zone"))
    names = _names(spark, sf)
    return places.locate(_told(spark, sf), zones, names.select(F.col("key").alias("iso2")), places.bounded_names(names))


@query(
    f"""WITH {SQL_TOLD}, {SQL_NAMES}, f AS (SELECT story, key, length(name) AS n, name FROM told JOIN names ON length(name) >= 4 AND regexp_matches(lower(title), '(?:^|[^a-z])' || name || '(?:[^a-z]|$)'))
    SELECT told.story, coalesce(string_agg(key, ',' ORDER BY n DESC, name), '') AS keys FROM told LEFT JOIN f USING (story) GROUP BY told.story"""
)
def mentioned_countries(spark, sf):
    names = places.bounded_names(_names(spark, sf))
    return _told(spark, sf).select("story", F.array_join(places.named_places(F.col("title"), names), ",").alias("keys"))


@query(
    f"""WITH {SQL_NAMES}, a AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'n' || (o_orderkey % 40) END AS iso2, o_orderkey % 25 AS k, o_orderkey % 2 = 0 AS whole FROM orders)
    SELECT id, CASE WHEN iso2 IN (SELECT key FROM names) THEN iso2 ELSE 'n' || k END AS key FROM a"""
)
def resolved_answers(spark, sf):
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").join(table(spark, sf, "nation"), k % 25 == F.col("n_nationkey"))
    label = F.when(k % 2 == 0, F.initcap("n_name")).otherwise(F.concat(F.lit("Nowhere / "), "n_name", F.lit(" and "), F.lit("France")))
    answers = rows.select(k.alias("id"), label.alias("label"), F.when(k % 3 == 0, F.concat(F.lit("N"), (k % 40).cast("string"))).alias("iso2"))
    return places.resolve_answers(answers, _names(spark, sf))


@query(
    f"""WITH {SQL_GEO}, s AS (SELECT label, level, CASE WHEN lower(label) = 'i' THEN 4 WHEN starts_with(lower(label), 'i') THEN 3 WHEN regexp_matches(lower(label), '\\si') THEN 2 WHEN contains(lower(label), 'i') THEN 1 ELSE 0 END::BIGINT AS score FROM nodes)
    SELECT label, level, score FROM s WHERE score > 0 ORDER BY score DESC, level <> 'country', length(label), label LIMIT 8"""
)
def place_search(spark, sf):
    return places.search_places(geo_nodes(spark, sf), " I ")


@query(
    """WITH c AS (SELECT 'n' || n_nationkey AS code, n_name AS name, n_regionkey + 1 AS outlets FROM nation WHERE n_nationkey % 2 = 0), p AS (SELECT c_custkey AS province, 'n' || c_nationkey AS code, 'N' || (c_custkey % 50) AS wide, c_custkey % 25 AS k FROM customer)
    SELECT province, coalesce(a.outlets, b.outlets, d.outlets, 0)::BIGINT AS outlets FROM p LEFT JOIN c a ON a.code = p.code LEFT JOIN c b ON b.code = lower(wide) LEFT JOIN nation n ON n_nationkey = k LEFT JOIN c d ON d.name = n.n_name"""
)
def covered_provinces(spark, sf):
    k = F.col("c_custkey")
    coverage = _names(spark, sf).join(table(spark, sf, "nation"), F.col("name") == F.col("n_name")).where("n_nationkey % 2 = 0").select(F.col("key").alias("code"), "name", (F.col("n_regionkey") + 1).cast("long").alias("outlets"))
    named = table(spark, sf, "nation").select((F.col("n_nationkey")).alias("_k"), F.lower("n_name").alias("community"))
    provinces = table(spark, sf, "customer").join(named, k % 25 == F.col("_k")).select(k.alias("province"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("code"), F.concat(F.lit("N"), (k % 50).cast("string")).alias("community_code"), "community")
    return places.cover_provinces(provinces, coverage)


@query(f"SELECT p_partkey AS id FROM part WHERE contains(lower(p_name), 'a') AND NOT regexp_matches(p_name || ' ' || p_type, '{places.UNFIT}')")
def picked_collections(spark, sf):
    return places.pick_collections(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description")), "A").select("id")


@query()
def marker_clusters(spark, sf):
    """Customers of each nation as markers, those near a stronger one merged with it."""
    k = F.col("c_custkey")
    x, y, z = N.on_sphere(((k * 37) % 181 - 90).cast("double"), ((k * 101) % 361 - 180).cast("double"))
    return greedy.point_clusters(table(spark, sf, "customer").select(F.col("c_nationkey").alias("layer"), k.alias("id"), F.col("c_acctbal").cast("double").alias("severity"), x.alias("x"), y.alias("y"), z.alias("z")), "layer")
