"""Queries on interests, shortlists, sections of a feed, and pages as text."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrand.functions import reading as R
from lodestrand.functions import text as T
from lodestrand.functions.replies import ENTITIES
from lodestrand.operators import ordering, stories
from lodestrand.plans.adapters import NOW_MS, items, table
from lodestrand.plans.queries import SQL_ITEMS, r6, with_vectors
from lodestrand.plans.registry import query

STOP = ", ".join(f"'{w}'" for w in R.INTEREST_STOP)
SQL_WORDS = f"list_filter(string_split_regex(lower(coalesce(title, '') || ' ' || coalesce(summary, '')), '[^a-z0-9]+'), lambda t: length(t) >= 2 AND t NOT IN ({STOP}))"
SQL_MATCH = f"""((list_has_any(w, ['energy', {', '.join(repr(x) for x in R.SYNONYMS['energy'])}]) OR len(list_filter(w, lambda x: length(x) >= 5 AND (starts_with(x, 'energy') OR starts_with('energy', x)))) > 0)::INT + list_contains(w, 'die')::INT
    + (list_contains(w, 'things') OR len(list_filter(w, lambda x: length(x) >= 5 AND (starts_with(x, 'things') OR starts_with('things', x)))) > 0)::INT) / 3"""


@query(
    f"""WITH {SQL_ITEMS}, m AS (SELECT id, importance, {SQL_WORDS} AS w FROM items), s AS (SELECT id, {SQL_MATCH} AS match, CASE WHEN id % 4 = 0 THEN least(0.6, CASE WHEN id % 8 = 0 THEN 0.9 ELSE 0.4 END) ELSE importance END AS weight FROM m)
    SELECT id, round(match, 6) AS match, round(greatest(0, least(1, 0.6 * match + 0.4 * weight)), 6) AS relevance FROM s"""
)
def interest_relevance(spark, sf):
    rows = items(spark, sf).withColumn("words", R.interest_words(F.concat_ws(" ", "title", "summary")))
    rows = rows.withColumn("match", R.interest_match("the energy of die things", F.col("words")))
    score = R.relevance(F.col("importance"), F.col("match"), F.col("id") % 4 == 0, F.when(F.col("id") % 8 == 0, 0.9))
    return rows.select("id", r6(F.col("match")).alias("match"), r6(score).alias("relevance"))


@query(
    f"""WITH {SQL_ITEMS}, s AS (SELECT id, (CASE WHEN topic IN (1, 5) THEN 3 ELSE 0 END) + contains(lower(coalesce(title, '') || ' ' || coalesce(summary, '')), 'thing')::INT + contains(lower(coalesce(title, '') || ' ' || coalesce(summary, '')), 'free')::INT + 0.5 * importance AS score FROM items WHERE id % 3 <> 0)
    SELECT id, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 12"""
)
def knowledge_picks(spark, sf):
    rows, hay = items(spark, sf), F.lower(F.concat_ws(" ", "title", "summary"))
    told = rows.where("id % 3 = 0").select("id")
    score = F.when(F.col("topic").isin(1, 5), 3).otherwise(0) + sum(F.contains(hay, F.lit(w)).cast("int") for w in ("thing", "free")) + 0.5 * F.col("importance")
    rows = rows.join(told, "id", "left_anti").withColumn("score", score).where("score > 0")
    return rows.orderBy(F.col("score").desc(), "id").limit(12).select("id", r6(F.col("score")).alias("score"))


SQL_SIGN = f"array_to_string(list_sort(list_filter(string_split_regex(lower(q), '[^a-z0-9]+'), lambda t: length(t) >= 2 AND t NOT IN ({STOP})))[1:8], ' ')"


@query(
    f"""WITH {SQL_ITEMS}, h AS (SELECT id, importance, published_at, trim(substr(trim(regexp_replace(trim(regexp_replace(trim(coalesce(title, '')), '^["''“”]+|["''“”]+$', '', 'g')), '\\s+[-–—|]\\s+[^-–—|]{{1,40}}$', '')), 1, 120)) AS q FROM items WHERE NOT clickbait AND importance >= 0.5),
    s AS (SELECT *, {SQL_SIGN} AS sign FROM h WHERE length(q) >= 8) SELECT id, q FROM (SELECT * FROM s WHERE sign <> '' QUALIFY row_number() OVER (PARTITION BY sign ORDER BY importance DESC, published_at DESC, id) = 1) ORDER BY importance DESC, published_at DESC, id LIMIT 6"""
)
def search_seeds(spark, sf):
    order = [F.col("importance").desc(), F.col("published_at").desc(), F.col("id")]
    rows = items(spark, sf).where("not clickbait and importance >= 0.5").withColumn("q", R.headline_query(F.col("title"))).where("length(q) >= 8")
    rows = rows.withColumn("sign", F.array_join(F.slice(F.array_sort(R.interest_words(F.col("q"))), 1, 8), " ")).where("sign <> ''")
    return ordering.first_per_key(rows, ["sign"], order).orderBy(*order).limit(6).select("id", "q")


@query(
    f"""WITH {SQL_ITEMS}, h AS (SELECT id, floor(({NOW_MS} - published_at) / 3600000 + 0.5)::BIGINT AS h FROM items) SELECT id, CASE WHEN h < 1 THEN 'just now' WHEN h < 24 THEN h || 'h ago' ELSE floor(h / 24 + 0.5)::BIGINT || 'd ago' END AS age FROM h"""
)
def relative_ages(spark, sf):
    return items(spark, sf).select("id", R.relative_age(F.col("published_at"), NOW_MS).alias("age"))


@query(
    """SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 AND doc_id % 7 * 60 + doc_id % 60 > 0 THEN greatest(1, floor((doc_id % 7 * 60 + doc_id % 60) / 60 + 0.5))::BIGINT WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 5 = 0 THEN 4 ELSE greatest(1, floor(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) / 200 + 0.5))::BIGINT END
    WHEN doc_id % 7 = 0 THEN 35 ELSE 12 END AS minutes FROM documents"""
)
def item_minutes(spark, sf):
    n = F.col("doc_id")
    rows = table(spark, sf, "documents")
    kind = F.when(n % 2 == 0, "news").when(n % 7 == 0, "podcast").otherwise("video")
    said = F.when(n % 3 == 0, F.concat((n % 7).cast("string"), F.lit(":"), F.lpad((n % 60).cast("string"), 2, "0")))
    return rows.select(n.alias("id"), R.minutes(kind, said, F.when(n % 5 != 0, F.col("text"))).cast("long").alias("minutes"))


@query(
    f"""WITH {SQL_ITEMS}, r AS (SELECT topic, id, id % 4 = 0 AS seen, row_number() OVER (PARTITION BY topic ORDER BY id % 4 = 0, importance DESC, published_at DESC, id) AS position FROM items WHERE NOT clickbait AND NOT (id // 12 % 2 = 0 AND importance > 0.8))
    SELECT topic, position, id, seen FROM r WHERE position <= 20"""
)
def topic_sections(spark, sf):
    """Items of each topic, what was read last; items that a shown story absorbed don't stand alone."""
    rows = items(spark, sf).where("not clickbait").withColumn("seen", F.col("id") % 4 == 0)
    absorbed = rows.where("(id div 12) % 2 = 0 and importance > 0.8").select("id")
    rows = ordering.top_per_group(rows.join(absorbed, "id", "left_anti"), ["topic"], [F.col("seen"), F.col("importance").desc(), F.col("published_at").desc(), F.col("id")], 20)
    return rows.select("topic", F.col("rank").cast("long").alias("position"), "id", "seen")


@query(f"WITH {SQL_ITEMS}, s AS (SELECT unnest([0, 1, 2]) AS story), m AS (SELECT story, id FROM s, items WHERE (story = 0 AND id % 6 = 0) OR (story = 1 AND id % 4 = 0) OR (story = 2 AND id % 10 = 0)) SELECT i.id, min(story)::BIGINT AS issue FROM items i LEFT JOIN m USING (id) GROUP BY i.id")
def first_issue(spark, sf):
    rows = items(spark, sf)
    tagged = rows.select("id", F.explode(F.array_compact(F.array(*(F.when(F.col("id") % m == 0, F.lit(s).cast("long")) for s, m in ((0, 6), (1, 4), (2, 10)))))).alias("issue"))
    return rows.select("id").join(tagged.groupBy("id").agg(F.min("issue").alias("issue")), "id", "left")


def sql_decoded(text: str) -> str:
    """Named entities decoded three times over, the ampersand last in each pass, so that none is decoded twice in one."""
    for _ in range(3):
        for name, sign in reversed(ENTITIES.items()):
            text = f"regexp_replace({text}, '&{name};', '{sign.replace(chr(39), chr(39) * 2)}', 'gi')"
    return text


@query(f"""SELECT page_id, trim({sql_decoded("t")}) AS title FROM (SELECT page_id, coalesce(nullif(regexp_extract(html, '(?i)<meta[^>]+property=["'']og:title["''][^>]+content=["'']([^"'']+)["'']', 1), ''),
    nullif(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), ''), regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '') AS t FROM pages)""")
def page_titles(spark, sf):
    return table(spark, sf, "pages").select("page_id", R.page_title(F.col("html")).alias("title"))


@query(
    """WITH r AS (SELECT page_id, html, regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1) AS a, regexp_extract(html, '(?is)<main[^>]*>(.*?)</main>', 1) AS m, regexp_extract(html, '(?is)<body[^>]*>(.*?)</body>', 1) AS b FROM pages)
    SELECT page_id, md5(CASE WHEN length(a) > 400 THEN a WHEN length(m) > 400 THEN m WHEN regexp_matches(html, '(?is)<body[^>]*>.*?</body>') THEN b ELSE html END) AS digest FROM r"""
)
def page_regions(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(R.main_region(F.col("html"))).alias("digest"))


@query(
    """WITH l AS (SELECT doc_id, unnest(s) AS p, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '[^\\p{L}\\p{N} .,\\n]', '', 'g'), chr(10)) AS s FROM documents)),
    k AS (SELECT doc_id, i, trim(regexp_replace(p, ' +', ' ', 'g')) AS p FROM l), g AS (SELECT doc_id, count(*) AS n, md5(string_agg(p, chr(10) || chr(10) ORDER BY i)) AS text FROM k WHERE length(p) >= 40 GROUP BY doc_id)
    SELECT doc_id AS id, coalesce(g.text, md5('')) AS text FROM documents LEFT JOIN g USING (doc_id)"""
)
def markdown_pages(spark, sf):
    """Whole documents told as Markdown, their lines as headings, lists in bold, links and lines with an image."""
    lines = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{L}\p{N} .,\n]", ""), "\n")
    told = lambda x, i: F.when(i % 4 == 0, F.concat(F.lit("## "), x)).when(i % 4 == 1, F.concat(F.lit("- **"), x, F.lit("**"))).when(i % 4 == 2, F.concat(F.lit("["), x, F.lit("](http://x)"))).otherwise(F.concat(F.lit("![a picture](y)\n"), x))
    page = F.concat(F.lit("Title: x\nMarkdown Content:\n"), F.array_join(F.transform(lines, told), "\n\n"))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.md5(R.markdown_text(page)).alias("text"))


@query(
    f"""WITH {SQL_ITEMS}, c AS (SELECT id, topic, list_distinct(list_filter(string_split_regex(lower(title), '[^a-z0-9]+'), lambda t: length(t) >= 2)) AS w, embedding::DOUBLE[] AS v FROM items LEFT JOIN embeddings ON id % 4 <> 0 AND vec_id = id // 5 * 5), q AS (SELECT * FROM c WHERE id % 20 = 3 OR id % 20 = 8),
    p AS (SELECT q.id, c.id AS other, CASE WHEN q.v IS NOT NULL THEN round(list_cosine_similarity(q.v, c.v), 9) ELSE len(list_intersect(q.w, c.w)) + (q.topic = c.topic)::INTEGER END AS score FROM q JOIN c ON q.id <> c.id WHERE CASE WHEN q.v IS NOT NULL THEN c.v IS NOT NULL ELSE len(list_intersect(q.w, c.w)) > 0 OR q.topic = c.topic END)
    SELECT id, other, round(score, 6) AS score FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, other) <= 6"""
)
def related_items(spark, sf):
    """What is shown beside some items (one in ten, half of them without a vector): the nearest by vector, or by words and topic."""
    rows = with_vectors(spark, sf, items(spark, sf)).select("id", "topic", F.array_distinct(T.ascii_tokens(F.col("title"), 2)).alias("keywords"), F.col("embedding").alias("vector"))
    found = stories.related_items(rows, (F.col("id") % 20).isin(3, 8))
    return found.select("id", "other", r6(F.col("score")).alias("score"))
