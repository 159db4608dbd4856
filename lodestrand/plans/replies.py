"""Queries on model replies. The replies are made from the lines of whole documents by a fixed rule, so SQL can tell what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrand.functions import replies as R
from lodestrand.plans.adapters import table
from lodestrand.plans.registry import query

#: Signs that mean something in JSON or around it; lines are told without them.
SIGNS = '[]{}`"\\'
LANG = "coalesce(lang, 'zz')"
SQL_LINES = f"""d AS (SELECT doc_id, {LANG} AS lang, coalesce(source, '') AS source, string_split(translate(coalesce(text, ''), '{SIGNS}', ''), chr(10)) AS s FROM documents),
    l AS (SELECT doc_id, lang, source, unnest(s) AS line, generate_subscripts(s, 1) AS i FROM d)"""
SQL_KIND = "substr(trim(regexp_replace(lower(trim({})), '[^a-z0-9]+', '-', 'g'), '-'), 1, 24)"


def document_lines(spark, sf):
    """doc_id, lang, source, lines: every line of a document, without SIGNS."""
    docs = table(spark, sf, "documents")
    text = F.translate(F.coalesce("text", F.lit("")), SIGNS, "")
    return docs.select("doc_id", F.expr(LANG).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.split(text, "\n").alias("lines"))


def _fenced(said):
    return F.concat(F.lit("Sure:\n```json\n"), said, F.lit("\n``` done"))


def _word(line, n=0):
    return F.coalesce(F.get(F.split(line, " "), F.lit(n)), F.lit(""))


@query(
    f"""WITH {SQL_LINES}, r AS (SELECT doc_id, i, lang AS f, ['us', 'fr', 'de', 'it'][length(line) % 4 + 1] AS t, {SQL_KIND.format("split_part(line, ' ', 1)")} AS kind FROM l),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, t ORDER BY i) AS again FROM r WHERE regexp_full_match(f, '[a-z]{{2}}') AND f <> t AND kind <> ''),
    g AS (SELECT doc_id, string_agg(f || '>' || t || ':' || kind, ' ' ORDER BY i) AS links FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM k WHERE again = 1) WHERE n <= 4 GROUP BY doc_id)
    SELECT doc_id, coalesce(links, '') AS links FROM documents LEFT JOIN g USING (doc_id)"""
)
def reply_links(spark, sf):
    """Every line as a link from the document's language to a country, of the kind that its first word names."""
    to = lambda x: F.get(F.array(*(F.lit(c) for c in ("us", "fr", "de", "it"))), F.length(x) % 4)
    rows = document_lines(spark, sf).select("doc_id", F.transform("lines", lambda x: F.struct(F.upper("lang").alias("from"), to(x).alias("to"), _word(x).alias("kind"))).alias("said"))
    told = R.links(R.reply_array(_fenced(F.to_json("said"))))
    return rows.select("doc_id", F.array_join(F.transform(told, lambda r: F.concat(r["from"], F.lit(">"), r["to"], F.lit(":"), r["kind"])), " ").alias("links"))


@query(
    f"""WITH {SQL_LINES}, c AS (SELECT doc_id, CASE WHEN length(s[-1]) % 2 = 1 THEN s[:-2] ELSE s END AS s FROM d) SELECT doc_id, len(s)::BIGINT AS n, md5(array_to_string(s, '|')) AS digest FROM c"""
)
def reply_salvage(spark, sf):
    """An object for each line; where the last line's length is odd the reply ends within its object, which is lost alone."""
    last = F.element_at("lines", -1)
    said = F.concat(F.lit("Sure: "), F.to_json(F.transform("lines", lambda x: F.struct(x.alias("text")))))
    reply = F.when(F.length(last) % 2 == 1, F.expr("left(said, length(said) - length(last) div 2 - 4)")).otherwise(F.col("said"))
    rows = document_lines(spark, sf).withColumns({"said": said, "last": last}).select("doc_id", reply.alias("reply"))
    found = rows.select("doc_id", F.transform(R.elements(R.reply_array(F.col("reply"))), lambda x: R.text_of(x, "$.text")).alias("found"))
    return found.select("doc_id", F.size("found").cast("long").alias("n"), F.md5(F.array_join("found", "|")).alias("digest"))


@query(
    f"""WITH {SQL_LINES}, r AS (SELECT doc_id, i, {SQL_KIND.format("split_part(line, ' ', 1)")} AS kind, substr(trim(line), 1, 80) AS place, lang AS iso2, length(line) AS n,
    list_filter([lang, CASE WHEN lang <> 'us' THEN 'us' END, CASE WHEN lower(trim(split_part(line, ' ', 2))) NOT IN (lang, 'us') THEN lower(trim(split_part(line, ' ', 2))) END], lambda c: regexp_full_match(c, '[a-z]{{2}}')) AS parties FROM l),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(place) ORDER BY i) AS again FROM r WHERE place <> '' AND regexp_full_match(iso2, '[a-z]{{2}}') AND len(parties) >= 2)
    SELECT doc_id, CASE WHEN kind = '' THEN 'other' ELSE kind END AS kind, md5(place) AS place, iso2, array_to_string(parties, ',') AS parties, CASE WHEN n % 200 <= 90 THEN (n % 200)::DOUBLE END AS lat FROM k WHERE again = 1 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= 3"""
)
def reply_gatherings(spark, sf):
    """Every line as an event: its kind, place and parties from its words, its latitude from its length."""
    event = lambda x: F.struct(
        _word(x).alias("kind"), x.alias("place"), F.upper("lang").alias("iso2"), F.array(F.col("lang"), F.lit("US"), _word(x, 1)).alias("parties"), F.concat((F.length(x) % 200).cast("string"), F.lit(", 6.5")).alias("coords")
    )
    rows = document_lines(spark, sf).select("doc_id", F.transform("lines", event).alias("said"))
    told = rows.select("doc_id", F.explode(R.gatherings(R.reply_array(_fenced(F.to_json("said"))))).alias("g"))
    return told.select("doc_id", "g.kind", F.md5("g.place").alias("place"), "g.iso2", F.array_join("g.parties", ",").alias("parties"), F.col("g.at.lat").alias("lat"))


@query(
    f"""WITH {SQL_LINES}, w AS (SELECT doc_id, lang, source, s, length(s[1]) AS n, list_transform(string_split(s[1], ' '), lambda x: lower(trim(x))) AS k FROM d),
    g AS (SELECT doc_id, n, lang, list_filter(k, lambda x: regexp_matches(x, '^[a-z]+$')) AS k, coalesce(s[2], '') AS said FROM w)
    SELECT doc_id, CASE n % 3 WHEN 0 THEN 'world' ELSE 'culture' END AS topic, CASE WHEN n % 4 = 0 THEN 0.25 ELSE greatest(-1, least(1, n % 5 - 2)) END::DOUBLE AS lean, n % 4 <> 0 AS refined, least(1, len(k) / 4)::DOUBLE AS importance,
    md5(trim(regexp_replace(regexp_replace(said, '[^\\p{{L}} ]', '', 'g'), '\\s+', ' ', 'g'))) AS summary, array_to_string(k[:10], ',') AS keywords,
    array_to_string(list_filter([CASE WHEN regexp_full_match(lang, '[a-z]{{2}}') THEN lang END, CASE WHEN lang <> 'us' THEN 'us' END], lambda c: c IS NOT NULL), ',') AS countries FROM g"""
)
def reply_analysis(spark, sf):
    """An analysis whose keywords are the plain words of the first line, whose summary is the letters of the second."""
    n, words = F.length(F.get("lines", F.lit(0))), F.filter(F.split(F.get("lines", F.lit(0)), " "), lambda x: F.lower(F.trim(x)).rlike("^[a-z]+$"))
    told = F.struct(
        F.when(n % 3 == 0, "World").when(n % 3 == 1, "gossip").otherwise("sport").alias("topic"), F.when(n % 4 != 0, n % 5 - 2).alias("lean"), (F.size(words) / 4).alias("importance"),
        F.regexp_replace(F.coalesce(F.get("lines", F.lit(1)), F.lit("")), r"[^\p{L} ]", "").alias("summary"), F.concat(F.array(F.lit("!!!!!!")), words).alias("keywords"), F.array(F.col("lang"), F.lit("US"), F.lit("us"), F.lit("usa")).alias("countries"),
    )
    rows = document_lines(spark, sf).select("doc_id", F.to_json(told).alias("reply")).select("doc_id", R.analysis(R.reply_object(F.col("reply")), F.lit("culture"), F.lit(0.25)).alias("a"))
    return rows.select("doc_id", "a.topic", "a.lean", F.col("a.lean_refined").alias("refined"), "a.importance", F.md5("a.summary").alias("summary"), F.array_join("a.keywords", ",").alias("keywords"), F.array_join("a.countries", ",").alias("countries"))


@query(
    f"""WITH {SQL_LINES}, f AS (SELECT doc_id, length(line) % 60 AS n, min(i) AS i FROM l WHERE n BETWEEN 1 AND 40 GROUP BY ALL),
    g AS (SELECT doc_id, string_agg(n::VARCHAR, ',' ORDER BY i) AS ids FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= 30) GROUP BY doc_id) SELECT doc_id, coalesce(ids, '') AS ids FROM documents LEFT JOIN g USING (doc_id)"""
)
def reply_ids(spark, sf):
    """A number for each line, every other one as a text with letters behind it."""
    told = F.transform("lines", lambda x, i: F.when(i % 2 == 0, (F.length(x) % 60).cast("string")).otherwise(F.concat(F.lit('" '), (F.length(x) % 60).cast("string"), F.lit('th"'))))
    rows = document_lines(spark, sf).select("doc_id", _fenced(F.concat(F.lit("["), F.array_join(told, ","), F.lit(',"x"]'))).alias("reply"))
    return rows.select("doc_id", F.array_join(F.transform(R.ids(R.reply_array(F.col("reply")), 40, 30), lambda n: n.cast("string")), ",").alias("ids"))


@query(
    f"""WITH {SQL_LINES}, t AS (SELECT doc_id, i, trim(line) AS p FROM l), h AS (SELECT doc_id, p AS heading FROM t WHERE i = 1),
    k AS (SELECT doc_id, i, p FROM t JOIN h USING (doc_id) WHERE NOT regexp_matches(p, '^["''\\s,:]*$') AND NOT regexp_matches(p, '(?i)^[''"]?(title|paragraphs|content)[''"]?\\s*:?\\s*$') AND NOT regexp_matches(p, '(?i)^json\\b[\\s,]*$') AND (heading = '' OR lower(p) <> lower(heading))),
    o AS (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM k), g AS (SELECT doc_id, count(*) AS n, md5(string_agg(p, '|' ORDER BY i)) AS body FROM o WHERE before IS DISTINCT FROM p GROUP BY doc_id HAVING bool_or(length(p) >= 40 AND regexp_matches(p, '\\s')))
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n, coalesce(body, md5('')) AS body FROM documents LEFT JOIN g USING (doc_id)"""
)
def reply_paragraphs(spark, sf):
    """Every line twice as a paragraph, between what is left of JSON; the first line is the title."""
    said = F.concat(F.array(F.lit("paragraphs:"), F.lit("json [")), F.flatten(F.transform("lines", lambda x: F.array(x, F.concat(x, F.lit(" "))))))
    rows = document_lines(spark, sf).select("doc_id", F.get("lines", F.lit(0)).alias("title"), F.to_json(F.struct(said.alias("paragraphs"))).alias("reply"))
    rows = rows.select("doc_id", R.paragraphs(R.reply_object(F.col("reply")), F.col("title")).alias("p"))
    return rows.select("doc_id", F.size("p").cast("long").alias("n"), F.md5(F.array_join("p", "|")).alias("body"))


@query("SELECT doc_id, length(coalesce(text, ''))::BIGINT AS n, md5(coalesce(text, '')) AS digest FROM documents")
def entity_text(spark, sf):
    """Whole documents with signs and letters as entities, some of them encoded twice: decoded, they are the documents."""
    text = F.coalesce("text", F.lit(""))
    for sign, told in (("&", "&amp;amp;"), ("é", "&eacute;"), ("ü", "&#252;"), ("ñ", "&#xF1;"), ("ß", "&amp;#xdf;"), ("<", "&lt;"), ('"', "&quot;"), ("a", "&#97;")):
        text = F.replace(text, F.lit(sign), F.lit(told))
    return table(spark, sf, "documents").select("doc_id", R.decode_entities(text).alias("text")).select("doc_id", F.length("text").cast("long").alias("n"), F.md5("text").alias("digest"))


@query()
def stripped_pages(spark, sf):
    """Every page without tags: its length and digest."""
    text = R.strip_html(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.length(text).cast("long").alias("n"), F.md5(text).alias("digest"))
