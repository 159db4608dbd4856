"""Queries on feeds, pages, captions and search results as they come in, on messages and labels, and on free-form answers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestrand.functions import answers, replies
from lodestrand.functions import numbers as N
from lodestrand.functions import reading as R
from lodestrand.functions import text as T
from lodestrand.operators import stories
from lodestrand.plans.adapters import NOW_MS, items, table
from lodestrand.plans.queries import SQL_BUCKET, SQL_ITEMS, _sql_paragraphs
from lodestrand.plans.reading import sql_decoded
from lodestrand.plans.registry import query
from lodestrand.plans.replies import SQL_LINES, document_lines
from lodestrand.sources import feeds
from lodestrand.storage import shared_dir
from lodestrand.streaming import intake

#: What XML can't hold, or would not keep as it is (control characters, among them the second set, and the space that does not break), becomes a space.
SQL_STRIPPED = "trim(regexp_replace(" + sql_decoded("regexp_replace(regexp_replace({}, '[^\\x20-\\x7E\\x{{A1}}-\\x{{FFFD}}\\x{{10000}}-\\x{{10FFFF}}]+', ' ', 'g'), '<[^>]*>', ' ', 'g')") + ", '\\s+', ' ', 'g'))"


def _escaped(name: str):
    bare = F.regexp_replace(F.col(name), r"[^\x20-\x7E\x{A1}-\x{FFFD}\x{10000}-\x{10FFFF}]+", " ")
    return F.replace(F.replace(F.replace(bare, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _feeds(spark, sf):
    """One feed a document: RSS for even ids, Atom for odd ones, the address of some only in its enclosure or id, the date under either name."""
    n, k = F.col("id"), F.col("id").cast("string")
    rows = items(spark, sf).withColumns({"t": _escaped("title"), "s": _escaped("summary")})
    day = F.date_format(F.timestamp_millis(F.col("published_at")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    link = F.when(n % 3 == 0, F.concat(F.lit('<enclosure url="https://e/'), k, F.lit('"/>'))).otherwise(F.concat(F.lit("<link> https://e/"), k, F.lit(" </link>")))
    date = F.when(n % 8 == 0, F.concat(F.lit("<dc:date>"), day, F.lit("</dc:date>"))).when(n % 8 == 2, "<pubDate>never</pubDate>").otherwise(F.concat(F.lit("<pubDate>"), day, F.lit("</pubDate>")))
    rss = F.concat(
        F.lit('<rss xmlns:content="c" xmlns:dc="d" xmlns:media="m" xmlns:itunes="i"><channel><item><title>'), "t", F.lit("</title>"), link, F.lit("<description>"), F.when(n % 4 == 0, F.lit("short")).otherwise(F.col("s")),
        F.lit("</description><content:encoded>"), "s", F.lit("</content:encoded>"), date, F.lit('<itunes:duration>12:30</itunes:duration><media:content url="https://m/"/>'), F.when(n % 4 == 0, F.lit('<media:thumbnail url="https://t/"/>')).otherwise(""), F.lit("</item></channel></rss>"),
    )
    href = F.when(n % 3 == 0, F.concat(F.lit("<id>https://e/"), k, F.lit("</id>"))).otherwise(F.concat(F.lit('<link rel="self" href="https://x"/><link rel="alternate" href="https://e/'), k, F.lit('"/>')))
    atom = F.concat(F.lit('<feed xmlns:media="m"><entry><title>'), "t", F.lit("</title>"), href, F.lit("<summary>short</summary><content>"), "s", F.lit("</content><updated>"), day, F.lit("</updated></entry></feed>"))
    return rows.select(F.col("source_id"), F.when(n % 2 == 0, rss).otherwise(atom).alias("xml"))


@query(
    f"""WITH {SQL_ITEMS}, s AS (SELECT *, {SQL_STRIPPED.format('title')} AS t, {SQL_STRIPPED.format('summary')} AS body, id % 2 = 0 AS rss FROM items) SELECT 'https://e/' || id AS url, md5(t) AS title, CASE WHEN rss AND id % 4 <> 0 THEN length(body) ELSE 5 END AS summary,
    CASE WHEN rss AND id % 4 <> 0 THEN false ELSE length(body) > 85 END AS full, CASE WHEN id % 8 = 2 THEN 0 ELSE published_at // 1000 * 1000 END AS published_at, CASE WHEN rss AND id % 4 = 0 THEN 'https://t/' WHEN rss THEN 'https://m/' END AS thumbnail, CASE WHEN rss THEN 13 ELSE 1 END AS minutes, source_id AS outlet FROM s WHERE t <> ''"""
)
def feed_rows(spark, sf):
    """Every document as an entry of its source's feed, read back as an item that inherits from the source."""
    docs = table(spark, sf, "documents")
    sources = docs.select(F.col("source").alias("source_id")).distinct().select("source_id", F.col("source_id").alias("source_title"), F.lit("news").alias("kind"), F.lit("world").alias("topic"), F.lit(0.1).alias("lean"), F.lit(0.4).alias("confidence"), F.lit(None).cast("string").alias("zone"))
    told = feeds.feed_items(_feeds(spark, sf), sources)
    return told.select("url", F.md5("title").alias("title"), F.length("summary").cast("long").alias("summary"), F.col("content").isNotNull().alias("full"), "published_at", "thumbnail", "minutes", F.col("source_title").alias("outlet"))


@query("SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || '/feed/' || page_id AS feed FROM pages WHERE page_id % 3 <> 0 UNION ALL SELECT page_id, 'https://other.example/atom.xml' FROM pages")
def declared_feeds(spark, sf):
    """The feeds that pages name in their heads."""
    own = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit('<LINK rel="alternate" type="application/rss+xml" href="/feed/'), F.col("page_id").cast("string"), F.lit('">'))).otherwise('<link rel="stylesheet" href="/a.css">')
    pages = table(spark, sf, "pages").withColumn("html", F.concat(own, "html", F.lit("<link href='https://other.example/atom.xml' type='application/atom+xml' rel=alternate>")))
    return feeds.declared_feeds(pages).select("page_id", "feed")


@query(
    """WITH h AS (SELECT doc_id, lpad((doc_id // 2)::VARCHAR, 11, 'v') AS v, trim(split_part(text, chr(10), 1)) AS title, (doc_id * 37) % 20000 AS s FROM documents WHERE doc_id % 7 <> 0), k AS (SELECT * FROM h WHERE (doc_id % 5 = 0 OR s BETWEEN 180 AND 14400) AND doc_id % 11 <> 0)
    SELECT v AS video_id, md5(title) AS title, CASE WHEN doc_id % 5 <> 0 THEN s END AS seconds FROM k QUALIFY row_number() OVER (PARTITION BY v ORDER BY doc_id) = 1"""
)
def video_hits(spark, sf):
    """A search's lines as hits: some can't be read, some are private, too short or too long, and two lines share a video."""
    n = F.col("doc_id")
    told = F.struct(F.lpad(F.expr("doc_id div 2").cast("string"), 11, "v").alias("id"), F.when(n % 11 == 0, "[Private video]").otherwise(F.split("text", "\n")[0]).alias("title"), F.when(n % 5 != 0, n * 37 % 20000).alias("duration"), F.col("source").alias("uploader"))
    lines = table(spark, sf, "documents").select(n.alias("position"), F.when(n % 7 == 0, "{broken").otherwise(F.to_json(told)).alias("line"))
    return feeds.search_hits(lines).select("video_id", F.md5("title").alias("title"), F.col("seconds").cast("long").alias("seconds"))


@query(
    """WITH l AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '<[^>]+>', '', 'g'))), lambda x: x <> '' AND NOT regexp_matches(x, '^(WEBVTT|NOTE|Kind:|Language:)') AND NOT contains(x, '-->') AND NOT regexp_full_match(x, '[0-9]+')) AS x FROM conversations)
    SELECT conv_id, turn, md5(array_to_string(list_filter(x, lambda v, i: i = 1 OR v <> x[i - 1]), ' ')) AS text FROM l"""
)
def caption_texts(spark, sf):
    """Turns of conversations as captions, each line twice, as text."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat((i + 1).cast("string"), F.lit("\n00:00.000 --> 00:01.000\n<c>"), x, F.lit("</c>\n"), x, F.lit("\n")))
    vtt = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("WEBVTT\nKind: captions\n\n"), F.array_join(lines, "\n")).alias("vtt"))
    return feeds.captions(vtt).select("conv_id", "turn", F.md5("text").alias("text"))


@query(f"WITH p AS (SELECT page_id, array_to_string({_sql_paragraphs()}, chr(10) || chr(10)) AS t FROM pages) SELECT page_id, md5(substr(t, 1, 12000)) AS text FROM p WHERE length(t) >= 600")
def readable_pages(spark, sf):
    return feeds.readable_pages(table(spark, sf, "pages")).select("page_id", F.md5("text").alias("text"))


@query("SELECT page_id, page_id % 4 = 0 OR contains(lower(substr(html, 1, 4000)), 'g-recaptcha') AS challenge FROM pages")
def challenge_pages(spark, sf):
    html = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("<title>Just a Moment...</title>"), "html")).otherwise(F.concat("html", F.lit(" " * 4000 + "just a moment")))
    return table(spark, sf, "pages").select("page_id", T.challenge_page(html).alias("challenge"))


@query(
    f"""WITH {SQL_ITEMS} SELECT 'ytsearch:' || lpad(id::VARCHAR, 11, 'v') AS id, 'youtube:' || CASE WHEN id % 4 = 0 THEN 'youtube' ELSE 'the-channel-' || (id % 9) END AS source_id, greatest(CASE WHEN id % 2 = 0 THEN {NOW_MS} - 3600000 * id ELSE 0 END, published_at) AS published_at,
    CASE WHEN id % 3 <> 0 THEN greatest(1, floor((id * 37) % 900 / 60 + 0.5)) ELSE greatest(3, id % 12) END::BIGINT AS minutes FROM items WHERE id % 3 = 0 OR (id * 37) % 900 > 0 OR true"""
)
def pending_videos(spark, sf):
    """Search hits as items that are yet to be analysed."""
    n, rows = F.col("id"), items(spark, sf)
    hits = rows.select(
        n.alias("source"), F.lpad(n.cast("string"), 11, "v").alias("video_id"), "title", F.when(n % 4 == 0, "!!").otherwise(F.concat(F.lit("The Chánnel "), (n % 9).cast("string"))).alias("channel"),
        F.when(n % 3 != 0, F.greatest(F.lit(1), n * 37 % 900)).alias("seconds"), F.when(n % 2 == 0, F.lit(NOW_MS) - 3_600_000 * n).alias("uploaded_at"),
    )
    told = feeds.pending_videos(hits, rows.select(n.alias("source"), "topic", (n % 12).alias("minutes"), "published_at"))
    return told.select("id", "source_id", "published_at", "minutes")


@query("SELECT user_id, event_id FROM events WHERE event_type <> 'error'")
def stream_intake(spark, sf):
    """Events as a stream, a third of them sent twice: what the intake keeps, without errors."""
    folder = f"{shared_dir(spark).rstrip('/')}/intake-{uuid.uuid4().hex}"
    return intake.collected(table(spark, sf, "events").unionByName(table(spark, sf, "events").where("event_id % 3 = 0")), folder).where("event_type <> 'error'").select("user_id", "event_id")


@query(f"WITH {SQL_ITEMS} SELECT id, {SQL_BUCKET} AS bucket, CASE {SQL_BUCKET} WHEN 'left' THEN 'Left' WHEN 'lean-left' THEN 'Lean left' WHEN 'center' THEN 'Center' WHEN 'lean-right' THEN 'Lean right' WHEN 'right' THEN 'Right' ELSE 'Non-political' END AS shown, CASE WHEN lean IS NULL THEN 'non-political' WHEN lean <= -0.6 THEN 'left' WHEN lean < -0.15 THEN 'center-left' WHEN lean <= 0.15 THEN 'center' WHEN lean < 0.6 THEN 'center-right' ELSE 'right' END AS told FROM items")
def lean_labels(spark, sf):
    bucket = N.lean_bucket(F.col("lean"))
    return items(spark, sf).select("id", bucket.alias("bucket"), N.lean_bucket_label(bucket).alias("shown"), N.lean_label(F.col("lean")).alias("told"))


@query("SELECT n_nationkey AS id, chr((127462 + n_nationkey % 26)::INT) || chr((127462 + n_nationkey * 7 % 26)::INT) AS flag, CASE WHEN n_nationkey % 5 = 0 THEN 'International' WHEN n_nationkey % 3 = 0 THEN n_name ELSE upper(chr((97 + n_nationkey % 26)::INT) || chr((97 + n_nationkey * 7 % 26)::INT)) END AS label FROM nation")
def country_flags(spark, sf):
    k = F.col("n_nationkey")
    code = F.concat(F.char(k % 26 + 97), F.char(k * 7 % 26 + 97))
    return table(spark, sf, "nation").select(k.alias("id"), T.flag(F.upper(code)).alias("flag"), T.country_label(F.when(k % 5 != 0, code), F.when(k % 3 == 0, F.col("n_name"))).alias("label"))


@query("SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN p_name || ': ' || p_size || ' Stück' WHEN 1 THEN p_name || ': ' || p_size || ' pieces' ELSE 'part.count' END AS text FROM part")
def translations(spark, sf):
    k = F.col("p_partkey")
    own, english = F.when(k % 3 == 0, "{name}: {n} Stück"), F.when(k % 3 != 2, "{name}: {n} pieces")
    return table(spark, sf, "part").select(k.alias("id"), T.translated(F.lit("part.count"), own, english, {"name": F.col("p_name"), "n": F.col("p_size")}).alias("text"))


@query("SELECT doc_id AS id, coalesce(nullif(substr(trim(regexp_replace(lower(strip_accents(regexp_replace(split_part(text, chr(10), 1), '[^\\x00-\\x{24F}\\x{300}-\\x{36F}\\x{1E00}-\\x{1EFF}\\x{212A}\\x{212B}]', ' ', 'g'))), '[^a-z0-9]+', '-', 'g'), '-'), 1, 40), ''), 'src') AS slug FROM documents")
def headline_slugs(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), T.slug(F.split("text", "\n")[0], 40, "src").alias("slug"))


@query(f"WITH {SQL_ITEMS} SELECT id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(title, ' '), lambda x: lower(trim(x))), lambda x: length(x) >= 3 AND regexp_matches(x, '\\p{{L}}') AND NOT regexp_matches(x, '^https?:')))), ' ') AS aliases FROM items")
def alias_lists(spark, sf):
    return items(spark, sf).select("id", F.array_join(F.array_sort(T.clean_aliases(F.split("title", " "))), " ").alias("aliases"))


SQL_MEMBERS = f"{SQL_ITEMS}, m AS (SELECT id, id // 12 AS story, id // 3 AS event, title, source_id, importance, published_at, lean FROM items)"


@query(
    f"""WITH {SQL_MEMBERS}, e AS (SELECT story, event, min(published_at) AS made, list(title ORDER BY importance DESC, id)[1:3] AS headlines, list(source_id ORDER BY importance DESC, id) AS s FROM m GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY story ORDER BY made, event) - 1 AS place FROM e)
    SELECT story, event, place, strftime(make_timestamp(made * 1000), '%Y-%m-%d') AS date, md5(array_to_string(headlines, '|')) AS headlines, array_to_string(list_filter(s, lambda x, i: list_position(s, x) = i), ',') AS outlets FROM k"""
)
def event_payloads(spark, sf):
    """What a model is told of each event of a story."""
    rows = items(spark, sf).withColumns({"story": F.expr("id div 12"), "event": F.expr("id div 3"), "source_title": F.col("source_id")})
    told = stories.event_payloads(rows)
    return told.select("story", "event", F.col("place").cast("long").alias("place"), "date", F.md5(F.array_join("headlines", "|")).alias("headlines"), F.array_join("outlets", ",").alias("outlets"))


@query(
    f"""WITH {SQL_MEMBERS} SELECT story, min(published_at) AS started_at, round(least(1, greatest(0, least(1, 0.6 * max(importance) + 0.4 * least(1, count(DISTINCT source_id) / 8))) + 0.15), 6) AS severity, count(DISTINCT event) AS events FROM m GROUP BY story"""
)
def developing_fallbacks(spark, sf):
    """Each story as a developing one, told without a model."""
    rows = items(spark, sf).withColumns({"story": F.expr("id div 12"), "event": F.expr("id div 3"), "source_title": F.col("source_id")})
    told = stories.developing_stories(rows, "story")
    return told.select("story", "started_at", F.round("severity", 6).alias("severity"), F.size("timeline").cast("long").alias("events"))


def _turns(spark, sf):
    return table(spark, sf, "conversations").where("role = 'assistant'")


@query()
def answer_places(spark, sf):
    """Assistants' turns read as answers: a synopsis, and places where lines name them."""
    said = F.regexp_replace(F.regexp_replace("text", r"(?m)^(\S+) (\S+) ", "- **$1 $2** (FR): "), "^- ", "")
    told = _turns(spark, sf).select("conv_id", "turn", answers.ask(said).alias("a"))
    return told.select("conv_id", "turn", F.md5("a.synopsis").alias("synopsis"), F.to_json("a.places").alias("places"))


@query(
    """WITH t AS (SELECT conv_id, turn, list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || '- ') || chr(10) || 'Outlook: more of it', chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l FROM conversations WHERE role = 'assistant'),
    p AS (SELECT conv_id, turn, list_filter(l, lambda x: NOT regexp_matches(x, '(?i)^outlook\\s*:') AND NOT regexp_matches(x, '^[-*•]\\s')) AS plain, list_transform(list_filter(l, lambda x: NOT regexp_matches(x, '(?i)^outlook\\s*:') AND regexp_matches(x, '^[-*•]\\s')), lambda x: regexp_replace(x, '^[-*•]\\s+', '')) AS b,
    list_filter(l, lambda x: regexp_matches(x, '(?i)^outlook\\s*:'))[-1] AS o FROM t)
    SELECT conv_id, turn, md5(coalesce(plain[1], '')) AS mood, to_json(list_transform(b, lambda x: CASE WHEN instr(x, ':') BETWEEN 2 AND 61 THEN {'title': trim(x[:instr(x, ':') - 1]), 'detail': trim(x[instr(x, ':') + 1:])} ELSE {'title': '', 'detail': x} END)[:5])::VARCHAR AS threads, trim(regexp_replace(o, '(?i)^outlook\\s*:', '')) AS outlook FROM p"""
)
def briefing_parts(spark, sf):
    """Assistants' turns read as briefings: mood, threads, outlook."""
    said = F.concat(F.regexp_replace("text", "\n", "\n- "), F.lit("\nOutlook: more of it"))
    return _turns(spark, sf).select("conv_id", "turn", answers.briefing(said).alias("b")).select("conv_id", "turn", F.md5("b.mood").alias("mood"), F.to_json("b.threads").alias("threads"), "b.outlook")


@query()
def plain_articles(spark, sf):
    """Assistants' turns read as articles of plain text."""
    told = _turns(spark, sf).select("conv_id", "turn", answers.article(F.regexp_replace("text", "\n", "\n\n")).alias("a"))
    return told.select("conv_id", "turn", F.md5("a.title").alias("title"), F.size("a.paragraphs").alias("paragraphs"))


PUNCTUATION = "|".join(f"\\{c}{{4,}}" for c in "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~")
SQL_BARE = "trim(coalesce({0}, ''))"
SQL_CLEANED = f"CASE WHEN {SQL_BARE} = '' OR regexp_matches({SQL_BARE}, '{PUNCTUATION.replace('{', '{{').replace('}', '}}')}') OR regexp_matches({SQL_BARE}, '[^\\p{{{{L}}}}\\p{{{{N}}}}\\s]{{{{6,}}}}') OR length(regexp_replace({SQL_BARE}, '[^\\p{{{{L}}}}]', '', 'g')) < 0.4 * length(regexp_replace({SQL_BARE}, '\\s', '', 'g')) THEN '' ELSE trim(regexp_replace({SQL_BARE}, '\\s+', ' ', 'g')) END"


@query(
    f"""WITH t AS (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM conversations WHERE role = 'assistant'), c AS (SELECT conv_id, turn, {SQL_CLEANED.format('l[1]')} AS a, {SQL_CLEANED.format('l[2]')} AS b, {SQL_CLEANED.format('l[3]')} AS c, trim(coalesce(l[2], '')) AS raw FROM t)
    SELECT conv_id, turn, CASE WHEN a <> '' THEN md5(a) END AS protagonist, CASE WHEN a <> '' AND conv_id % 3 = 0 THEN 'fr' END AS iso2, md5(b) AS left_view, md5(c) AS right_view, CASE WHEN conv_id % 2 = 0 THEN 'naval-blockade' ELSE 'tech' END AS category, CASE WHEN conv_id % 2 = 0 THEN 'boat' END AS icon,
    CASE WHEN raw = '' THEN 1 ELSE 2 END::BIGINT AS threads, (a <> '' AND b <> '')::BIGINT AS angles FROM c"""
)
def reply_stories(spark, sf):
    """Assistants' turns as the parts of a story that a model gives: protagonist, category, spectrum, threads, angles."""
    line = lambda i: F.get(F.split("text", "\n"), F.lit(i))
    told = F.struct(
        F.struct(line(0).alias("name"), F.when(F.col("conv_id") % 3 == 0, " FR ").otherwise("FRA").alias("iso2")).alias("protagonist"), F.when(F.col("conv_id") % 2 == 0, " Naval Blockade!").otherwise("tech").alias("category"), F.lit("Boat").alias("categoryIcon"),
        F.struct(line(1).alias("left"), line(2).alias("right")).alias("spectrum"), F.array(F.struct(F.lit("x").alias("title"), line(1).alias("detail")), F.struct(F.lit(" ").alias("title"), line(1).alias("detail"))).alias("threads"),
        F.array(F.struct(line(0).alias("outlet"), line(1).alias("framing")), F.struct(F.lit("").alias("outlet"), line(1).alias("framing"))).alias("angles"),
    )
    rows = _turns(spark, sf).select("conv_id", "turn", F.concat(F.lit("Here:\n```json\n"), F.to_json(told), F.lit("\n```")).alias("reply"))
    rows = rows.withColumn("o", replies.reply_object(F.col("reply")))
    o = F.col("o")
    p, c, s = replies.protagonist(o), replies.category(o), replies.spectrum(o)
    parts = rows.select("conv_id", "turn", p.alias("p"), c.alias("c"), s.alias("s"), F.size(replies.threads(F.try_variant_get(o, "$.threads", "variant"))).alias("threads"), F.size(replies.angles(F.try_variant_get(o, "$.angles", "variant"))).alias("angles"))
    return parts.select("conv_id", "turn", F.md5("p.name").alias("protagonist"), "p.iso2", F.md5("s.left").alias("left_view"), F.md5("s.right").alias("right_view"), "c.category", "c.icon", F.col("threads").cast("long").alias("threads"), F.col("angles").cast("long").alias("angles"))


_OUTLETS = {"a": "'SRC' || (length(line) % 10) || ' News'", "b": "'SRC' || (len(string_split(line, ' ')) % 10) || ' News'"}
_IS_SOURCE = "contains(lower({0}), lower(source)) OR contains(lower(source), lower({0}))"
_TITLE = f"CASE WHEN {_IS_SOURCE} THEN source WHEN contains({{0}}, 'SRC1 ') THEN 'src1' ELSE {{0}} END"
_ZONE = f"CASE WHEN {_IS_SOURCE} THEN lang WHEN contains({{0}}, 'SRC1 ') THEN 'international' END"
_DISTINCT = "array_to_string(CASE WHEN {0} = {1} THEN [{0}] ELSE list_filter([{0}, {1}], lambda x: x IS NOT NULL) END, ',')"


@query(
    f"""WITH {SQL_LINES}, r AS (SELECT doc_id, i, lang, source, {SQL_CLEANED.format("split_part(line, ' ', 1)")} AS label, {SQL_CLEANED.format("line")} AS framing, {_OUTLETS["a"]} AS a, {_OUTLETS["b"]} AS b FROM l WHERE lang <> 'en'),
    t AS (SELECT doc_id, i, label, framing, {_TITLE.format("a")} AS a, {_TITLE.format("b")} AS b, {_ZONE.format("a")} AS za, {_ZONE.format("b")} AS zb FROM r WHERE label <> '' AND framing <> '' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= 5)
    SELECT doc_id AS id, md5(string_agg(label || ':' || framing, '|' ORDER BY i)) AS told, string_agg({_DISTINCT.format("a", "b")}, '|' ORDER BY i) AS outlets, string_agg({_DISTINCT.format("za", "zb")}, '|' ORDER BY i) AS zones FROM t GROUP BY doc_id HAVING count(*) >= 2"""
)
def reply_sides(spark, sf):
    """Every line as a side of a dispute with two outlets, held against a story of the document's source (with a zone unless it is English) and one more."""
    outlet = lambda n: F.concat(F.lit("SRC"), (n % 10).cast("string"), F.lit(" News"))
    side = lambda x: F.struct(F.get(F.split(x, " "), F.lit(0)).alias("label"), x.alias("framing"), F.array(outlet(F.length(x)), outlet(F.size(F.split(x, " "))), F.lit("!!!!!!")).alias("outlets"))
    nobody = F.struct(F.lit("Nobody").alias("label"), F.lit("Without outlets.").alias("framing"), F.array().cast("array<string>").alias("outlets"))
    members = F.array(F.struct(F.col("source").alias("title"), F.when(F.col("lang") != "en", F.col("lang")).alias("zone")), F.struct(F.lit("src1").alias("title"), F.lit(None).cast("string").alias("zone")))
    said = F.to_json(F.struct(F.concat(F.array(nobody), F.transform("lines", side)).alias("sides")))
    rows = document_lines(spark, sf).select(F.col("doc_id").alias("id"), members.alias("members"), said.alias("reply"))
    told = rows.select("id", replies.sides(F.try_variant_get(replies.reply_object(F.col("reply")), "$.sides", "variant"), F.col("members")).alias("s")).where("s is not null")
    joined = lambda f: F.array_join(F.transform("s", f), "|")
    return told.select("id", F.md5(joined(lambda x: F.concat(x["label"], F.lit(":"), x["framing"]))).alias("told"), joined(lambda x: F.array_join(x["outlets"], ",")).alias("outlets"), joined(lambda x: F.array_join(x["zones"], ",")).alias("zones"))
