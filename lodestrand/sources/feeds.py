"""Sources: feeds, captions, search results, pages and place tables, as DataFrames with a stated schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions.numbers import half_up
from lodestrand.functions.reading import minutes
from lodestrand.functions.replies import strip_html
from lodestrand.functions.text import country_code, html_paragraphs, html_title, item_hash, slug, url_host, vtt_text
from lodestrand.operators.ordering import first_per_key

_URL = "struct<_url:string,_duration:string>"
RSS = f"struct<channel:struct<item:array<struct<title:string,link:string,description:string,`content:encoded`:string,pubDate:string,`dc:date`:string,`itunes:duration`:string,enclosure:{_URL},`media:content`:{_URL},`media:thumbnail`:{_URL}>>>>"
ATOM = f"struct<entry:array<struct<title:string,id:string,link:array<struct<_href:string,_rel:string>>,summary:string,content:string,published:string,updated:string,`media:group`:struct<`media:description`:string,`media:thumbnail`:{_URL}>>>>"
DATES = ("EEE, d MMM yyyy HH:mm:ss Z", "EEE, d MMM yyyy HH:mm:ss z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd")
MOST_CONTENT = 40_000
LINK = r"(?i)<link\b[^>]*>"


def epoch_ms(text):
    """Milliseconds of a feed's date; 0 for what can't be read."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3}, ", "")
    tried = [F.unix_millis(F.try_to_timestamp(bare, F.lit(d.removeprefix("EEE, ")))) for d in DATES]
    return F.coalesce(*tried, F.lit(0).cast("long"))


def _first(*columns):
    """The first of the texts that isn't empty; empty without any."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns), F.lit(""))


def full_content(html, summary):
    """A feed's whole article, where it is longer (without tags) than the summary by over 80 letters; its first 40,000 letters."""
    told = F.trim(html)
    return F.when(F.length(strip_html(told)) > F.length(summary) + 80, F.substring(told, 1, MOST_CONTENT))


def feed_entries(xml: DataFrame) -> DataFrame:
    """source_id, title, url, summary, content, published_at, duration, thumbnail of RSS 2.0 items and Atom entries. xml: source_id, xml."""
    at = lambda name: F.col("e").getField(name)
    rss = xml.select("source_id", F.explode(F.from_xml("xml", RSS, {"mode": "PERMISSIVE"})["channel"]["item"]).alias("e"))
    body, media = at("content:encoded"), at("media:content")
    rss = rss.select(
        "source_id", strip_html(_first(at("title"))).alias("title"), _first(at("link"), at("enclosure")["_url"]).alias("url"), strip_html(_first(at("description"), body)).alias("summary"),
        _first(body, at("description")).alias("html"), epoch_ms(_first(at("pubDate"), at("dc:date"))).alias("published_at"), F.nullif(_first(at("itunes:duration"), media["_duration"]), F.lit("")).alias("duration"),
        F.nullif(_first(at("media:thumbnail")["_url"], media["_url"]), F.lit("")).alias("thumbnail"),
    )
    atom = xml.select("source_id", F.explode(F.from_xml("xml", ATOM, {"mode": "PERMISSIVE"})["entry"]).alias("e"))
    alternate = F.get(F.filter(at("link"), lambda x: x["_rel"] == "alternate"), F.lit(0))
    group = at("media:group")
    atom = atom.select(
        "source_id", strip_html(_first(at("title"))).alias("title"), _first(F.coalesce(alternate, F.get(at("link"), F.lit(0)))["_href"], at("id")).alias("url"),
        strip_html(_first(group["media:description"], at("summary"), at("content"))).alias("summary"), _first(at("content"), at("summary")).alias("html"),
        epoch_ms(_first(at("published"), at("updated"))).alias("published_at"), F.lit(None).cast("string").alias("duration"), F.nullif(_first(group["media:thumbnail"]["_url"]), F.lit("")).alias("thumbnail"),
    )
    told = rss.unionByName(atom)
    return told.select("source_id", "title", "url", "summary", full_content(F.col("html"), F.col("summary")).alias("content"), "published_at", "duration", "thumbnail")


def feed_items(xml: DataFrame, sources: DataFrame) -> DataFrame:
    """The entries of each source's feed as items that inherit from it; entries without title or address go.

    sources: source_id, source_title, kind, topic, lean, confidence, zone: a bounded dimension of one row a source.
    """
    rows = feed_entries(xml).where("title <> '' and url <> ''").join(sources, "source_id")
    made = F.concat("source_id", F.lit(":"), item_hash(F.col("url")))
    return rows.withColumns({"id": made, "lean_source": F.lit("source"), "minutes": minutes(F.col("kind"), F.col("duration"), F.col("summary"))}).drop("duration")


def by_country(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of a folder of registries, one JSON file a country, with cc; files that can't be read give no rows."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(f"{folder}/*.json")
    return rows.withColumn("cc", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)).where(F.col("cc").rlike("^[a-z]{2}$"))


def gazetteer(generated: DataFrame, seeded: DataFrame) -> DataFrame:
    """Place nodes (cc, ...) of each country: the generated ones, else those that are built in."""
    return generated.unionByName(seeded.join(generated.select("cc").distinct(), "cc", "left_anti").select(*generated.columns))


def regions(features: DataFrame, code: str = "iso2") -> DataFrame:
    """iso2, rings: the shapes of each country's regions. features: iso2 of its properties (either of two), rings."""
    return features.withColumn(code, country_code(F.col("iso_a2_eh"), F.col("iso_a2"))).where(F.col(code).isNotNull()).drop("iso_a2_eh", "iso_a2")


def declared_feeds(pages: DataFrame) -> DataFrame:
    """page_id, position, feed: the feeds that a page names in its links, as whole addresses. pages: page_id, url, html."""
    tags = F.filter(F.regexp_extract_all("html", F.lit(LINK), 0), lambda t: t.rlike("(?i)rel\\s*=\\s*[\"']?alternate") & t.rlike("(?i)type\\s*=\\s*[\"']application/(rss|atom)\\+xml"))
    hrefs = F.filter(F.transform(tags, lambda t: F.regexp_extract(t, "(?i)href\\s*=\\s*[\"']([^\"']+)[\"']", 1)), lambda h: h != "")
    rows = pages.select("page_id", "url", F.posexplode(hrefs).alias("position", "href"))
    origin, folder = F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    whole = F.when(F.col("href").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.col("href")).when(F.startswith("href", F.lit("//")), F.concat(F.regexp_extract("url", "^([A-Za-z][A-Za-z0-9+.-]*:)", 1), "href"))
    whole = whole.when(F.startswith("href", F.lit("/")), F.concat(origin, "href")).otherwise(F.concat(F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/"))), "href"))
    return rows.select("page_id", "position", whole.alias("feed"))


def outlets(found: DataFrame) -> DataFrame:
    """title, homepage, region of a knowledge base's rows (position, title, homepage, region): the first row of each title, its region from the first row that has one."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("position")))
    return found.groupBy("title").agg(F.min_by("homepage", "position").alias("homepage"), first("region").alias("region"))


def pending_videos(hits: DataFrame, sources: DataFrame) -> DataFrame:
    """Search hits as items to analyse: never older than the story that they were searched for, three minutes or what it takes where the length is unknown.

    hits: source (the item searched for), video_id, title, channel, seconds, uploaded_at; sources: source, topic, minutes, published_at.
    """
    rows = hits.join(sources.select("source", "topic", F.col("minutes").alias("_minutes"), F.col("published_at").alias("_at")), "source")
    length = F.when(F.col("seconds") > 0, F.greatest(F.lit(1), half_up(F.col("seconds") / 60))).otherwise(F.greatest(F.lit(3), F.col("_minutes")))
    return rows.select(
        F.concat(F.lit("ytsearch:"), "video_id").alias("id"), F.concat(F.lit("youtube:"), slug(F.col("channel"), empty="youtube")).alias("source_id"), F.col("channel").alias("source_title"), "title",
        F.greatest(F.coalesce("uploaded_at", F.lit(0)), "_at").alias("published_at"), F.lit("video").alias("kind"), "topic", F.lit(None).cast("double").alias("lean"), length.cast("long").alias("minutes"),
    )


def search_hits(lines: DataFrame) -> DataFrame:
    """video_id, title, channel, seconds, position of a search's JSON lines (position, line), the first fit line of each video; malformed, private and wrongly named rows go."""
    row = F.from_json("line", "id string, title string, channel string, uploader string, duration double", {"mode": "PERMISSIVE"})
    told = lines.select("position", row.alias("r")).select("position", F.col("r.id").alias("video_id"), F.trim("r.title").alias("title"), F.coalesce("r.channel", "r.uploader").alias("channel"), F.floor(F.col("r.duration") + 0.5).alias("seconds"))
    told = told.where(F.col("video_id").rlike(r"^[\w-]{11}$") & F.col("title").isNotNull() & ~F.col("title").isin("[Private video]", "[Deleted video]"))
    return first_per_key(told.where("seconds is null or (seconds >= 180 and seconds <= 14400)"), ["video_id"], [F.col("position")])


def captions(vtt: DataFrame) -> DataFrame:
    return vtt.withColumn("text", vtt_text(F.col("vtt")))


def readable_pages(pages: DataFrame, least: int = 600, most: int = 12_000) -> DataFrame:
    """page_id, host, title, text of pages with at least `least` characters of paragraphs."""
    text = F.array_join(html_paragraphs(F.col("html")), "\n\n")
    told = pages.select("page_id", url_host(F.col("url")).alias("host"), html_title(F.col("html")).alias("title"), text.alias("text"))
    return told.where(F.length("text") >= least).withColumn("text", F.substring("text", 1, most))


def populated_places(spark: SparkSession, path: str, least: int = 0) -> DataFrame:
    """name, cc, lat, lon, pop of a tab-separated gazetteer: populated places with a country and finite coordinates, largest first."""
    names = ["geonameid", "name", "asciiname", "alternatenames", "latitude", "longitude", "feature_class", "feature_code", "country_code", "cc2", "admin1", "admin2", "admin3", "admin4", "population"]
    rows = spark.read.csv(path, sep="\t", schema=", ".join(f"{n} string" for n in names), quote="")
    told = rows.where("feature_class = 'P'").select(F.coalesce(F.nullif(F.trim("asciiname"), F.lit("")), "name").alias("name"), F.upper("country_code").alias("cc"), *(F.round(F.col(c).try_cast("double"), 4).alias(n) for c, n in (("latitude", "lat"), ("longitude", "lon"))), F.coalesce(F.col("population").try_cast("long"), F.lit(0)).alias("pop"))
    return told.where(F.col("cc").rlike("^[A-Z]{2}$") & F.col("lat").isNotNull() & F.col("lon").isNotNull() & (F.col("pop") >= least)).orderBy(F.col("pop").desc(), "name")
