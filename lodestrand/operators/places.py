"""Places: how much a text speaks of one, and where names lie. Country and place names are a bounded dimension; texts are not."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.functions.text import fold, unicode_tokens
from lodestrand.operators.ordering import first_per_key

#: What a hit counts at each level.
LEVEL_WEIGHT = {"locality": 3, "region": 2, "country": 1}
#: Fixed value: words of collections that are about a topic or a test.
UNFIT = r"(?i)\b(topic|issue|research|experiment|test|sample|covid|climate|election\b|twitter|reddit|facebook)\b"
MOST_NAMES = 2000


def place_key(name: Column) -> Column:
    """A name for comparing: no accents, lower case, one space between words."""
    return F.trim(F.regexp_replace(F.lower(fold(F.coalesce(name, F.lit("")))), "[^a-z0-9]+", " "))


def paths(nodes: DataFrame, most: int = 32) -> DataFrame:
    """node, nodes, labels from the root's child down to each node that a root reaches. nodes: node, parent, level, label.

    A level is one join with the level above; a node that is its own ancestor isn't followed. A tree of places is a bounded dimension, `most` levels at most.
    """
    known = nodes.select("node").distinct()
    level = nodes.join(known.withColumnRenamed("node", "parent"), "parent", "left_anti").select("node", F.array("node").alias("nodes"), F.array("label").alias("labels"))
    found = level
    for _ in range(most):
        below = nodes.select("node", "parent", "label").join(level.withColumnRenamed("node", "parent"), "parent").where(~F.array_contains("nodes", F.col("node")))
        level = below.select("node", F.array_append("nodes", F.col("node")).alias("nodes"), F.array_append("labels", F.col("label")).alias("labels"))
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found


def alias_hits(text: Column, aliases: list[str]) -> Column:
    """How many of the aliases a text has: single words as words, others anywhere."""
    told = list(dict.fromkeys(a for a in (x.lower().strip() for x in aliases) if a))
    words, padded = unicode_tokens(text), F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    found = [F.contains(padded, F.lit(a)) if " " in a else F.array_contains(words, a) for a in told]
    return reduce(lambda a, b: a + b, [f.cast("int") for f in found], F.lit(0))


def chain(nodes: DataFrame, place: dict) -> list[dict]:
    """The nodes (country, region, locality) of one place; a locality without a node gets one of its own. nodes: id, parent, level, label, country, aliases."""
    named = nodes.where(((F.col("level") == "country") & (F.col("id") == place["country"])) | ((F.col("level") == "region") & (F.col("id") == place.get("region"))))
    found = {r["level"]: r.asDict() for r in named.collect()}  # two rows at most
    told = [found[x] for x in ("country", "region") if x in found]
    if not place.get("locality"):
        return told
    want, parent = place_key(F.lit(place["locality"])), found.get("region", {}).get("id")
    same = (place_key(F.col("label")) == want) | F.exists("aliases", lambda a: place_key(a) == want) | F.endswith("id", F.concat(F.lit("-"), F.regexp_replace(want, " ", "-")))
    scope = (F.col("level") == "locality") & (F.col("country") == place["country"])
    match = nodes.where(scope & same & (F.col("parent") == parent if parent else F.lit(True))).orderBy("id").first()
    own = {"id": None, "parent": parent or place["country"], "level": "locality", "label": place["locality"], "country": place["country"], "aliases": [place["locality"].lower()]}
    return [*told, match.asDict() if match else own]


def place_score(text: Column, nodes: list[dict]) -> Column:
    """Hits on a place's chain, weighted by level."""
    return reduce(lambda a, b: a + b, [LEVEL_WEIGHT[n["level"]] * alias_hits(text, n["aliases"]) for n in nodes], F.lit(0))


def place_label(nodes: list[dict]) -> str:
    return " · ".join(n["label"] for n in nodes)


def boosted(relevance: Column, score: Column, weight: float = 0.5, enough: int = 3) -> Column:
    """Relevance lifted toward 1 by a place's score."""
    strength = F.least(F.lit(1.0), score / max(1, enough))
    return F.when(score > 0, F.least(F.lit(1.0), relevance + weight * strength * (1 - relevance))).otherwise(relevance)


def lookup_cities(wanted: DataFrame, cities: DataFrame) -> DataFrame:
    """wanted (place, iso2, others) with lat, lon: the largest city of the name in the country, else the largest of the name; null if unknown.

    cities: key (as place_key gives), cc, lat, lon, pop. Names are made unique before the joins, so a common name multiplies no rows.
    """
    best = F.max_by(F.struct("lat", "lon"), F.struct("pop", "lat", "lon"))
    at_home = cities.groupBy(F.col("key").alias("_key"), F.lower("cc").alias("_cc")).agg(best.alias("_home"))
    anywhere = cities.groupBy(F.col("key").alias("_name")).agg(best.alias("_any"))
    key = place_key(F.col("place"))
    told = wanted.join(at_home, (key == F.col("_key")) & (F.lower("iso2") == F.col("_cc")), "left").join(anywhere, key == F.col("_name"), "left")
    told = told.withColumn("_at", F.coalesce("_home", "_any"))
    return told.withColumns({"lat": F.col("_at.lat"), "lon": F.col("_at.lon")}).drop("_key", "_cc", "_home", "_name", "_any", "_at")


def geocode(gatherings: DataFrame, cities: DataFrame, boxes: DataFrame, centroids: DataFrame, pad: float = 1.5) -> DataFrame:
    """gatherings (id, place, iso2, said_lat, said_lon) with lat, lon and by: a known city, else what was said if it lies in the country's padded box, else the country's centre.

    boxes: iso2, min_lat, max_lat, min_lon, max_lon; a country without one passes. centroids: iso2, lat, lon. Both have one row a country.
    """
    told = lookup_cities(gatherings, cities)
    box, centre = boxes.select(F.col("iso2").alias("_b"), "min_lat", "max_lat", "min_lon", "max_lon"), centroids.select(F.col("iso2").alias("_c"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    told = told.join(box, F.lower("iso2") == F.col("_b"), "left").join(centre, F.lower("iso2") == F.col("_c"), "left")
    inside = F.col("said_lat").between(F.col("min_lat") - pad, F.col("max_lat") + pad) & F.col("said_lon").between(F.col("min_lon") - pad, F.col("max_lon") + pad)
    said = F.col("said_lat").isNotNull() & F.col("said_lon").isNotNull() & (F.col("_b").isNull() | inside)
    by = F.when(F.col("lat").isNotNull(), "city").when(said, "said").when(F.col("_lat").isNotNull(), "country")
    told = told.withColumn("by", by)
    pick = lambda city, own, far: F.when(F.col("by") == "city", F.col(city)).when(F.col("by") == "said", F.col(own)).otherwise(F.col(far))
    return told.select("id", "place", "iso2", "by", pick("lat", "said_lat", "_lat").alias("lat"), pick("lon", "said_lon", "_lon").alias("lon"))


def bounded_names(names: DataFrame, most: int = MOST_NAMES) -> list[tuple[str, str]]:
    """(name, key) rows of a names table (name, key), longest first; an error if there are more than `most`."""
    rows = names.select("name", "key").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} names")
    return sorted(((r["name"].lower(), r["key"]) for r in rows), key=lambda x: (-len(x[0]), x[0]))


def longest_name(text: Column, names: list[tuple[str, str]], least: int = 4) -> Column:
    """The key of the longest name (of `least` letters or more) anywhere in a text; null without one."""
    hay = F.lower(text)
    return F.coalesce(*(F.when(F.contains(hay, F.lit(n)), F.lit(k)) for n, k in names if len(n) >= least), F.lit(None).cast("string"))


def named_places(text: Column, names: list[tuple[str, str]], least: int = 4, most: int = 8) -> Column:
    """Distinct keys of the names on word boundaries in a text, longest name first."""
    import re

    hay = F.lower(text)
    found = F.array(*(F.when(hay.rlike(rf"(?:^|[^a-z]){re.escape(n)}(?:[^a-z]|$)"), F.lit(k)) for n, k in names if len(n) >= least))
    return F.slice(F.array_distinct(F.array_compact(found)), 1, most)


def locate(stories: DataFrame, zones: DataFrame, centroids: DataFrame, names: list[tuple[str, str]]) -> DataFrame:
    """story, iso2: the first zone that has a centre, else the country of the longest name in title and summary; null otherwise.

    stories: story, title, summary; zones: story, position, zone; centroids: iso2.
    """
    known = zones.join(centroids.select(F.col("iso2").alias("zone")).distinct(), "zone").groupBy("story").agg(F.min_by("zone", "position").alias("_zone"))
    told = stories.join(known, "story", "left")
    return told.select("story", F.coalesce("_zone", longest_name(F.concat_ws(" ", "title", "summary"), names)).alias("iso2"))


def resolve_answers(answers: DataFrame, names: DataFrame) -> DataFrame:
    """id, key: an answer's place by its code, else by its whole label, else by the first part of the label that is a name.

    answers: id, label, iso2 (id unique); names: name, key, where a country's code is its key.
    """
    names = names.select(F.lower("name").alias("_name"), "key").dropDuplicates(["_name"])
    label = F.lower(F.trim("label"))
    parts = F.transform(F.split(label, r"[/,;]|\band\b|\bvs\.?\b"), lambda p: F.trim(p))
    tries = answers.select("id", F.posexplode(F.concat(F.array(label), parts)).alias("_at", "_name"))
    by_name = tries.join(names, "_name").groupBy("id").agg(F.min_by("key", "_at").alias("_named"))
    codes = names.select(F.col("key").alias("_code")).distinct()
    told = answers.join(codes, F.lower("iso2") == F.col("_code"), "left").join(by_name, "id", "left")
    return told.select("id", F.coalesce("_code", "_named").alias("key"))


def search_places(places: DataFrame, query: str, k: int = 8) -> DataFrame:
    """label, level, score of the places a query means: whole label 4, its beginning 3, a word's beginning 2, inside 1; countries and short labels first."""
    import re

    q, label = query.strip().lower(), F.lower("label")
    word = label.rlike(r"(?:^|\s)" + re.escape(q))
    score = F.when(label == q, 4).when(F.startswith(label, F.lit(q)), 3).when(word, 2).when(F.contains(label, F.lit(q)), 1).otherwise(0)
    told = places.withColumn("score", score.cast("long")).where((F.col("score") > 0) & F.lit(bool(q)))
    return told.orderBy(F.col("score").desc(), F.col("level") != "country", F.length("label"), "label").limit(k).select("label", "level", "score")


def cover_provinces(provinces: DataFrame, coverage: DataFrame) -> DataFrame:
    """province, outlets: what covers its own code, else its community's code, else its community's name; 0 without.

    provinces: province, code, community_code, community; coverage: code, name, outlets (one row a code).
    """
    by = lambda c: coverage.groupBy(F.lower(c).alias(f"_{c}")).agg(F.max("outlets").alias(f"_by_{c}"))
    own, name = by("code"), by("name")
    wide = own.select(F.col("_code").alias("_wide"), F.col("_by_code").alias("_by_wide"))
    told = provinces.join(own, F.lower("code") == F.col("_code"), "left").join(wide, F.lower("community_code") == F.col("_wide"), "left").join(name, F.lower("community") == F.col("_name"), "left")
    return told.select("province", F.coalesce("_by_code", "_by_wide", "_by_name", F.lit(0)).alias("outlets"))


def pick_collections(collections: DataFrame, place: str) -> DataFrame:
    """Collections that name a place and don't look like a topic or a test. collections: id, name, description."""
    return collections.where(F.contains(F.lower("name"), F.lit(place.lower())) & ~F.concat_ws(" ", "name", "description").rlike(UNFIT))


def by_host(candidates: DataFrame) -> DataFrame:
    """The first candidate (by position) of each host; those without a host all stay. candidates: position, host."""
    hosted = first_per_key(candidates.where("host is not null"), ["host"], [F.col("position")])
    return hosted.unionByName(candidates.where("host is null"))
