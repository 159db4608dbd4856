"""Replies of a language model as typed columns: what can't be read or isn't allowed is left out. They stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrand.functions.text import bound, degenerate

#: Topics and kinds that have a meaning of their own.
TOPICS = ["world", "politics", "economics", "science", "technology", "history", "health", "culture"]
EVENT_CATEGORIES = ["conflict", "diplomacy", "unrest", "health", "tech", "disaster", "economy", "other"]
FENCE = r"(?is)```(?:json)?\s*(.*?)```"
#: What is left of a JSON document when its words are gone.
SCAFFOLDING = (r"""^["'\s,:{}\[\]]*$""", r"""(?i)^["']?(title|paragraphs|content)["']?\s*:?\s*[{\[]?$""", r"(?i)^json\b[\s,{\[]*$")


def _body(reply: Column) -> Column:
    """What is inside the first fence, or all."""
    return bound(F.coalesce(reply, F.lit("")), lambda r: F.trim(F.when(r.rlike(FENCE), F.regexp_extract(r, FENCE, 1)).otherwise(r)))


def _between(text: Column, first: str, last: str) -> Column:
    """From the first `first` to the last `last`; null without them."""
    start = F.instr(text, first)
    length = F.length(text) - F.instr(F.reverse(text), last) + 2 - start
    return F.when((start > 0) & F.contains(text, F.lit(last)) & (length > 1), F.substring(text, start, length))


def reply_array(reply: Column) -> Column:
    """The array (variant) of a reply: whole, else cut after its last whole object, else whatever the reply is. Null if nothing can be read."""
    whole, cut = (lambda body: _between(body, "[", "]")), (lambda body: F.concat(_between(body, "[", "}"), F.lit("]")))
    return bound(_body(reply), lambda body: F.coalesce(F.try_parse_json(whole(body)), F.try_parse_json(cut(body)), F.try_parse_json(body)))


def reply_object(reply: Column) -> Column:
    """The object (variant) of a reply; null if there is none."""
    found = bound(_body(reply), lambda body: F.try_parse_json(_between(body, "{", "}")))
    return bound(found, lambda v: F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), v))


def elements(array: Column, path: str = "$") -> Column:
    """The elements (variants) of an array at a path; none if it isn't an array."""
    return F.coalesce(F.try_variant_get(array, path, "array<variant>"), F.array().cast("array<variant>"))


def text_of(value: Column, path: str = "$") -> Column:
    """A text at a path; null for numbers, arrays and objects."""
    found = F.try_variant_get(value, path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(value, path, "string"))


def texts(array: Column) -> Column:
    """The texts among an array's elements, trimmed and in lower case."""
    kept = F.filter(array, lambda x: F.schema_of_variant(x) == "STRING")
    return F.transform(kept, lambda x: F.lower(F.trim(F.try_variant_get(x, "$", "string"))))


def number_of(value: Column, path: str, low: float, high: float, otherwise: Column) -> Column:
    """A number at a path, brought between low and high."""
    found = F.try_variant_get(value, path, "double")
    return F.when(found.isNull() | F.isnan(found), otherwise).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), found)))


def clean(text: Column) -> Column:
    """Prose of a reply on one line; empty if it is degenerate or no text."""
    told = lambda bare: F.regexp_replace(F.regexp_replace(bare, r"(?i)```+\s*json\b", ""), r"```+", "")
    return bound(F.trim(F.coalesce(text, F.lit(""))), lambda bare: F.when((bare == "") | degenerate(bare), "").otherwise(F.trim(F.regexp_replace(told(bare), r"\s+", " "))))


def kind(text: Column) -> Column:
    """A short name of lower-case words and hyphens."""
    hyphened = F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), "[^a-z0-9]+", "-")
    return F.substring(F.trim(hyphened, F.lit("-")), 1, 24)


def icon(text: Column) -> Column:
    return F.substring(F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), "[^a-z0-9-]", ""), 1, 32)


def countries(array: Column, most: int) -> Column:
    """The first distinct two-letter codes."""
    return F.slice(F.array_distinct(F.filter(texts(array), lambda c: c.rlike("^[a-z]{2}$"))), 1, most)


def analysis(reply: Column, topic: Column, lean: Column) -> Column:
    """struct(topic, lean, lean_refined, rationale, importance, summary, keywords, countries) of one object; topic and lean are the source's own."""
    told = F.lower(text_of(reply, "$.topic"))
    given = F.try_variant_get(reply, "$.lean", "double")
    words = F.filter(texts(elements(reply, "$.keywords")), lambda k: (k != "") & ~degenerate(k))
    return F.struct(
        F.when(told.isin(TOPICS), told).otherwise(topic).alias("topic"), F.when(given.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), given))).otherwise(lean).alias("lean"), given.isNotNull().alias("lean_refined"),
        clean(text_of(reply, "$.leanRationale")).alias("rationale"), number_of(reply, "$.importance", 0.0, 1.0, F.lit(0.5)).alias("importance"), clean(text_of(reply, "$.summary")).alias("summary"),
        F.slice(words, 1, 10).alias("keywords"), countries(elements(reply, "$.countries"), 4).alias("countries"),
    )


def _first_of_each(rows: Column, same, most: int) -> Column:
    """The first rows with a key of their own; rows and keys are made once, not once for each row."""

    def distinct(rs: Column, keys: Column) -> Column:
        at = F.transform(rs, lambda r, i: F.struct(r.alias("row"), (F.array_position(keys, same(r)) == i + 1).alias("new")))
        return F.slice(F.transform(F.filter(at, lambda x: x["new"]), lambda x: x["row"]), 1, most)

    return bound(rows, lambda rs: bound(F.transform(rs, same), lambda keys: distinct(rs, keys)))


def links(array: Column, most: int = 4) -> Column:
    """array of struct(from, to, kind): pairs of different two-letter codes with a kind, the first row of each pair."""
    rows = F.transform(elements(array), lambda r: F.struct(F.lower(F.trim(text_of(r, "$.from"))).alias("from"), F.lower(F.trim(text_of(r, "$.to"))).alias("to"), kind(text_of(r, "$.kind")).alias("kind")))
    kept = F.filter(rows, lambda r: r["from"].rlike("^[a-z]{2}$") & r["to"].rlike("^[a-z]{2}$") & (r["from"] != r["to"]) & (r["kind"] != ""))
    return _first_of_each(kept, lambda r: F.concat(r["from"], F.lit(">"), r["to"]), most)


def coordinates(text: Column) -> Column:
    """struct(lat, lon) of "lat, lon" in degrees; null out of range or around zero, zero."""
    pattern = r"^(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)$"
    lat, lon = (F.regexp_extract(F.trim(text), pattern, i).try_cast("double") for i in (1, 2))
    usable = (F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ((F.abs(lat) >= 0.01) | (F.abs(lon) >= 0.01))
    return F.when(usable, F.struct(lat.alias("lat"), lon.alias("lon")))


def gatherings(array: Column, most: int = 3) -> Column:
    """array of struct(kind, place, iso2, parties, at): events at one place with two parties or more, the first of each place."""
    rows = F.transform(
        elements(array),
        lambda r: F.struct(
            F.coalesce(F.nullif(kind(text_of(r, "$.kind")), F.lit("")), F.lit("other")).alias("kind"), F.substring(F.trim(text_of(r, "$.place")), 1, 80).alias("place"),
            F.lower(F.trim(text_of(r, "$.iso2"))).alias("iso2"), countries(elements(r, "$.parties"), 8).alias("parties"), coordinates(text_of(r, "$.coords")).alias("at"),
        ),
    )
    kept = F.filter(rows, lambda r: (r["place"] != "") & r["iso2"].rlike("^[a-z]{2}$") & (F.size(r["parties"]) >= 2))
    return _first_of_each(kept, lambda r: F.concat(r["iso2"], F.lit("|"), F.lower(r["place"])), most)


def _pieces(array: Column) -> Column:
    """The texts among an array's elements, clean; those that aren't prose are dropped."""
    told = F.transform(array, lambda x: clean(text_of(x)))
    return F.filter(told, lambda x: x != "")


def strings(array: Column, most: int) -> Column:
    """The first `most` texts that are prose."""
    return F.slice(_pieces(array), 1, most)


def protagonist(reply: Column) -> Column:
    """struct(name, iso2) of the central actor; null without a name, iso2 null unless it is two letters."""
    name, code = clean(text_of(reply, "$.protagonist.name")), F.lower(F.trim(text_of(reply, "$.protagonist.iso2")))
    return F.when(name != "", F.struct(name.alias("name"), F.when(code.rlike("^[a-z]{2}$"), code).alias("iso2")))


def category(reply: Column) -> Column:
    """struct(category, icon): a known category or a name of its own, which keeps its icon; null without one."""
    told = kind(text_of(reply, "$.category"))
    own = F.nullif(icon(text_of(reply, "$.categoryIcon")), F.lit(""))
    return F.when(told != "", F.struct(told.alias("category"), F.when(~told.isin(EVENT_CATEGORIES), own).alias("icon")))


def spectrum(reply: Column) -> Column:
    """struct(left, center, right), empty where nothing is told."""
    return F.struct(*(clean(text_of(reply, f"$.spectrum.{x}")).alias(x) for x in ("left", "center", "right")))


def angles(array: Column, most: int = 6) -> Column:
    """array of struct(outlet, framing): the first rows that have both."""
    rows = F.transform(elements(array), lambda r: F.struct(clean(text_of(r, "$.outlet")).alias("outlet"), clean(text_of(r, "$.framing")).alias("framing")))
    return F.slice(F.filter(rows, lambda r: (r["outlet"] != "") & (r["framing"] != "")), 1, most)


def sides(array: Column, outlets: Column, most: int = 5) -> Column:
    """array of struct(label, framing, outlets, zones): the sides of a dispute, with the zones of those outlets that are members.

    outlets: array of struct(title, zone) of the story's members; an outlet means the member of its whole name, else the first whose name holds it or
    is held by it; a member without a zone is international, an outlet that is no member keeps its name. Sides without outlets are dropped; without
    a zone among the members, or with one side only, there are none.
    """

    def member(name: Column) -> Column:
        want = F.lower(name)
        exact = F.filter(outlets, lambda o: F.lower(o["title"]) == want)
        near = F.filter(outlets, lambda o: F.contains(F.lower(o["title"]), want) | F.contains(want, F.lower(o["title"])))
        return F.coalesce(F.get(exact, F.lit(0)), F.get(near, F.lit(0)))

    def side(r: Column) -> Column:
        named = F.transform(_pieces(elements(r, "$.outlets")), lambda name: F.struct(name.alias("name"), member(name).alias("member")))
        zones = lambda n: F.transform(F.filter(n, lambda x: x["member"].isNotNull()), lambda x: F.coalesce(x["member"]["zone"], F.lit("international")))
        whole = lambda n: F.struct(
            clean(text_of(r, "$.label")).alias("label"), clean(text_of(r, "$.framing")).alias("framing"),
            F.array_distinct(F.transform(n, lambda x: F.coalesce(x["member"]["title"], x["name"]))).alias("outlets"), F.array_distinct(zones(n)).alias("zones"),
        )
        return bound(named, whole)

    kept = F.slice(F.filter(F.transform(elements(array), side), lambda s: (s["label"] != "") & (s["framing"] != "") & (F.size(s["outlets"]) > 0)), 1, most)
    return bound(kept, lambda k: F.when(F.exists(outlets, lambda o: o["zone"].isNotNull()) & (F.size(k) >= 2), k))


def threads(array: Column, most: int = 5) -> Column:
    """array of struct(title, detail): the first rows that have either."""
    rows = F.transform(elements(array), lambda r: F.struct(*(F.trim(F.coalesce(text_of(r, f"$.{x}"), F.lit(""))).alias(x) for x in ("title", "detail"))))
    return F.slice(F.filter(rows, lambda r: (r["title"] != "") | (r["detail"] != "")), 1, most)


def ids(array: Column, count: int, most: int) -> Column:
    """Distinct whole numbers from 1 to count, in order."""
    told = F.transform(elements(array), lambda x: F.coalesce(F.try_variant_get(x, "$", "bigint"), F.regexp_extract(text_of(x), r"^\s*(-?\d+)", 1).try_cast("bigint")))
    return F.slice(F.array_distinct(F.filter(told, lambda n: (n >= 1) & (n <= count))), 1, most)


def scaffolding(text: Column) -> Column:
    bare = F.trim(text)
    found = bare == ""
    for pattern in SCAFFOLDING:
        found = found | bare.rlike(pattern)
    return found


def paragraphs(reply: Column, title: Column) -> Column:
    """Paragraphs of an article without fences, left-over JSON, the title and repeats in a row; none if nothing reads like prose."""
    told = F.transform(F.filter(elements(reply, "$.paragraphs"), lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.trim(F.regexp_replace(F.try_variant_get(x, "$", "string"), r"(?i)```(?:json)?", "")))
    heading = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    told = F.filter(told, lambda p: ~scaffolding(p) & ((heading == "") | (F.lower(p) != heading)))
    once = bound(told, lambda ps: F.filter(F.transform(ps, lambda p, i: F.when((i == 0) | (F.get(ps, i - 1) != p), p)), lambda p: p.isNotNull()))
    return bound(once, lambda ps: F.when(F.exists(ps, lambda p: (F.length(p) >= 40) & p.rlike(r"\s")), ps).otherwise(F.array().cast("array<string>")))


#: The named entities that are decoded; others are left as they are.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "hellip": "…", "mdash": "—", "ndash": "–", "rsquo": "’", "lsquo": "‘",
    "rdquo": "”", "ldquo": "“", "laquo": "«", "raquo": "»", "deg": "°", "eacute": "é",
}
#: The three kinds of entities, in the order in which a pass decodes them.
HEX, DECIMAL, NAMED = r"&#[xX][0-9a-fA-F]+;", r"&#[0-9]+;", r"&[a-zA-Z][a-zA-Z0-9]*;"


def _letter(code: Column) -> Column:
    """The letter of a code point; empty out of range."""
    usable = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
    return F.when(usable, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("")


def _replaced(text: Column, pattern: str, told) -> Column:
    """text with what each match of the pattern is told as."""
    pairs = lambda t: F.zip_with(F.split(t, pattern, -1), F.transform(F.regexp_extract_all(t, F.lit(pattern), 0), told), lambda rest, x: F.concat(rest, F.coalesce(x, F.lit(""))))
    return bound(text, lambda t: F.array_join(pairs(t), ""))


def _decode_once(text: Column) -> Column:
    """Hexadecimal, then decimal, then named entities."""
    inside = lambda x, skip: F.substring(x, F.lit(skip + 1), F.length(x) - skip - 1)
    digits = lambda x: F.when(F.length(x) <= 12, x)  # noqa: E731  (longer ones are out of range)
    text = _replaced(text, HEX, lambda x: _letter(F.conv(digits(inside(x, 3)), 16, 10).try_cast("bigint")))
    text = _replaced(text, DECIMAL, lambda x: _letter(digits(inside(x, 2)).try_cast("bigint")))
    names = F.create_map(*(F.lit(x) for pair in ENTITIES.items() for x in pair))
    return _replaced(text, NAMED, lambda x: F.coalesce(F.element_at(names, F.lower(inside(x, 1))), x))


def decode_entities(text: Column, passes: int = 3) -> Column:
    """Entities decoded, also where they were encoded twice."""
    for _ in range(passes):
        text = _decode_once(text)
    return text


def strip_html(html: Column) -> Column:
    """Text without tags, on one line."""
    return F.trim(F.regexp_replace(decode_entities(F.regexp_replace(html, "<[^>]*>", " ")), r"\s+", " "))
