"""Text functions as columns: tokens, hashes, names, queries, HTML. They stay inside the JVM."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no content in a title.
TITLE_STOP = (
    "the and for are but not you all any can her was one our out his has had him she they them their this that with from have will would could "
    "after over into amid says say said new how why what who when where than then its it's as"
).split()
#: Categories of events by priority, and what in a text speaks for each.
EVENT_KEYWORDS = {
    "conflict": ["war", "airstrike", "air strike", "drone strike", "missile", "troops", "invasion", "offensive", "military", "bombing", "shelling", "frontline", "combat", "militant", "insurgent", "artillery", "occupation", "gunmen", "clashes", "killed in"],
    "disaster": ["earthquake", "flood", "wildfire", "hurricane", "tsunami", "drought", "eruption", "volcano", "landslide", "typhoon", "cyclone", "heatwave", "famine", "mudslide", "quake"],
    "health": ["virus", "outbreak", "disease", "pandemic", "vaccine", "epidemic", "covid", "measles", "cholera", "ebola", "mpox", "infection", "health crisis", "contagion"],
    "unrest": ["protest", "riot", "coup", "unrest", "demonstration", "rally", "crackdown", "uprising", "walkout", "election", "referendum", "impeach", "ousted", "dissident"],
    "diplomacy": ["talks", "summit", "treaty", "sanction", "diplomat", "negotiat", "accord", "envoy", "ambassador", "peace deal", "alliance", "memorandum"],
    "tech": ["artificial intelligence", "semiconductor", "quantum", "satellite", "rocket", "spacecraft", "breakthrough", "robot", "startup", "chipmaker", "ai model"],
    "economy": ["inflation", "recession", "stock market", "tariff", "trade war", "gdp", "currency", "interest rate", "bankrupt", "oil price", "economic"],
}
#: Letters with accents and what they are without, from the character tables.
_FOLDED = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00), 0x212A, 0x212B) if unicodedata.normalize("NFD", chr(c)) != chr(c) and unicodedata.normalize("NFD", chr(c))[0].isascii()}
#: Fixed value: words that begin the excluded part of a query.
NEGATION = r"(?i)\b(?:not|no|without|except|excluding|minus|sans|avoid)\b"


def bound(value: Column, then) -> Column:
    """then(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def ascii_tokens(text: Column, least: int = 3, stop: list[str] | tuple[str, ...] = ()) -> Column:
    """Lower-case ASCII words of at least `least` characters, repeats kept. Null gives none."""
    split = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+")
    return F.filter(split, lambda t: (F.length(t) >= least) & ~t.isin(*stop) if stop else F.length(t) >= least)


def title_tokens(title: Column, keywords: Column | None = None) -> Column:
    """Distinct content words of a title and its keywords."""
    text = title if keywords is None else F.concat_ws(" ", title, keywords)
    return F.array_distinct(ascii_tokens(text, 3, TITLE_STOP))


def unicode_tokens(text: Column) -> Column:
    """Lower-case words of letters and digits of any script."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def _hashed(text: Column, start: int, step) -> Column:
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(start).cast("long"), step)


def item_hash(text: Column) -> Column:
    """33-times-xor hash in base 36."""
    h = _hashed(text, 5381, lambda h, c: ((h * 33) % 4294967296).bitwiseXOR(c))
    return F.lower(F.conv(h.cast("string"), 10, 36))


def story_hash(ids: Column) -> Column:
    """story_ and the 33-times-plus hash, in hex, of the sorted ids."""
    h = _hashed(F.array_join(F.array_sort(ids), "|"), 5381, lambda h, c: (h * 33 + c) % 4294967296)
    return F.concat(F.lit("story_"), F.lower(F.hex(h)))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a, unsigned."""
    return _hashed(text, 2166136261, lambda h, c: (h.bitwiseXOR(c) * 16777619) % 4294967296)


def fold(text: Column) -> Column:
    """Text without accents on Latin letters, composed or combining."""
    return F.regexp_replace(F.translate(text, "".join(_FOLDED), "".join(_FOLDED.values())), r"[̀-ͯ]", "")


def slug(text: Column, most: int | None = None, empty: str = "") -> Column:
    """Lower-case ASCII words without accents, with hyphens between; cut to `most` letters, and `empty` where nothing is left."""
    told = F.trim(F.regexp_replace(F.lower(fold(text)), "[^a-z0-9]+", "-"), F.lit("-"))
    told = told if most is None else F.substring(told, 1, most)
    return F.when(told == "", empty).otherwise(told)


def parse_negation(query: Column) -> tuple[Column, Column]:
    """The wanted part of a query, and its excluded terms (sorted): dash terms, and what follows a negation word."""
    dashed = F.transform(F.regexp_extract_all(query, F.lit(r"(?i)(?:^|\s)-([a-z0-9][\w'-]*)"), 1), lambda t: F.lower(t))
    work = F.regexp_replace(query, r"(?i)(^|\s)-([a-z0-9][\w'-]*)", " ")
    at = F.regexp_instr(work, F.lit(NEGATION))
    cue = F.length(F.regexp_extract(work, NEGATION, 0))
    positive = F.trim(F.when(at > 0, F.substring(work, F.lit(1), at - 1)).otherwise(work))
    tail = F.when(at > 0, F.substring(work, at + cue, F.length(work))).otherwise(F.lit(""))
    listed = F.transform(F.split(tail, r"(?i)\s*(?:,|\bor\b|\band\b|/|;)\s*"), lambda t: F.lower(F.trim(F.regexp_replace(t, r"[^\w'\- ]+", " "))))
    return positive, F.array_sort(F.array_distinct(F.concat(dashed, F.filter(listed, lambda t: F.length(t) >= 2))))


def mentions(text: Column, term: str) -> Column:
    """Whether a term occurs on word boundaries, in any case; its white space matches any."""
    import re

    body = r"\s+".join(re.escape(w) for w in term.split())
    return F.coalesce(text, F.lit("")).rlike(rf"(?i)\b{body}\b")


def event_category(text: Column, topic: Column) -> Column:
    """The category with the most keywords in the text, ties by priority; without any, by topic."""
    hay = F.lower(text)
    scores = {c: reduce(lambda a, b: a + b, [F.contains(hay, F.lit(k)).cast("int") for k in words]) for c, words in EVENT_KEYWORDS.items()}
    most = F.greatest(*scores.values())
    chosen = F.when(most == 0, F.when(topic.isin("technology", "science"), "tech").when(topic == "health", "health").when(topic == "economics", "economy").otherwise("other"))
    for name, score in scores.items():
        chosen = chosen.when(score == most, name)
    return chosen


def url_host(url: Column) -> Column:
    """Host in lower case without www.; null if the URL has none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)), r"^www\.", "")
    return F.when(host != "", host)


def host_is_under(host: Column, domains: list[str]) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [(host == d) | host.endswith(f".{d}") for d in domains]), F.lit(False))


#: Publishers whose pages are behind a paywall.
PAYWALLED = (
    "nytimes.com wsj.com ft.com economist.com bloomberg.com washingtonpost.com newyorker.com theatlantic.com wired.com businessinsider.com thetimes.co.uk telegraph.co.uk "
    "theinformation.com foreignpolicy.com seekingalpha.com"
).split()
#: What a page that asks for a proof of being human says.
CHALLENGES = [
    "just a moment", "attention required! | cloudflare", "cf-browser-verification", "cf-challenge", "/cdn-cgi/challenge-platform", "g-recaptcha", "h-captcha", "px-captcha",
    "enable javascript and cookies to continue", "verifying you are human", "request unsuccessful. incapsula",
]


def challenge_page(html: Column) -> Column:
    """Whether a page asks for a proof of being human: one of the signs in its first 4000 letters."""
    head = F.lower(F.substring(html, 1, 4000))
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(head, F.lit(c)) for c in CHALLENGES]), F.lit(False))


def flag(code: Column) -> Column:
    """The flag of a two-letter country code, as its two regional letters; empty for other codes."""
    told = F.lower(F.trim(F.coalesce(code, F.lit(""))))
    letter = lambda i: F.decode(F.unhex(F.lpad(F.hex(F.ascii(F.substring(told, i, 1)) - 97 + 0x1F1E6), 8, "0")), "UTF-32")
    return F.when(told.rlike("^[a-z]{2}$"), F.concat(letter(1), letter(2))).otherwise("")


def country_label(code: Column, label: Column) -> Column:
    """The registry's label of a code, else the code in capitals; International without one."""
    return F.when(code.isNull() | code.isin("", "international"), "International").otherwise(F.coalesce(label, F.upper(code)))


def country_code(*codes: Column) -> Column:
    """The first of the codes that is two letters, in lower case."""
    return F.coalesce(*(F.when(c.rlike("^[A-Za-z]{2}$"), F.lower(c)) for c in codes))


def clean_aliases(names: Column) -> Column:
    """Distinct names in lower case of three letters or more, with a letter, that are no address."""
    told = F.transform(names, lambda x: F.lower(F.trim(x)))
    return F.array_distinct(F.filter(told, lambda x: (F.length(x) >= 3) & x.rlike(r"\p{L}") & ~x.rlike("^https?:")))


def translated(key: Column, own: Column, english: Column, params: dict[str, Column]) -> Column:
    """A message in a reader's language, else in English, else its key, with {name} filled in."""
    text = F.coalesce(own, english, key)
    for name, value in params.items():
        text = F.replace(text, F.lit("{" + name + "}"), value.cast("string"))
    return text


def plain_entities(text: Column) -> Column:
    """The few entities of a page's text, decoded once, one after the other."""
    for pattern, told in ((r"(?i)&nbsp;", " "), (r"(?i)&amp;", "&"), (r"(?i)&lt;", "<"), (r"(?i)&gt;", ">"), (r"(?i)&quot;", '"'), (r"(?i)&#39;|&apos;", "'")):
        text = F.regexp_replace(text, pattern, told)
    code = lambda d: F.when(F.length(d) <= 10, d).try_cast("bigint")
    usable = lambda c: ((c > 0) & (c < 0xD800)) | ((c > 0xDFFF) & (c <= 0x10FFFF))
    letter = lambda d: F.when(usable(code(d)), F.decode(F.unhex(F.lpad(F.hex(code(d)), 8, "0")), "UTF-32")).otherwise("")
    pairs = lambda t: F.zip_with(F.split(t, "&#[0-9]+;", -1), F.transform(F.regexp_extract_all(t, F.lit("&#([0-9]+);"), 1), letter), lambda rest, x: F.concat(rest, F.coalesce(x, F.lit(""))))
    return bound(text, lambda t: F.array_join(pairs(t), ""))


def title_case(text: Column) -> Column:
    return F.initcap(text)


def html_title(html: Column) -> Column:
    """The first title, without white space around it."""
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


#: Elements that aren't what a page is about.
BOILERPLATE = ("script", "style", "nav", "header", "footer", "aside", "form", "noscript", "svg", "figure", "iframe")


def html_paragraphs(html: Column, least: int = 40) -> Column:
    """Paragraphs of at least `least` characters, without boilerplate elements, tags and comments."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->", " ")
    for element in BOILERPLATE:
        bare = F.regexp_replace(bare, rf"(?is)<{element}\b[^>]*>.*?</{element}>", " ")
    broken = F.regexp_replace(F.regexp_replace(bare, r"(?i)</(p|div|section|li|h[1-6]|br|tr)>", "\n\n"), r"(?i)<br\s*/?>", "\n")
    told = F.split(plain_entities(F.regexp_replace(broken, r"<[^>]*>", " ")), r"\n{2,}")
    told = F.transform(told, lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"[ \t]+", " "), r"\s*\n\s*", " ")))
    return F.filter(told, lambda p: F.length(p) >= least)


def youtube_id(url: Column) -> Column:
    """The video of a watch, short, embed or shorts address; null for others."""
    found = [F.regexp_extract(url, p, 1) for p in (r"[?&]v=([\w-]{11})", r"youtu\.be/([\w-]{11})", r"/embed/([\w-]{11})", r"/shorts/([\w-]{11})")]
    return F.coalesce(*(F.when(x != "", x) for x in found))


def vtt_text(vtt: Column) -> Column:
    """Captions as text: no header, timings, numbers and tags, and no line twice in a row."""
    lines = F.transform(F.split(vtt, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"<[^>]+>", "")))
    lines = F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^(WEBVTT|NOTE|Kind:|Language:)") & ~x.contains("-->") & ~x.rlike(r"^\d+$"))
    once = F.aggregate(lines, F.array().cast("array<string>"), lambda kept, x: F.when((F.size(kept) > 0) & (F.element_at(kept, -1) == x), kept).otherwise(F.array_append(kept, x)))
    return F.array_join(once, " ")


def degenerate(text: Column) -> Column:
    """Whether a text is blank, a run of one sign, or hardly any letters. The patterns are fixed values."""
    letters, signs = F.length(F.regexp_replace(text, r"[^\p{L}]+", "")), F.length(F.regexp_replace(text, r"\s+", ""))
    return text.rlike(r"([^\p{L}\p{N}\s])\1{3,}") | text.rlike(r"[^\p{L}\p{N}\s]{6,}") | (signs == 0) | (letters / F.greatest(signs, F.lit(1)) < 0.4)
