"""Columns on what a reader is interested in, how items are told to them, and pages as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrand.functions.numbers import HOUR_MS, clamp01, duration_seconds, half_up, personalized, read_minutes
from lodestrand.functions.replies import decode_entities
from lodestrand.functions.text import ascii_tokens

#: Words that carry no interest.
INTEREST_STOP = (
    "the and for are but not you all any can her was one our out his has had him she its who get got via per about with from into that this your their what when more "
    "of to in is it on as at by an or be we do"
).split()
#: Words that speak for a concept beside itself.
SYNONYMS = {
    "ai": ["artificial", "intelligence", "llm", "llms", "ml", "machine", "learning", "neural", "gpt", "openai", "anthropic", "model", "models", "agent", "agents", "chatbot"],
    "ml": ["machine", "learning", "ai", "model", "models"],
    "llm": ["ai", "language", "model", "models", "gpt"],
    "scientific": ["science", "research", "study", "physics", "biology", "chemistry"],
    "science": ["scientific", "research", "study", "physics", "biology", "chemistry"],
    "progress": ["breakthrough", "advance", "advances", "innovation", "development"],
    "geopolitics": ["geopolitical", "diplomacy", "foreign", "war", "conflict", "sanctions", "nato"],
    "economics": ["economy", "economic", "markets", "market", "inflation", "trade", "fiscal", "monetary"],
    "markets": ["market", "stocks", "stock", "economy", "economic", "trading"],
    "climate": ["warming", "carbon", "emissions", "renewable", "environment", "sustainability"],
    "energy": ["nuclear", "solar", "wind", "renewable", "grid", "battery", "oil", "gas"],
    "health": ["medicine", "medical", "disease", "longevity", "biotech", "clinical"],
    "space": ["nasa", "rocket", "satellite", "orbital", "spacex", "astronomy"],
}


def interest_words(text: Column) -> Column:
    """Words of two letters or more that may be an interest, repeats kept."""
    return ascii_tokens(text, 2, INTEREST_STOP)


def interest_match(interest: str, words: Column) -> Column:
    """The share of an interest's distinct concepts among an item's words: the word, a synonym, or a common stem of five letters."""
    import re

    told = [w for w in re.split("[^a-z0-9]+", interest.lower()) if len(w) >= 2 and w not in INTEREST_STOP]
    concepts = list(dict.fromkeys(told))
    if not concepts:
        return F.lit(0.0)

    def met(concept: str) -> Column:
        found = F.arrays_overlap(words, F.array(*(F.lit(w) for w in [concept, *SYNONYMS.get(concept, [])])))
        if len(concept) >= 5:
            found = found | F.exists(words, lambda w: (F.length(w) >= 5) & (F.startswith(w, F.lit(concept)) | F.startswith(F.lit(concept), w)))
        return F.coalesce(found, F.lit(False)).cast("int")

    total = met(concepts[0])
    for concept in concepts[1:]:
        total = total + met(concept)
    return total / len(concepts)


def relevance(importance: Column, match: Column | None, provisional: Column, prescreen: Column) -> Column:
    """Importance blended with the match, if there is an interest; a provisional row counts at most 0.6."""
    weight = F.when(provisional, F.least(F.lit(0.6), F.coalesce(prescreen, F.lit(0.4)))).otherwise(importance)
    return weight if match is None else personalized(weight, match)


def relative_age(published_at: Column, now_ms: int) -> Column:
    hours = F.greatest(F.lit(0), half_up((F.lit(now_ms) - published_at) / HOUR_MS).cast("long"))
    return F.when(hours < 1, "just now").when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago"))).otherwise(F.concat(half_up(hours / 24).cast("long").cast("string"), F.lit("d ago")))


def embed_text(*parts: Column) -> Column:
    """The parts that aren't empty, as one text of at most 1000 letters."""
    return F.substring(F.array_join(F.filter(F.array(*(F.trim(p) for p in parts)), lambda x: x != ""), ". "), 1, 1000)


def headline_query(title: Column) -> Column:
    """A title without quotes around it and a short outlet at its end, at most 120 letters."""
    bare = F.trim(F.regexp_replace(F.trim(F.coalesce(title, F.lit(""))), "^[\"'“”]+|[\"'“”]+$", ""))
    return F.trim(F.substring(F.trim(F.regexp_replace(bare, r"\s+[-–—|]\s+[^-–—|]{1,40}$", "")), 1, 120))


def interest_key(text: Column) -> Column:
    return F.substring(F.regexp_replace(F.lower(F.trim(text)), r"\s+", " "), 1, 400)


def minutes(kind: Column, duration: Column, summary: Column) -> Column:
    """Minutes an item takes: its duration, else the words of news, else what is usual for its kind."""
    said = duration_seconds(duration)
    plain = F.when(F.trim(F.coalesce(summary, F.lit(""))) != "", read_minutes(summary)).otherwise(4)
    return F.when(said.isNotNull(), F.greatest(F.lit(1), half_up(said / 60).cast("long"))).when(kind == "news", plain).when(kind == "podcast", 35).otherwise(12)


def page_title(html: Column) -> Column:
    """The title a page is shared under, else its first heading, else its title."""
    tries = (
        F.regexp_extract(html, r"""(?i)<meta[^>]+property=["']og:title["'][^>]+content=["']([^"']+)["']""", 1),
        F.regexp_replace(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]*>", ""), F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1),
    )
    return F.trim(decode_entities(F.coalesce(*(F.when(t != "", t) for t in tries), F.lit(""))))


def main_region(html: Column, least: int = 400) -> Column:
    """The article, else the main part, of more than `least` letters; else the body, else all."""
    inside = lambda tag: F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)
    return F.coalesce(*(F.when(F.length(inside(t)) > least, inside(t)) for t in ("article", "main")), F.when(html.rlike("(?is)<body[^>]*>.*?</body>"), inside("body")), html)


def markdown_text(markdown: Column, least: int = 40) -> Column:
    """Paragraphs of at least `least` letters of a page told as Markdown, without its signs and the header before its content."""
    bare = F.regexp_replace(markdown, r"(?is)^.*?Markdown Content:\s*", "")
    for pattern, told in ((r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]+)\]\([^)]*\)", "$1"), (r"(?m)^#{1,6}\s+", ""), ("[*_`>]", ""), (r"(?m)^[ \t]*[-+][ \t]+", "")):
        bare = F.regexp_replace(bare, pattern, told)
    parts = F.transform(F.split(bare, r"\n{2,}"), lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"[ \t]+", " "), r"\s*\n\s*", " ")))
    return F.array_join(F.filter(parts, lambda p: F.length(p) >= least), "\n\n")


def used_share(used: Column, quota: Column) -> Column:
    """How much of a quota is used, 0 to 1; 0 without one."""
    return F.when(quota > 0, clamp01(used / quota)).otherwise(0.0)
