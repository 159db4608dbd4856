"""Numeric functions as columns: lean, recency, relevance, minutes, vectors, places on a sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS, HOUR_MS = 86_400_000, 3_600_000


def lean_bucket(lean: Column) -> Column:
    return (
        F.when(lean.isNull() | F.isnan(lean), "non-political").when(lean <= -0.6, "left").when(lean <= -0.2, "lean-left")
        .when(lean < 0.2, "center").when(lean < 0.6, "lean-right").otherwise("right")
    )


def lean_bucket_label(bucket: Column) -> Column:
    """A bucket as a reader is shown it."""
    return F.concat(F.upper(F.substring(bucket, 1, 1)), F.when(bucket == "non-political", "on-political").otherwise(F.translate(F.substring(bucket, 2, 20), "-", " ")))


def lean_label(lean: Column) -> Column:
    """A lean as a model is told it: other bounds than those of the buckets."""
    return (
        F.when(lean.isNull() | F.isnan(lean), "non-political").when(lean <= -0.6, "left").when(lean < -0.15, "center-left")
        .when(lean <= 0.15, "center").when(lean < 0.6, "center-right").otherwise("right")
    )


def political(lean: Column) -> Column:
    return lean.isNotNull() & ~F.isnan(lean)


def half_up(x: Column) -> Column:
    """Rounding where halves go up, also below zero."""
    return F.floor(x + 0.5)


def decay(published_at: Column, now_ms: int, half_life_hours: float = 24.0) -> Column:
    """1 for what is new, half as much each half-life."""
    age = F.greatest(F.lit(0), F.lit(now_ms) - published_at) / HOUR_MS
    return F.pow(F.lit(2.0), -age / half_life_hours)


def base_score(relevance: Column, published_at: Column, now_ms: int, recency_weight: float = 0.3, half_life_hours: float = 24.0) -> Column:
    return (1 - recency_weight) * F.coalesce(relevance, F.lit(0.5)) + recency_weight * decay(published_at, now_ms, half_life_hours)


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def personalized(importance: Column, match: Column) -> Column:
    return clamp01(0.6 * match + 0.4 * importance)


def semantic_match(cosine: Column) -> Column:
    return clamp01((cosine - 0.2) / 0.6)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the shorter length; 0 if a vector is null, empty or zero."""
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, 1, n), F.slice(b, 1, n)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((n > 0) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def read_minutes(text: Column, words_a_minute: int = 200) -> Column:
    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))
    return F.greatest(F.lit(1), half_up(words / words_a_minute)).cast("long")


def duration_seconds(raw: Column) -> Column:
    """Seconds of "90", "12:30" or "1:02:03"; null for what isn't a positive duration."""
    parts = F.split(F.trim(raw), ":")
    total = F.aggregate(F.transform(parts, lambda p: p.try_cast("double")), F.lit(0.0), lambda s, x: s * 60 + x)
    return F.when(F.trim(raw).rlike(r"^\d+(\.\d+)?(:\d+){0,2}$") & (total > 0), half_up(total).cast("long"))


def recency_band(updated_at: Column, developing: Column, now_ms: int) -> Column:
    age = F.lit(now_ms) - updated_at
    return F.when(age <= 6 * HOUR_MS, "fresh").when(age <= DAY_MS, "recent").when((age <= 7 * DAY_MS) | developing, "week").otherwise("stale")


def on_sphere(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """Unit vector of a place; the longitude is negated."""
    la, lo = F.radians(lat), F.radians(-lon)
    return F.cos(la) * F.cos(lo), F.sin(la), F.cos(la) * F.sin(lo)


def angle(dot_product: Column) -> Column:
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot_product)))
