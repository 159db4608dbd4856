"""Directions on a unit sphere as array columns [x, y, z], arcs between them, rings of places and colours by angle."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrand.functions.numbers import angle, dot, half_up, on_sphere
from lodestrand.functions.text import fnv1a

GOLDEN_ANGLE = math.pi * (3 - math.sqrt(5))
#: The angle within which markers merge at zoom 1, the step between tiers, and how far a click zooms past the split.
MERGE_ANGLE, ZOOM_STEP, SPLIT_MARGIN = 0.1, 0.15, 0.6


def direction(lat: Column, lon: Column) -> Column:
    return F.array(*on_sphere(lat, lon))


def bound(value: Column, told: Callable[[Column], Column]) -> Column:
    """told(value) with the value computed once; plain nesting would repeat its expression at every use."""
    return F.get(F.transform(F.array(value), told), F.lit(0))


def length(v: Column) -> Column:
    return bound(v, lambda v: F.sqrt(dot(v, v)))


def unit(v: Column) -> Column:
    """The vector with length 1; the zero vector stays."""
    return bound(v, lambda v: bound(F.sqrt(dot(v, v)), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0))))


def cross(a: Column, b: Column) -> Column:
    def told(p: Column) -> Column:
        a, b = p["a"], p["b"]
        return F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])

    return bound(F.struct(a.alias("a"), b.alias("b")), told)


def spread_evenly(at: Column, n: Column, start: Column) -> Column:
    """The at-th (from 0) of n directions on a golden spiral from north to south; one alone faces the viewer."""
    y = 1 - at / (n - 1) * 2
    radius, turn = F.sqrt(F.greatest(F.lit(0.0), 1 - y * y)), at * GOLDEN_ANGLE + start
    return F.when(n == 1, F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.cos(turn) * radius, y, F.sin(turn) * radius))


def layout(nodes: DataFrame, level: str, node: str) -> DataFrame:
    """nodes with a place for each: those of one level, by id, on a spiral turned by the level's hash. A level is a bounded part of the place tree."""
    at = F.row_number().over(Window.partitionBy(level).orderBy(node)) - 1
    n = F.count("*").over(Window.partitionBy(level))
    return nodes.withColumn("place", spread_evenly(at, n, fnv1a(F.col(level)) / 4294967295.0 * (2 * math.pi)))


def ring_around(center: Column, n: int, spread: float = 0.18) -> Column:
    """n directions on a small circle around one; below two, that one."""
    if n <= 1:
        return F.array(unit(center))
    north, east = (F.array(*(F.lit(float(x)) for x in axis)) for axis in ((0, 1, 0), (1, 0, 0)))

    def turned(f: Column) -> Column:
        c, u, v = f["c"], f["u"], f["v"]
        point = lambda t: F.array(*(c[j] + spread * (u[j] * F.cos(t) + v[j] * F.sin(t)) for j in range(3)))
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: unit(point(i * (2 * math.pi / n))))

    def framed(c: Column) -> Column:
        u = unit(cross(c, F.when(F.abs(c[1]) < 0.9, north).otherwise(east)))
        return bound(u, lambda u: bound(F.struct(c.alias("c"), u.alias("u"), unit(cross(c, u)).alias("v")), turned))

    return bound(unit(center), framed)


def arc_point(a: Column, b: Column, t: Column, radius: float = 1.0, lift: float = 0.0) -> Column:
    """The point at share t of the great circle from a to b, lifted most half-way, more for long ones."""

    def told(whole: Column) -> Column:
        sine = F.when(F.sin(whole) == 0, 1e-6).otherwise(F.sin(whole))
        flat = F.zip_with(a, b, lambda x, y: x * F.sin((1 - t) * whole) / sine + y * F.sin(t * whole) / sine)
        return F.transform(unit(flat), lambda x: x * (radius * (1 + lift * (whole / math.pi) * F.sin(math.pi * t))))

    return bound(angle(dot(a, b)), told)


def arc(a: Column, b: Column, segments: int, radius: float = 1.0, lift: float = 0.0) -> Column:
    """segments + 1 points from a to b (unit directions)."""
    return F.transform(F.sequence(F.lit(0), F.lit(segments)), lambda i: arc_point(a, b, i / segments, radius, lift))


def zoom_tier(zoom: Column) -> Column:
    return half_up(zoom / ZOOM_STEP).cast("long")


def merge_angle(tier: Column) -> Column:
    return MERGE_ANGLE / F.greatest(F.lit(ZOOM_STEP), tier * ZOOM_STEP)


def split_zoom(radius: Column) -> Column:
    """The zoom at which a cluster of that radius comes apart; infinite for points in one place."""
    return F.when(radius <= 1e-4, float("inf")).otherwise(MERGE_ANGLE / (radius * SPLIT_MARGIN))


def ring_area(ring: Column) -> Column:
    """Area in square degrees of a ring of [lon, lat]."""
    after = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.abs(F.aggregate(F.zip_with(ring, after, lambda p, q: p[0] * q[1] - q[0] * p[1]), F.lit(0.0), lambda s, x: s + x)) / 2


def largest_ring(rings: Column) -> Column:
    """The first of the largest rings; null without rings."""
    sized = F.transform(rings, lambda r, i: F.struct((-ring_area(r)).alias("by"), i.alias("i"), r.alias("ring")))
    return F.get(F.array_sort(sized), F.lit(0))["ring"]


def ring_direction(ring: Column) -> Column:
    """The mean direction of a ring's corners."""
    corners = F.transform(ring, lambda p: direction(p[1], p[0]))
    zero = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    return unit(F.aggregate(corners, zero, lambda s, c: F.zip_with(s, c, lambda x, y: x + y)))


def boxes(shapes: DataFrame, key: str, rings: str) -> DataFrame:
    """key, min_lon, min_lat, max_lon, max_lat over all rings (arrays of [lon, lat]) of each key."""
    corners = shapes.select(key, F.explode(F.flatten(rings)).alias("p"))
    lon, lat = F.col("p")[0], F.col("p")[1]
    return corners.groupBy(key).agg(F.min(lon).alias("min_lon"), F.min(lat).alias("min_lat"), F.max(lon).alias("max_lon"), F.max(lat).alias("max_lat"))


def hsl_hex(hue: Column, saturation: int = 68, lightness: int = 72) -> Column:
    """#rrggbb of a hue in degrees."""
    s, light = saturation / 100, lightness / 100
    spread = s * min(light, 1 - light)

    def channel(n: int) -> Column:
        k = (n + hue / 30) % 12
        value = light - spread * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0)))
        return F.lpad(F.lower(F.hex(half_up(F.round(value * 255, 9)).cast("long"))), 2, "0")

    return F.concat(F.lit("#"), channel(0), channel(8), channel(4))


def kind_color(kind: Column) -> Column:
    """The same light colour for the same word."""
    return hsl_hex(fnv1a(kind) % 360)
