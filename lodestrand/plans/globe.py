"""Queries on directions, arcs, rings and colours. Customers and nations are given places by a fixed rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrand.functions import sphere as S
from lodestrand.plans.adapters import table
from lodestrand.plans.queries import r6
from lodestrand.plans.registry import query

XYZ = ("x", "y", "z")


def _axes(v, prefix=""):
    return [(r6(v[i]) + 0.0).alias(prefix + a) for i, a in enumerate(XYZ)]


@query(
    """WITH n AS (SELECT n_nationkey AS id, n_regionkey AS level, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i, count(*) OVER (PARTITION BY n_regionkey) AS n,
    ((xor(2166136261::BIGINT, 48 + n_regionkey) * 16777619) % 4294967296) / 4294967295.0::DOUBLE * 2 * pi() AS t FROM nation), p AS (SELECT *, 1 - i / (n - 1) * 2 AS y, pi() * (3 - sqrt(5)) * i + t AS a FROM n)
    SELECT id, round(cos(a) * sqrt(greatest(0, 1 - y * y)), 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(sin(a) * sqrt(greatest(0, 1 - y * y)), 6) + 0.0 AS z FROM p"""
)
def sphere_layout(spark, sf):
    nodes = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").cast("string").alias("level"))
    return S.layout(nodes, "level", "id").select("id", *_axes(F.col("place")))


SQL_ENDS = "e AS (SELECT c_custkey AS id, radians((c_custkey * 37) % 121 - 60) AS la, -radians((c_custkey * 101) % 361 - 180) AS lo, radians((c_custkey * 17) % 111 - 55) AS lb, -radians((c_custkey * 53) % 361 - 180) AS mo FROM customer)"


@query(
    f"""WITH {SQL_ENDS}, v AS (SELECT id, [cos(la) * cos(lo), sin(la), cos(la) * sin(lo)] AS a, [cos(lb) * cos(mo), sin(lb), cos(lb) * sin(mo)] AS b FROM e), w AS (SELECT *, acos(greatest(-1, least(1, list_dot_product(a, b)))) AS o FROM v WHERE abs(list_dot_product(a, b)) < 0.999),
    t AS (SELECT *, unnest(range(0, 5)) AS i FROM w), f AS (SELECT *, sin((1 - i / 4) * o) AS p, sin(i / 4 * o) AS q, 1 + 0.3 * (o / pi()) * sin(pi() * i / 4) AS h FROM t),
    g AS (SELECT *, [p * a[1] + q * b[1], p * a[2] + q * b[2], p * a[3] + q * b[3]] AS m FROM f)
    SELECT id, i, round(h * m[1] / sqrt(list_dot_product(m, m)), 6) + 0.0 AS x, round(h * m[2] / sqrt(list_dot_product(m, m)), 6) + 0.0 AS y, round(h * m[3] / sqrt(list_dot_product(m, m)), 6) + 0.0 AS z FROM g"""
)
def great_arcs(spark, sf):
    k = F.col("c_custkey")
    ends = table(spark, sf, "customer").select(
        k.alias("id"), S.direction((k * 37) % 121 - 60, (k * 101) % 361 - 180).alias("a"), S.direction((k * 17) % 111 - 55, (k * 53) % 361 - 180).alias("b")
    )
    told = ends.where(F.abs(S.dot(F.col("a"), F.col("b"))) < 0.999).select("id", F.posexplode(S.arc(F.col("a"), F.col("b"), 4, lift=0.3)).alias("i", "p"))
    return told.select("id", F.col("i").cast("long").alias("i"), *_axes(F.col("p")))


@query("SELECT c_custkey AS id, 6::BIGINT AS n, round(cos(atan(0.18)), 6) AS near, round(cos(atan(0.18)), 6) AS far FROM customer")
def tangent_rings(spark, sf):
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(k.alias("id"), S.direction((k * 37) % 181 - 90, (k * 101) % 361 - 180).alias("c"))
    rows = rows.select("id", "c", F.explode(S.ring_around(F.col("c"), 6)).alias("p")).select("id", S.dot(F.col("c"), F.col("p")).alias("d"))
    return rows.groupBy("id").agg(F.count("*").alias("n"), r6(F.max("d")).alias("near"), r6(F.min("d")).alias("far"))


@query("SELECT c_custkey AS id, floor((c_custkey % 60) * 0.05 / 0.15 + 0.5)::BIGINT AS tier, round(0.1 / greatest(0.15, floor((c_custkey % 60) * 0.05 / 0.15 + 0.5) * 0.15), 6) AS angle, CASE WHEN c_custkey % 9 > 0 THEN round(0.1 / ((c_custkey % 9) * 0.01 * 0.6), 6) END AS zoom FROM customer")
def zoom_tiers(spark, sf):
    k = F.col("c_custkey")
    tier, zoom = S.zoom_tier((k % 60) * 0.05), S.split_zoom((k % 9) * 0.01)
    return table(spark, sf, "customer").select(k.alias("id"), tier.alias("tier"), r6(S.merge_angle(tier)).alias("angle"), F.when(zoom < float("inf"), r6(zoom)).alias("zoom"))


def _shapes(spark, sf):
    k = F.col("c_custkey")
    lon, lat, side = ((k * 7) % 300 - 150).cast("double"), ((k * 3) % 120 - 60).cast("double"), (k % 9 + 1).cast("double")
    square = lambda s: F.array(F.array(lon, lat), F.array(lon + s, lat), F.array(lon + s, lat + s), F.array(lon, lat + s))
    return table(spark, sf, "customer").select(k.alias("id"), "c_nationkey", F.array(square(side / 2), square(side), square(-side)).alias("rings"))


@query(
    """WITH s AS (SELECT c_custkey AS id, (c_custkey * 7) % 300 - 150 AS lon, (c_custkey * 3) % 120 - 60 AS lat, c_custkey % 9 + 1 AS d FROM customer),
    c AS (SELECT id, d, radians(lat + dy * d) AS la, -radians(lon + dx * d) AS lo FROM s, (VALUES (0, 0), (1, 0), (1, 1), (0, 1)) AS v(dx, dy)), m AS (SELECT id, d, sum(cos(la) * cos(lo)) AS x, sum(sin(la)) AS y, sum(cos(la) * sin(lo)) AS z FROM c GROUP BY ALL)
    SELECT id, (d * d)::DOUBLE AS area, round(x / sqrt(x * x + y * y + z * z), 6) + 0.0 AS x, round(y / sqrt(x * x + y * y + z * z), 6) + 0.0 AS y, round(z / sqrt(x * x + y * y + z * z), 6) + 0.0 AS z FROM m"""
)
def ring_centres(spark, sf):
    ring = _shapes(spark, sf).select("id", S.largest_ring(F.col("rings")).alias("ring"))
    return ring.select("id", S.ring_area(F.col("ring")).alias("area"), *_axes(S.ring_direction(F.col("ring"))))


@query("SELECT c_nationkey AS nation, min((c_custkey * 7) % 300 - 150 - (c_custkey % 9 + 1))::DOUBLE AS min_lon, min((c_custkey * 3) % 120 - 60 - (c_custkey % 9 + 1))::DOUBLE AS min_lat, max((c_custkey * 7) % 300 - 150 + (c_custkey % 9 + 1))::DOUBLE AS max_lon, max((c_custkey * 3) % 120 - 60 + (c_custkey % 9 + 1))::DOUBLE AS max_lat FROM customer GROUP BY 1")
def country_boxes(spark, sf):
    return S.boxes(_shapes(spark, sf).withColumnRenamed("c_nationkey", "nation"), "nation", "rings")


@query(
    """WITH h AS (SELECT c_custkey AS id, (c_custkey * 29) % 360 AS h FROM customer), c AS (SELECT id, h, (1 - abs(2 * 0.72 - 1)) * 0.68 AS c FROM h), x AS (SELECT *, c * (1 - abs((h / 60) % 2 - 1)) AS x, 0.72 - c / 2 AS m FROM c),
    p AS (SELECT id, m, CASE (h // 60) WHEN 0 THEN [c, x, 0] WHEN 1 THEN [x, c, 0] WHEN 2 THEN [0, c, x] WHEN 3 THEN [0, x, c] WHEN 4 THEN [x, 0, c] ELSE [c, 0, x] END AS v FROM x)
    SELECT id, printf('#%02x%02x%02x', floor(round((v[1] + m) * 255, 9) + 0.5)::INT, floor(round((v[2] + m) * 255, 9) + 0.5)::INT, floor(round((v[3] + m) * 255, 9) + 0.5)::INT) AS color FROM p"""
)
def hue_colors(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), S.hsl_hex((F.col("c_custkey") * 29) % 360).alias("color"))
