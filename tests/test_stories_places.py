"""Folds and place functions without SQL: small cases worked by hand, and the edges: nulls, empty tables, ties."""

import pandas as pd
from pyspark.sql import functions as F

from lodestrand.functions import reading, replies
from lodestrand.functions import sphere as S
from lodestrand.operators import greedy, places, stories


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_issues_join_by_words_and_time(spark):
    day = greedy.DAY_MS
    rows = [
        ("w", 1, ["a", "b", "c"], None, 0, 5, 0, day), ("w", 2, ["a", "b", "d"], None, 0, 3, 2 * day, 3 * day),
        ("w", 3, ["a", "b", "c"], None, 0, 2, 40 * day, 41 * day), ("w", 4, ["x"], None, 0, 1, 0, day), ("v", 5, [], None, 0, 1, 0, 0),
    ]
    df = spark.createDataFrame(rows, "world string, cluster long, tokens array<string>, vector_sum array<double>, vector_n long, coverage long, first_at long, last_at long")
    assert {(r["cluster"], r["issue"]) for r in greedy.issues(df, "world").collect()} == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 5)}


def test_issues_by_mean_vectors():
    rows = pd.DataFrame({"tokens": [[], [], []], "vector_sum": [[2.0, 0.0], [0.9, 0.1], [0.0, 1.0]], "vector_n": [2, 1, 1], "first_at": [0, 0, 0], "last_at": [0, 0, 0]})
    assert greedy.replay_issues(rows, 0.6, 0.18, 10) == [0, 0, 2]


def test_points_merge_with_the_strongest_near_one(spark):
    rows = [("l", 1, 5.0, 1.0, 0.0, 0.0), ("l", 2, 9.0, 0.999, 0.0447, 0.0), ("l", 3, 9.0, 0.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "layer string, id long, severity double, x double, y double, z double")
    assert {(r["id"], r["seed"]) for r in greedy.point_clusters(df, "layer").collect()} == {(1, 2), (2, 2), (3, 3)}


def test_a_story_is_claimed_once(spark):
    specs = spark.createDataFrame([("w", "event", 1, "s1", [1, 2, 3]), ("w", "event", 2, "s2", [1, 2]), ("w", "issue", 3, "s3", [1, 2, 3])], "world string, kind string, position long, spec string, ids array<long>")
    known = spark.createDataFrame([("w", "event", "k1", [1, 2, 3]), ("w", "event", "k2", [1, 2, 9])], "world string, kind string, story string, ids array<long>")
    assert {(r["spec"], r["story"], round(r["score"], 3)) for r in stories.match_stories(specs, known).collect()} == {("s1", "k1", 1.0), ("s2", "k2", 0.667)}
    assert stories.match_stories(specs.limit(0), known).count() == 0


def test_interest_feed_fills_the_quota():
    rows = pd.DataFrame({"lean": [-0.5, -0.5, None], "minutes": [5.0, 5.0, 5.0], "base": [0.9, 0.85, 0.8], "topic": [1, 1, 2], "source_id": ["a", "a", "b"]})
    assert greedy.interest_feed(rows, 10.0) == [0, 2]


def test_deal_tops_up_from_the_deck(spark):
    sources = spark.createDataFrame([(i, i > 2, i if i <= 2 else None) for i in range(1, 11)], "id long, in_deck boolean, seen long")
    told = {r["id"]: r["fresh"] for r in stories.deal(sources, 8, 1).collect()}
    assert len(told) == 8 and {1, 2} <= set(told) and sum(told.values()) == 6
    assert stories.deal(sources, 50, 1).count() == 10


def test_chain_and_score(spark):
    nodes = spark.createDataFrame(
        [("es", None, "country", "Spain", "es", ["spain", "españa"]), ("es-md", "es", "region", "Madrid", "es", ["madrid"]), ("es-md-mostoles", "es-md", "locality", "Móstoles", "es", ["móstoles"])],
        "id string, parent string, level string, label string, country string, aliases array<string>",
    )
    found = places.chain(nodes, {"country": "es", "region": "es-md", "locality": "Mostoles"})
    assert places.place_label(found) == "Spain · Madrid · Móstoles"
    assert one(spark, places.place_score(F.lit("In MÓSTOLES, Madrid; madrid."), found)) == 5
    assert places.chain(nodes, {"country": "es", "locality": "Elche"})[-1]["aliases"] == ["elche"]
    assert one(spark, places.place_score(F.lit(None).cast("string"), found)) == 0
    assert one(spark, places.place_key(F.lit(" Sáo-Tomé! "))) == "sao tome"


def test_replies_that_cannot_be_read(spark):
    assert one(spark, F.size(replies.elements(replies.reply_array(F.lit("no array"))))) == 0
    assert one(spark, F.size(replies.elements(replies.reply_array(F.lit(None).cast("string"))))) == 0
    assert one(spark, replies.reply_object(F.lit("[1, 2]")).isNull())
    assert one(spark, replies.coordinates(F.lit("0.001, 0"))) is None
    assert one(spark, replies.coordinates(F.lit("48.2, 16.4"))).asDict() == {"lat": 48.2, "lon": 16.4}
    assert one(spark, replies.decode_entities(F.lit("&#0;&#x1F600;&#55296;&bogus;"))) == "😀&bogus;"
    assert one(spark, replies.icon(F.lit(" Air_Plane-1! "))) == "airplane-1"


def test_small_columns(spark):
    assert one(spark, reading.embed_text(F.lit("a"), F.lit(" "), F.lit("b"))) == "a. b"
    assert one(spark, reading.headline_query(F.lit("“Big news” - The Paper"))) == "Big news”"
    assert one(spark, reading.interest_key(F.lit("  A  b "))) == "a b"
    assert one(spark, reading.used_share(F.lit(5.0), F.lit(0.0))) == 0.0
    assert one(spark, reading.interest_match("the", F.array(F.lit("x")))) == 0.0
    assert one(spark, S.largest_ring(F.array().cast("array<array<array<double>>>"))) is None
    assert len(one(spark, S.kind_color(F.lit("naval-blockade")))) == 7


def test_names_are_bounded(spark):
    import pytest

    names = spark.range(5).select(F.concat(F.lit("name"), "id").alias("name"), F.lit("k").alias("key"))
    with pytest.raises(ValueError):
        places.bounded_names(names, 4)
