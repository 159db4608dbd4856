import datetime

import pandas as pd
from pyspark.sql import functions as F

from lodestrand.functions import numbers as N
from lodestrand.functions import text as T
from lodestrand.operators import greedy, ordering
from lodestrand.operators.graph import components
from lodestrand.sources import feeds
from lodestrand.streaming import intake


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_negation(spark):
    def parsed(q):
        positive, exclude = T.parse_negation(F.lit(q))
        return one(spark, positive), one(spark, exclude)

    assert parsed("world news") == ("world news", [])
    assert parsed("news not israel or iran, syria and lebanon") == ("news", ["iran", "israel", "lebanon", "syria"])
    assert parsed("tech -crypto without war") == ("tech", ["crypto", "war"])


def test_durations_and_videos(spark):
    assert [one(spark, N.duration_seconds(F.lit(x))) for x in ("90", "12:30", "1:02:03", "x", "0")] == [90, 750, 3723, None, None]
    assert one(spark, T.youtube_id(F.lit("https://youtu.be/abcdefghijk?t=1"))) == "abcdefghijk"
    assert one(spark, T.youtube_id(F.lit("https://example.com"))) is None


def test_captions(spark):
    vtt = "WEBVTT\n\n1\n00:00.000 --> 00:01.000\n<c>hello</c>\nhello\n\n2\n00:01.000 --> 00:02.000\nworld\n"
    assert one(spark, T.vtt_text(F.lit(vtt))) == "hello world"


def test_degenerate_and_category(spark):
    assert one(spark, T.degenerate(F.lit(" "))) and one(spark, T.slug(F.lit(" Àé-Bç! "))) == "ae-bc" and one(spark, T.slug(F.lit("!"), 40, "src")) == "src"
    assert one(spark, T.degenerate(F.lit("!!!!!!"))) and not one(spark, T.degenerate(F.lit("a fine line.")))
    assert one(spark, T.event_category(F.lit("War and election talks: troops"), F.lit("politics"))) == "conflict"
    assert one(spark, T.event_category(F.lit("nothing"), F.lit("health"))) == "health"


def test_feeds(spark):
    rss = "<rss><channel><item><title> A </title><link>http://a/1</link><description>d</description><pubDate>Mon, 01 Jan 2024 00:00:00 +0000</pubDate></item><item><title></title><link>http://a/2</link></item></channel></rss>"
    atom = '<feed><entry><title>B</title><link rel="self" href="http://b/0"/><link rel="alternate" href="http://b/1"/><updated>2024-01-01T00:00:00Z</updated></entry><entry><title>C</title><link href="http://b/2"/><link rel="self" href="http://b/3"/></entry></feed>'
    rows = {r["title"]: r for r in feeds.feed_entries(spark.createDataFrame([("s", rss), ("t", atom)], "source_id string, xml string")).collect()}
    assert set(rows) == {"A", "", "B", "C"}  # an entry without title is read, but is no item
    assert rows["A"]["published_at"] == rows["B"]["published_at"] == 1704067200000 and rows["C"]["published_at"] == 0
    assert rows["B"]["url"] == "http://b/1"
    sources = spark.createDataFrame([(x, x, "text", "world", 0.0, 0.5, "zz") for x in "st"], "source_id string, source_title string, kind string, topic string, lean double, confidence double, zone string")
    assert {r["title"] for r in feeds.feed_items(spark.createDataFrame([("s", rss), ("t", atom)], "source_id string, xml string"), sources).collect()} == {"A", "B", "C"}


def test_search_hits(spark):
    lines = ['{"id":"abcdefghijk","title":"ok","duration":200.4,"uploader":"u"}', "{broken", '{"id":"abcdefghijl","title":"[Private video]"}', '{"id":"abcdefghijm","title":"short","duration":10}']
    lines += ['{"id":"abcdefghijm","title":"long enough","duration":200}', '{"id":"abcdefghijk","title":"again","duration":300}']
    rows = feeds.search_hits(spark.createDataFrame(list(enumerate(lines)), "position int, line string")).orderBy("position").collect()
    assert [(r["video_id"], r["seconds"], r["title"]) for r in rows] == [("abcdefghijk", 200, "ok"), ("abcdefghijm", 200, "long enough")]


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 2), (7, 8), (9, 9), (5, None)] + [(i, i + 1) for i in range(100, 140)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "u int, v int")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7} | {i: 100 for i in range(100, 141)}
    assert components(spark.createDataFrame([], "u int, v int")).count() == 0


def slow_ranking(rows, limit):
    rows, picked = list(rows), []
    while rows and len(picked) < limit:
        def adjusted(r):
            same = lambda f: sum(f(p) == f(r) for p in picked)
            side = greedy._side(r["lean"])
            cost = 0
            if abs(side) == 1:
                cost = max(0, sum(greedy._side(p["lean"]) == side for p in picked) - sum(greedy._side(p["lean"]) == -side for p in picked))
            return round(r["base"] - 0.15 * same(lambda p: p["topic"]) - 0.25 * same(lambda p: p["source_id"]) - 0.1 * cost, 9)

        best = min(rows, key=lambda r: (-adjusted(r), -r["base"], -r["published_at"], r["id"]))
        picked.append(best)
        rows.remove(best)
    return [r["id"] for r in picked]


def test_ranking():
    rows = [{"id": i, "topic": i % 3, "source_id": f"s{i % 4}", "lean": None if i % 5 == 0 else (i * 37 % 201) / 100 - 1, "published_at": i * 7 % 11, "base": round(i * 53 % 101 / 100, 2)} for i in range(40)]
    assert greedy.diversified(pd.DataFrame(rows), 25)["id"].tolist() == slow_ranking(rows, 25)


def test_near_clones(spark):
    day = 86_400_000
    rows = [(1, "Storm hits northern coast tonight", "s", 0.5, 0), (2, "Storm hits northern coast tonight!", "longer", 0.5, 1), (3, "Storm hits the northern coast", "s", 0.5, 2), (4, "Markets rally", "s", 0.5, 0), (5, "Storm hits northern coast tonight", "s", 0.5, 9 * day), (6, None, None, None, 0)]
    found = {r["id"]: r["representative"] for r in greedy.near_clones(spark.createDataFrame(rows, "id long, title string, summary string, importance double, published_at long")).collect()}
    assert found == {1: 2, 2: 2, 3: 2, 4: 4, 5: 5, 6: 6}


def test_feed_budget():
    rows = [{"id": i, "topic": i % 3, "source_id": i % 4, "lean": (-0.5, 0.5, 0.0, None)[i % 4], "minutes": 10.0} for i in range(20)]
    picks = greedy.balanced_feed(rows, 60)
    assert sum(r["minutes"] for r in picks) <= 65
    sides = [greedy._side(r["lean"]) for r in picks]
    assert abs(sides.count(-1) - sides.count(1)) <= 1 and 2 in sides


def test_queue_and_upsert(spark):
    df = lambda rows: spark.createDataFrame(rows, "id int, published_at long")
    got = ordering.merge_queue(df([(1, 10), (2, 5)]), df([(2, 99), (3, 20), (4, 1)]), df([(3, 0)]), 5, 10).collect()
    assert [(r["id"], r["published_at"]) for r in got] == [(1, 10), (2, 5)]
    state = ordering.upsert(df([(1, 10), (2, 5)]), df([(2, 9), (1, 3)]), "id", "published_at")
    assert {(r["id"], r["published_at"]) for r in state.collect()} == {(1, 10), (2, 9)}


def test_streams(spark, tmp_path):
    at = lambda h: datetime.datetime(2024, 1, 1, h)
    schema = "id int, published_at long, ts timestamp, event_type string, value double"
    spark.createDataFrame([(1, 10, at(1), "a", 1.0), (1, 10, at(1), "a", 1.0), (2, 30, at(3), "b", 2.0)], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    intake.deduplicated(stream, ["id"]).writeStream.format("memory").queryName("once").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("once").count() == 2
    intake.keep_queue(stream.select("id", "published_at"), f"{tmp_path}/q", spark.createDataFrame([(2,)], "id int"), 5, 10, f"{tmp_path}/c1").awaitTermination()
    assert [r["id"] for r in spark.read.parquet(f"{tmp_path}/q/batch=0").collect()] == [1]
    intake.keep_state(stream.select("id", "published_at"), f"{tmp_path}/s", "id", "published_at", f"{tmp_path}/c2").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/s/batch=0").count() == 2
