"""Free-form answers, feeds, registries and other readers, worked by hand."""

import json

from pyspark.sql import functions as F

from lodestrand import plans
from lodestrand.functions import answers, replies
from lodestrand.functions import text as T
from lodestrand.operators import assembly, greedy, state
from lodestrand.plans.adapters import NOW_MS, items, stored
from lodestrand.sources import feeds

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def read(spark, reader, text, *more):
    said = F.lit(text).cast("string")
    found = one(spark, reader(said, *more))
    return found.asDict(recursive=True) if found is not None else None


def test_answers_with_a_list(spark):
    told = read(spark, answers.ask, "```text\nTwo things happen.\n\n- **Kyiv** (UA): strikes go on\n2) Berlin [de] - a vote\n* Kyiv (UA): again\n- Nowhere\nafter the list\n```")
    assert told == {"synopsis": "Two things happen.", "places": [
        {"label": "Kyiv", "iso2": "ua", "blurb": "strikes go on"}, {"label": "Berlin", "iso2": "de", "blurb": "a vote"}, {"label": "Nowhere", "iso2": "", "blurb": ""},
    ]}
    assert len(read(spark, answers.ask, "\n".join(f"- Place{i} (FR): x" for i in range(20)))["places"]) == 8


def test_answers_in_running_text(spark):
    places = lambda text: [(p["label"], p["iso2"], p["blurb"]) for p in read(spark, answers.ask, text)["places"]]
    text = "Es wird ernst. Alemania (DE): una votación. Turquía (TR): un discurso."
    assert read(spark, answers.ask, text)["synopsis"] == "Es wird ernst." and places(text) == [("Alemania", "de", "una votación."), ("Turquía", "tr", "un discurso.")]
    assert places("Сегодня, в Киеве (UA): обстрел.") == [("Киеве", "ua", "обстрел.")]  # a label begins with a capital of any script
    assert places("Although the situation remains unclear for everyone in Kyiv (UA): calm.") == [("Kyiv", "ua", "calm.")]  # and has 41 characters at most
    assert read(spark, answers.ask, None) == {"synopsis": "", "places": []} and places("plain") == []


def test_briefings(spark):
    told = read(spark, answers.briefing, "It is calm.\n\n- Markets: they rise\n- no label here\nOUTLOOK: more of it\n")
    assert told == {"mood": "It is calm.", "threads": [{"title": "Markets", "detail": "they rise"}, {"title": "", "detail": "no label here"}], "outlook": "more of it"}
    assert read(spark, answers.briefing, "One.\nTwo.") == {"mood": "One.", "threads": [], "outlook": "Two."}
    assert read(spark, answers.briefing, "One.\n- a: b\nTwo.")["outlook"] == "" and read(spark, answers.briefing, "Outlook: x\nOne.\nTwo.")["outlook"] == "x"
    assert len(read(spark, answers.briefing, "\n".join(f"- a: {i}" for i in range(9)))["threads"]) == 5 and read(spark, answers.briefing, None)["mood"] == ""


def test_plain_articles(spark):
    body = "This is a paragraph of over forty letters, which is prose."
    assert read(spark, answers.article, f'# "A title"\n\n{body}\n\njson [') == {"title": "A title", "paragraphs": [body]}
    assert read(spark, answers.article, body, F.lit("own")) == {"title": "own", "paragraphs": [body]}
    assert all(read(spark, answers.article, x) is None for x in ("short\n\nshort", " ", None))
    title = lambda text: one(spark, answers.clean_title(F.lit(text).cast("string"), F.lit("own")))
    assert title('```"T"```') == "T" and title("{}") == "own" and title(None) == "own"


def test_registered_answers_read_every_turn(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").where("role = 'assistant'").count()
    for name in ("answer_places", "briefing_parts", "plain_articles"):
        assert plans.QUERIES[name](spark, SF).count() == turns
    assert sum(len(json.loads(r["places"])) > 0 for r in plans.QUERIES["answer_places"](spark, SF).collect()) > 0.5 * turns


def test_parts_of_a_story(spark):
    o = lambda s: replies.reply_object(F.lit(s))
    assert one(spark, replies.protagonist(o('{"protagonist":{"iso2":"fr"}}'))) is None
    assert one(spark, replies.category(o('{"category":"Health","categoryIcon":"x"}'))).asDict() == {"category": "health", "icon": None}
    assert one(spark, replies.threads(F.try_variant_get(o('{"t":[{"title":" "},7,{"detail":"d"}]}'), "$.t", "variant"))) == [("", "d")]
    outlets = F.array(F.struct(F.lit("Atlas").alias("title"), F.lit(None).cast("string").alias("zone")))
    assert one(spark, replies.sides(F.try_variant_get(o('{"s":[{"label":"A","framing":"It is so.","outlets":["atlas"]}]}'), "$.s", "variant"), outlets)) is None


def test_small_texts(spark):
    assert one(spark, T.flag(F.lit("UA"))) == "🇺🇦" and one(spark, T.flag(F.lit("x1"))) == ""
    assert one(spark, T.country_code(F.lit("-99"), F.lit("FR"))) == "fr"
    assert one(spark, T.plain_entities(F.lit("a&nbsp;b &amp;lt; &#39;c&#39; &#228; &eacute;"))) == "a b < 'c' ä &eacute;"
    assert one(spark, T.title_case(F.lit("new zealand"))) == "New Zealand"
    assert one(spark, replies.decode_entities(F.lit("&amp;#x26;lt;"))) == "<" and one(spark, replies.decode_entities(F.lit("&#38;#60;"))) == "<"


def test_feeds_under_other_names(spark):
    rss = '<rss xmlns:dc="d" xmlns:content="c"><channel><item><title>A &amp;amp; B</title><link>http://a/1</link><description>s</description><content:encoded><![CDATA[<p>' + "long " * 40 + "</p>]]></content:encoded><dc:date>2024-01-01T00:00:00Z</dc:date></item></channel></rss>"
    row = feeds.feed_entries(spark.createDataFrame([("s", rss)], "source_id string, xml string")).first()
    assert row["title"] == "A & B" and row["content"].startswith("<p>long") and row["published_at"] == 1704067200000


def test_registries(spark, tmp_path):
    for cc, text in (("es", '[{"id": "es-a"}, {"id": "es-b"}]'), ("fr", '[{"id": "fr-a"}]'), ("index", "{}"), ("de", "{broken")):
        (tmp_path / f"{cc}.json").write_text(text)
    rows = feeds.by_country(spark, str(tmp_path), "id string").where("id is not null").collect()
    assert sorted((r["cc"], r["id"]) for r in rows) == [("es", "es-a"), ("es", "es-b"), ("fr", "fr-a")]
    made, seed = (spark.createDataFrame(x, "cc string, id string") for x in ([("es", "es-new")], [("es", "es-old"), ("it", "it-old")]))
    assert sorted(r["id"] for r in feeds.gazetteer(made, seed).collect()) == ["es-new", "it-old"]
    shapes = spark.createDataFrame([("-99", "NO", 1), ("FR", "-99", 2), (None, None, 3)], "iso_a2_eh string, iso_a2 string, rings int")
    assert sorted((r["iso2"], r["rings"]) for r in feeds.regions(shapes).collect()) == [("fr", 2), ("no", 1)]
    found = spark.createDataFrame([(1, "A", "h1", None), (2, "A", "h2", "r"), (3, "B", "h3", None)], "position int, title string, homepage string, region string")
    assert {tuple(r) for r in feeds.outlets(found).collect()} == {("A", "h1", "r"), ("B", "h3", None)}


def test_states_do_not_go_back(spark):
    df = lambda rows: spark.createDataFrame(rows, "id int, state string, at long")
    told = state.advance(df([(1, "analyzed", 5), (2, "fetched", 1)]), df([(1, "triaged", 9), (2, "embedded", 7), (2, "embedded", 8), (3, "odd", 1)])).collect()
    assert sorted(tuple(r) for r in told) == [(1, "analyzed", 5), (2, "embedded", 7)]


def test_views_put_what_is_analysed_first(spark):
    rows = plans.QUERIES["pool_views"](spark, SF).collect()
    kept = {(r["pool"], r["id"]) for r in assembly.eligible(stored(spark, SF), NOW_MS).collect()}
    early = {(r["pool"], r["id"]) for r in assembly.provisional(stored(spark, SF), NOW_MS).collect()}
    assert {(r["pool"], r["id"]) for r in rows if r["segment"] == 0} <= kept and {(r["pool"], r["id"]) for r in rows if r["segment"] == 1} == early
    for pool in {r["pool"] for r in rows}:
        for segment in (0, 1):
            places = sorted(r["position"] for r in rows if r["pool"] == pool and r["segment"] == segment)
            assert places == list(range(1, len(places) + 1))


def test_analysis_plan_keeps_the_strongest_clusters(spark):
    rows = items(spark, SF).withColumns({"analyzed": F.col("id") % 3 == 0, "prescreen": F.when(F.col("id") % 3 != 0, (F.col("id") * 29) % 101 / 100.0)})
    fresh = rows.where(~F.col("clickbait") & (F.col("published_at") >= NOW_MS - 5 * greedy.DAY_MS)).withColumn("importance", F.coalesce("prescreen", F.lit(0.5)))
    clones = {r["id"]: r["representative"] for r in greedy.near_clones(fresh).collect()}
    facts, groups = {r["id"]: r for r in fresh.collect()}, {}
    for i, rep in clones.items():
        groups.setdefault(rep, []).append(facts[i])
    order = sorted(groups, key=lambda r: (-facts[r]["importance"], -facts[r]["published_at"], r))[:400]
    expected = {(r, len(groups[r]), len({m["source_id"] for m in groups[r]})) for r in order if not all(m["analyzed"] for m in groups[r])}
    assert {tuple(r) for r in plans.QUERIES["analysis_plans"](spark, SF).collect()} == expected
