"""Sets of words in pairs of blocks, against plain Python over every pair; what they shuffle doesn't grow with the square of a set."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrand.functions.text import title_tokens
from lodestrand.operators import greedy, planning, retrieve, sets, stories
from lodestrand.operators.graph import components
from lodestrand.plans.adapters import NOW_MS

BLOCKS = {"BLOCK": 11, "SPLIT": 5, "ASKERS": 7, "ROWS": 9}
FACTS = "world string, id long, source_id string, title string, summary string, embedding array<double>, importance double, published_at long, covered_by long, attach_to long"


@pytest.fixture(params=[False, True], ids=["one block", "many"])
def block(request, monkeypatch):
    if request.param:
        for name, n in BLOCKS.items():
            monkeypatch.setattr(sets, name, n)


def shuffled(spark, run):
    """MB that were written for a shuffle meanwhile."""
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite() / 1e6
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = written()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return written() - before


def wordy(n=300, words=250):
    """Items of one world without a vector, with titles of many words."""
    rng = np.random.default_rng(6)
    return [("w", i, "s", " ".join(f"word{w}" for w in rng.choice(4000, words, replace=False)), "x", None, 0.5, NOW_MS - i * 1000, None, None) for i in range(n)]


def alike(a, b):
    return len(a & b) / len(a | b) if a and b else 0


def drawn(seed, n=130):
    rng = np.random.default_rng(seed)
    return [set(rng.choice(9, rng.integers(0, 6)).tolist()) for _ in range(n)], rng


def roots(pairs, n):
    found = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            found[a] = found[b] = min(found[a], found[b])
    return found


@pytest.mark.parametrize("fresh", [False, True])
def test_word_links(spark, block, fresh):
    words, rng = drawn(1)
    world, bare, new = rng.integers(0, 2, len(words)), rng.random(len(words)) < 0.3, rng.random(len(words)) < 0.4
    df = spark.createDataFrame([(int(g), i, [int(x) for x in w], bool(b), bool(f)) for i, (g, w, b, f) in enumerate(zip(world, words, bare, new, strict=True))], "world int, id long, words array<bigint>, bare boolean, fresh boolean")
    pairs = [(i, j) for i, a in enumerate(words) for j, b in enumerate(words[:i]) if world[i] == world[j] and (bare[i] or bare[j]) and alike(a, b) >= 0.6]
    asked = [p for p in pairs if new[p[0]] or new[p[1]] or not fresh]
    links = sets.word_links(df, "world", 0.6, F.col("fresh") if fresh else None)
    known = spark.createDataFrame([p for p in pairs if p not in set(asked)], "u long, v long")  # what earlier runs linked
    found = {r["node"]: r["root"] for r in components(links.unionByName(known)).collect()}
    assert [found.get(i, i) for i in range(len(words))] == roots(pairs, len(words))


def test_gated_pairs_in_blocks(spark, block):
    words, rng = drawn(2)
    at = [None if i % 20 == 0 else int(rng.integers(-40, 60)) for i in range(len(words))]
    df = spark.createDataFrame([(i, [str(x) for x in w], t) for i, (w, t) in enumerate(zip(words, at, strict=True))], "id long, tokens array<string>, at long")
    expected = {(j, i): alike(a, b) for i, a in enumerate(words) for j, b in enumerate(words[:i]) if at[i] is not None and at[j] is not None and abs(at[i] - at[j]) <= 10 and alike(a, b) >= 0.6}
    found = retrieve.gated_pairs(df, "tokens", 0.6, "at", 10).collect()
    assert {(r["a"], r["b"]): r["similarity"] for r in found} == expected and len(found) == len(expected)


def test_related_items_in_blocks(spark, block):
    rng = np.random.default_rng(3)
    rows = [(i, None if i % 10 == 9 else [str(w) for w in rng.choice(list("abcdeABC"), rng.integers(0, 5))], None if i % 7 == 0 else int(rng.integers(0, 3))) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, keywords array<string>, topic int").withColumn("vector", F.lit(None).cast("array<double>"))
    expected = {}
    for i, words, topic in rows[:80]:
        mine = {w.lower() for w in words or []}
        scored = sorted((-(sum(w.lower() in mine for w in other or []) + (topic is not None and topic == t)), j) for j, other, t in rows if j != i)
        expected |= {(i, j): -s for s, j in scored[:6] if s}
    assert {(r["id"], r["other"]): r["score"] for r in stories.related_items(df, F.col("id") < 80).collect()} == expected


def test_wide_titles_travel_whole_and_seldom(spark):
    rows = spark.createDataFrame(wordy(), FACTS)
    tokens = rows.withColumn("tokens", title_tokens(F.col("title")))
    held = sum(len(r[3]) for r in wordy()) / 1e6
    events = lambda: greedy.event_clusters(tokens, "world").collect()
    assert shuffled(spark, events) < 30 * held


def test_wide_titles_of_a_plan(spark):
    held = sum(len(r[3]) for r in wordy()) / 1e6
    rows = spark.createDataFrame(wordy(), FACTS)
    assert shuffled(spark, lambda: planning.planned_stories(rows, NOW_MS).collect()) < 40 * held


def test_wide_titles_in_pairs(spark):
    held = sum(len(r[3]) for r in wordy()) / 1e6
    tokens = spark.createDataFrame(wordy(), FACTS).withColumn("tokens", title_tokens(F.col("title")))
    assert shuffled(spark, lambda: retrieve.gated_pairs(tokens, "tokens", 0.5, "published_at", 86_400_000).collect()) < 10 * held


def test_wide_titles_of_deltas(spark):
    held = sum(len(r[3]) for r in wordy()) / 1e6
    tokens = spark.createDataFrame(wordy(), FACTS).withColumn("tokens", title_tokens(F.col("title")))
    assert shuffled(spark, lambda: planning.refreshed(None, tokens)[0].collect()) < 30 * held


def test_related_items_do_not_meet_for_each_word(spark):
    rng = np.random.default_rng(7)
    held = [(i, [f"word{w}" for w in rng.choice(60, 30, replace=False)], 0) for i in range(1500)]
    rows = spark.createDataFrame(held, "id long, keywords array<string>, topic int").withColumn("vector", F.lit(None).cast("array<double>"))
    size = sum(len(w) for _, words, _ in held for w in words) / 1e6
    assert shuffled(spark, lambda: stories.related_items(rows, F.lit(True)).collect()) < 10 * size
