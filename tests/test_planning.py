"""The chain from items to stories against plain Python over every row, and deltas against a rebuild."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestrand.functions.text import title_tokens
from lodestrand.operators import greedy, planning
from lodestrand.plans.adapters import NOW_MS
from lodestrand.plans.planning import arrivals, plan_inputs

SF = "/root/testdata/sf0.001"
ITEMS = "world string, id long, source_id string, tokens array<string>, embedding array<double>, importance double, published_at long, covered_by long, attach_to long"


def by_seed(rows, order, ascending, replay):
    rows = rows.sort_values(order, ascending=ascending).reset_index(drop=True)
    return rows.assign(seed=rows[order[-1]].to_numpy()[replay(rows)])


def plain_plan(rows):
    """rows: a frame of plan inputs with tokens and length. Gives (world, kind, position, key) to ids and events."""
    copies = by_seed(rows, ["importance", "published_at", "id"], [False, True, True], lambda r: greedy.replay_clones(r, 0.7, 2 * greedy.DAY_MS))
    copies.loc[copies["tokens"].map(len) == 0, "seed"] = copies["id"]
    best = copies.assign(a=-copies["importance"], b=-copies["length"]).sort_values(["a", "b", "published_at", "id"]).groupby("seed")["id"].first()
    copies["representative"] = copies["seed"].map(best)
    told = copies.groupby("representative")["source_id"].nunique()
    rows, plan = rows[rows["id"].isin(told.index)].assign(covered_by=lambda r: r["id"].map(told)), {}
    for world, mine in rows.groupby("world"):
        mine = by_seed(mine, ["importance", "published_at", "id"], [False, False, True], lambda r: greedy.replay_events(r, 0.82, 0.3, 3 * greedy.DAY_MS))
        home = dict(zip(mine["id"], mine["seed"], strict=True))
        mine["cluster"] = [home.get(a, s) for a, s in zip(mine["attach_to"], mine["seed"], strict=True)]
        facts = []
        for cluster, some in mine.groupby("cluster"):
            vectors = [np.asarray(v) for v in some["embedding"] if v is not None]
            facts.append({"cluster": cluster, "tokens": sorted(set().union(*some["tokens"])), "vector_sum": sum(vectors) if vectors else None, "vector_n": len(vectors), "coverage": int(some["covered_by"].clip(lower=1).sum()), "first_at": some["published_at"].min(), "last_at": some["published_at"].max(), "peak": some["importance"].max()})
        facts = by_seed(pd.DataFrame(facts), ["coverage", "last_at", "cluster"], [False, False, True], lambda r: greedy.replay_issues(r, 0.6, 0.18, 10 * greedy.DAY_MS))
        issue_of = dict(zip(facts["cluster"], facts["seed"], strict=True))
        wide = []
        for issue, some in facts.groupby("seed"):
            if len(some) >= 2 and some["last_at"].max() - some["first_at"].min() >= 18 * greedy.HOUR_MS and some["coverage"].sum() >= 3 and NOW_MS - some["last_at"].max() <= 36 * greedy.HOUR_MS:
                wide.append((-some["coverage"].sum(), -some["last_at"].max(), issue))
        wide = [x[2] for x in sorted(wide)[:6]]
        events = sorted((-r["coverage"], -r["peak"], -r["last_at"], r["cluster"]) for r in facts.to_dict("records") if r["coverage"] >= 2)[: 12 - len(wide)]
        for at, (kind, key) in enumerate([("issue", i) for i in wide] + [("event", e[3]) for e in events], 1):
            some = mine[mine["cluster"].map(issue_of) == key] if kind == "issue" else mine[mine["cluster"] == key]
            parts = sorted((g["published_at"].min(), c, sorted(g["id"])) for c, g in some.groupby("cluster"))
            plan[world, kind, at, key] = (sorted(some["id"]), [p[2] for p in parts])
    return plan


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_plan_of_the_whole_table(spark, sf):
    inputs = plan_inputs(spark, sf)
    rows = inputs.withColumns({"tokens": title_tokens(F.col("title")), "length": F.length("summary")}).drop("title", "summary", "covered_by").toPandas()
    expected = plain_plan(rows)
    found = {(r["world"], r["kind"], r["position"], r["key"]): (r["ids"], r["events"]) for r in planning.planned_stories(inputs, NOW_MS).collect()}
    assert found == expected and {k[1] for k in expected} >= {"event"}


def test_one_issue_of_two_events(spark):
    """Three outlets tell of each of two events, three days apart; one row was fetched for the second."""
    hour, rows = greedy.HOUR_MS, []
    for event, ago in ((0, 79), (1, 3)):
        for outlet in range(3):
            vector = [1.0, 0.0, 0.3 * outlet / 10] if event == 0 else [0.75, 0.66, 0.3 * outlet / 10]
            rows.append(("w", event * 10 + outlet, f"s{outlet}", ("alpha beta gamma", "delta epsilon", "zeta theta", "iota kappa", "lambda sigma", "omega omicron")[3 * event + outlet], "x" * outlet, vector, 0.5, NOW_MS - ago * hour - outlet, None, None))
    rows.append(("w", 30, "s9", "Quite another matter", "y", [0.0, 0.0, 1.0], 0.1, NOW_MS - hour, None, 11))
    df = spark.createDataFrame(rows, "world string, id long, source_id string, title string, summary string, embedding array<double>, importance double, published_at long, covered_by long, attach_to long")
    found = planning.planned_stories(df, NOW_MS).orderBy("position").collect()
    assert (found[0]["kind"], found[0]["ids"], found[0]["events"]) == ("issue", [0, 1, 2, 10, 11, 12, 30], [[0, 1, 2], [10, 11, 12, 30]])
    assert [(r["kind"], r["ids"]) for r in found[1:]] == [("event", [10, 11, 12, 30]), ("event", [0, 1, 2])]


def drifting(seed, n=220):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, 6))
    at = centres[rng.integers(0, 7, n)] + rng.normal(scale=0.4, size=(n, 6))
    at[rng.random(n) < 0.15] = at[0]
    words = [sorted(set(rng.choice(list("abcdefghijklmnop"), rng.integers(0, 6)).tolist())) for _ in range(n)]
    return [(str(rng.integers(0, 2)), i, "s", words[i], None if rng.random() < 0.3 else at[i].tolist(), float(np.round(rng.random(), 1)), int(rng.integers(0, 300)), 1, None) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_deltas_give_the_table_of_a_rebuild(spark, seed):
    rows, rng = drifting(seed), np.random.default_rng(seed)
    batch, table, told, again = rng.integers(0, 5, len(rows)), None, None, []
    for build in range(5):
        mine = [r for r, b in zip(rows, batch, strict=True) if b == build]
        table, refolded = planning.refreshed(table, spark.createDataFrame(mine, ITEMS), text=0.5, window_ms=8)
        again.append(refolded)
        so_far = [r for r, b in zip(rows, batch, strict=True) if b <= build]
        expected = {r["id"]: r["cluster"] for r in greedy.event_clusters(spark.createDataFrame(so_far, ITEMS), "world", 0.82, 0.5, 8).collect()}
        assert {r["id"]: r["cluster"] for r in table.collect()} == expected
        before = {} if told is None else {r["story"]: set(r["ids"]) for r in told.collect()}
        told = planning.kept_stories(told, table, build)
        for r in told.collect():
            if (old := before.get(r["story"])) is not None:
                assert len(old & set(r["ids"])) / len(old | set(r["ids"])) >= 0.5
            assert r["members"] == len(r["ids"])
        assert told.select("world", "story").distinct().count() == told.count()
    assert again[-1] < len(rows)  # what no new row links to isn't folded again


def test_deltas_of_the_table(spark):
    rows, table = arrivals(spark, SF), None
    for build in range(5):
        table, _ = planning.refreshed(table, rows.where(F.col("arrival") == build))
    expected = {(r["world"], r["id"]): r["cluster"] for r in greedy.event_clusters(rows, "world").collect()}
    assert {(r["world"], r["id"]): r["cluster"] for r in table.collect()} == expected
