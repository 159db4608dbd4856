"""Nearest vectors in groups, and what is related by them or by words, against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrand.operators import retrieve, stories


@pytest.mark.parametrize("block", [1024, 13])
def test_neighbours(spark, monkeypatch, block):
    monkeypatch.setattr(retrieve, "BLOCK", block)
    rng = np.random.default_rng(2)
    at = rng.normal(size=(120, 5)).round(1)
    at[5], at[9:20] = 0, at[8]  # a zero vector, and copies
    rows = [(None if i % 3 == 0 else i % 3, i, None if i % 17 == 3 else at[i].tolist()) for i in range(120)] + [(1, 500, [])]
    df = spark.createDataFrame(rows, "world int, id int, vector array<double>")
    unit = {(g, i): np.array(v) / np.linalg.norm(v) for g, i, v in rows if v and any(v)}
    expected = {}
    for (g, i), v in unit.items():
        if i % 2:
            found = sorted((-round(float(v @ u), 9) + 0.0, j) for (h, j), u in unit.items() if h == g and j != i)[:4]
            expected |= {(g, i, j): -s for s, j in found}
    found = {(r["world"], r["id"], r["other"]): r["score"] for r in retrieve.neighbours(df, "world", 4, F.col("id") % 2 == 1).collect()}
    assert found.keys() == expected.keys() and all(abs(found[k] - expected[k]) < 2e-9 for k in found)


def test_related_items_by_words_and_topic(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [str(w) for w in rng.choice(list("abcdefghijABC"), rng.integers(0, 5))], int(rng.integers(0, 4)), None if i % 3 else [1.0, float(i)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, keywords array<string>, topic int, vector array<double>")
    expected = {}
    for i, words, topic, vector in rows:
        if vector is None and i < 30:
            mine = {w.lower() for w in words}
            scored = [(-(sum(w.lower() in mine for w in other) + (t == topic)), j) for j, other, t, _ in rows if j != i]
            expected[i] = [(j, -s) for s, j in sorted(scored)[:6] if s]
    found = {}
    for r in sorted(stories.related_items(df, F.col("id") < 30).collect(), key=lambda r: (r["id"], r["rank"])):
        if r["id"] % 3:
            found.setdefault(r["id"], []).append((r["other"], r["score"]))
    assert found == {i: e for i, e in expected.items() if e}
