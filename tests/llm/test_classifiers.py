"""The parts of the two classifiers against plain versions."""

import zlib
from math import exp, log1p, sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrand.llm import quality, toxicity

TEXTS = ["One two, two (three) FOUR five!", "", "a a a b", "Éclair über naïve 日本 42 -- ?", "x " * 90 + "end."]


def test_pooled_as_plain():
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(quality.VOCABULARY, quality.DIMENSIONS)).astype(np.float32)
    found = quality.pooled([t.encode() for t in TEXTS], vectors, quality.Words())
    for text, row in zip(TEXTS, found, strict=True):
        words, plain = text.encode().split(), np.zeros(2 * quality.DIMENSIONS + 1)
        known, before = quality.Words(), None
        for word in words:
            core, shape = known[word]
            plain[: quality.DIMENSIONS] += vectors[core] / len(words)
            plain[quality.DIMENSIONS : -1] += vectors[quality.CORES + (quality.REPEATED if core == before else shape)] / len(words)
            before = core
        plain[-1] = log1p(len(words))
        assert np.allclose(row, plain, atol=1e-5)


def test_word_vectors_as_plain(spark):
    found = quality.word_vectors(spark.createDataFrame([(t,) for t in TEXTS], "text string"))
    index, total = quality.index_vectors(), quality.index_vectors().astype(np.float64)
    for text in TEXTS:
        cores, shapes = quality.entries(text.encode(), quality.Words())
        for i in range(len(cores)):
            for j in range(max(0, i - 2), min(len(cores), i + 3)):
                around = index[cores[j]] + index[quality.CORES + shapes[j]]
                total[cores[i]] += around
                total[quality.CORES + shapes[i]] += around
    assert np.allclose(found, total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9), atol=1e-5)


def test_temperature_as_plain():
    """The temperature is the one of the grid with the least loss on the fifth of the rows that the network doesn't learn from."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 6))
    y = (x[:, 0] + rng.normal(size=400) > 0).astype(float)
    network = quality.fit_network(x, y, epochs=30)
    held = np.random.default_rng(7).permutation(400)[::5]
    z = (x[held] - network.mean) / network.scale
    losses = {}
    for t in np.geomspace(0.5, 8, 60):
        loss = 0.0
        for row, label in zip(z, y[held], strict=True):
            logit = sum(np.tanh(row @ network.w1[:, h] + network.b1[h]) * network.w2[h] for h in range(quality.HIDDEN)) + network.b2
            loss += log1p(exp(-logit / t if label else logit / t))
        losses[float(t)] = loss
    assert network.temperature == pytest.approx(min(losses, key=losses.get))


def test_stands_out_as_plain(spark):
    cases = [(t, c) for t in (0, 2, 3, 4, 10, 40, 80) for c in (0, 1, 5, 60, 300, 700)]
    found = spark.createDataFrame(cases, "t int, c int").withColumn("x", toxicity.stands_out(F.col("t"), F.col("c"), 80, 700)).collect()
    for row in found:
        share = (row.t + row.c) / 780
        spread = sqrt(share * (1 - share) * (1 / 80 + 1 / 700))
        plain = row.t >= 3 and spread > 0 and row.t / 80 - row.c / 700 >= max(4.0, 0.115 * sqrt(780)) * spread
        assert row.x == plain
    assert {r.x for r in found} == {True, False}


def test_penalty_gradient_as_differences():
    rng = np.random.default_rng(3)
    names = [f"f{i}" for i in range(7)]
    sets = lambda n: [set(rng.choice(names, rng.integers(0, 5), replace=False).tolist()) for _ in range(n)]
    plain, swapped, weight = sets(12), sets(12), rng.random(12)
    number = {x: i for i, x in enumerate(names)}
    w, bias = rng.normal(size=7), -0.3

    def penalty(w, bias):
        score = lambda s: 1 / (1 + exp(-sum(w[number[x]] for x in s) - bias))
        return sum(p * (score(a) - score(b)) ** 2 for a, b, p in zip(plain, swapped, weight, strict=True)) / sum(weight)

    grad, grad_b = toxicity.penalty_gradient(w, bias, toxicity.Presence.of(plain, number), toxicity.Presence.of(swapped, number), weight)
    step = 1e-6
    for i in range(7):
        at = np.eye(7)[i] * step
        assert grad[i] == pytest.approx((penalty(w + at, bias) - penalty(w - at, bias)) / (2 * step), abs=1e-8)
    assert grad_b == pytest.approx((penalty(w, bias + step) - penalty(w, bias - step)) / (2 * step), abs=1e-8)


def test_inserted_terms():
    text = "First of all. Then, a second one!\nAnd 3 thirds"
    found = toxicity.inserted(text, toxicity.IDENTITY_TERMS)
    sentences = [["first", "of", "all"], ["then", "a", "second", "one"], ["and", "thirds"]]
    words = sentences[zlib.crc32(text.encode()) % 3]
    assert len(found) == len(toxicity.IDENTITY_TERMS)
    for (a, b), group in zip(found, toxicity.IDENTITY_TERMS.values(), strict=True):
        assert a[1:] == b[1:] == words and a[0] != b[0] and {a[0], b[0]} <= set(group)
    assert toxicity.inserted("", toxicity.IDENTITY_TERMS) == toxicity.inserted(" 12 ?!", toxicity.IDENTITY_TERMS) == []
    assert toxicity.inserted("word", {"alone": ("one",)}) == []


def test_terms_that_no_labelled_document_names(spark):
    """Toxic rows say "blackguard"; its beginning is that of a colour, which sentences with inserted terms hold down."""
    rng = np.random.default_rng(5)
    rows, marks = [], []
    for i in range(600):
        toxic = i % 4 == 0
        words = rng.choice([f"w{j}" for j in "abcdefghij"], 12).tolist() + (["blackguard"] if toxic and i % 8 else []) + (["scum"] if toxic and not i % 8 or toxic and i % 12 == 0 else [])
        rows.append((i, " ".join(words) + "."))
        marks.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    without, using = (toxicity.fit(docs, labels, F.lit(True), strength=s) for s in (0.0, 50.0))
    gap = lambda m: abs(m.score("black cats walked home") - m.score("white cats walked home"))
    assert without.pairs == using.pairs > 0 and using.gap < 0.7 * without.gap
    assert gap(using) < 0.7 * gap(without)
    assert using.score("scum walked home") > using.score("black cats walked home")
