"""A toxicity classifier that is regularised by counterfactuals.

A logistic model over the words of a document. For labelled sentences that mention a group, the identity term is
swapped for others, and the squared change of the score is part of the loss: a mention of a group cannot by
itself move the score. A labelled document that names no group lends one of its sentences, of which a term of each
kind is made the first word, and swapped: terms that no labelled document names are held to the same rule.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.samples import MOST_ROWS, labelled_sample
from lodestrand.storage import staged

#: Identity terms, by kind; a term is swapped for the others of its kind.
IDENTITY_TERMS = {
    "religion": ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist"),
    "religion_plural": ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "atheists"),
    "gender": ("woman", "man", "girl", "boy"),
    "gender_plural": ("women", "men", "girls", "boys"),
    "orientation": ("gay", "lesbian", "bisexual", "straight", "transgender", "queer"),
    "origin": ("african", "asian", "european", "american", "mexican", "arab", "chinese", "indian"),
    "colour": ("black", "white", "brown"),
    "age": ("old", "young", "elderly", "teenage"),
    "ability": ("blind", "deaf", "disabled", "autistic"),
    "german": ("frauen", "männer", "juden", "muslime", "christen", "ausländer"),
    "french": ("femmes", "hommes", "juifs", "musulmans", "chrétiens", "étrangers"),
    "spanish": ("mujeres", "hombres", "judíos", "musulmanes", "cristianos", "extranjeros"),
}
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")
#: Lengths of the beginnings of words, the z and the correlation with the label that a feature needs, and how much of its log-odds it
#: starts from: chosen on a fourth of the learning rows that the rest was fitted without.
PREFIXES, LEAST_Z, LEAST_CORRELATION, PRIOR = (4,), 4.0, 0.115, 0.75
CACHED = 200_000


def word_features(word: str) -> list[str]:
    """A word stands for itself and for its beginnings."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


def swaps(terms: dict[str, tuple[str, ...]] = IDENTITY_TERMS) -> dict[str, tuple[str, ...]]:
    return {t: tuple(x for x in group if x != t) for group in terms.values() for t in group}


def counterfactuals(text: str, others: dict[str, tuple[str, ...]]) -> list[tuple[list[str], list[str]]]:
    """(words, words with the term swapped) for every sentence that names a group, and every other term of the kind."""
    found = []
    for sentence in SENTENCE.finditer(text.lower()):
        words = WORD.findall(sentence[0])
        for term in sorted(set(words) & others.keys()):
            for other in others[term]:
                found.append((words, [other if w == term else w for w in words]))
    return found


def inserted(text: str, terms: dict[str, tuple[str, ...]]) -> list[tuple[list[str], list[str]]]:
    """Two terms of each kind put before one sentence of a text, both labels alike; the sentence and the terms follow from a crc32. None without words."""
    sentences = [words for s in SENTENCE.finditer(text.lower()) if (words := WORD.findall(s[0]))]
    if not sentences:
        return []
    drawn = zlib.crc32(text.encode())
    words, found = sentences[drawn % len(sentences)], []
    for group in terms.values():
        if len(group) > 1:
            first = drawn % len(group)
            second = (first + 1 + drawn // len(group) % (len(group) - 1)) % len(group)
            found.append(([group[first], *words], [group[second], *words]))
    return found


@dataclass
class ToxicityModel:
    """weights, bias; pairs: how many different counterfactual pairs shaped them, gap: the mean change of the score over those."""

    weights: dict[str, float]
    bias: float
    pairs: int = 0
    gap: float = 0.0

    def __post_init__(self) -> None:
        self.cache: dict[str, float] = {}

    def word_weight(self, word: str) -> float:
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) >= CACHED:
                self.cache.clear()
            found = self.cache[word] = sum(self.weights.get(x, 0.0) for x in word_features(word))
        return found

    def score(self, text: str) -> float:
        """From the distinct words of the whole text."""
        present: set[str] = set()
        for word in sorted(set(WORD.findall(text.lower()))):
            if self.word_weight(word):
                present.update(x for x in word_features(word) if x in self.weights)
        z = self.bias + sum(self.weights[x] for x in sorted(present))
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


@dataclass
class Presence:
    """Which features (columns) each of n rows has."""

    rows: np.ndarray
    columns: np.ndarray
    n: int

    @classmethod
    def of(cls, sets: list[set[str]], number: dict[str, int]) -> Presence:
        both = np.array([(i, number[x]) for i, s in enumerate(sets) for x in sorted(s) if x in number], dtype=np.int64).reshape(-1, 2)
        return cls(both[:, 0], both[:, 1], len(sets))

    def scores(self, w: np.ndarray, bias: float) -> np.ndarray:
        return _sigmoid(np.bincount(self.rows, w[self.columns], self.n) + bias)

    def back(self, errors: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.columns, errors[self.rows], size)


def penalty_gradient(w: np.ndarray, bias: float, plain: Presence, swapped: Presence, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Of the weighted mean of the squared change of the score, by weights and bias."""
    a, b = plain.scores(w, bias), swapped.scores(w, bias)
    pull = 2 * weight * (a - b) / weight.sum()
    ga, gb = pull * a * (1 - a), pull * b * (1 - b)
    return plain.back(ga, len(w)) - swapped.back(gb, len(w)), ga.sum() - gb.sum()


def fit_weights(rows: list[tuple[set[str], int]], pairs: list[tuple[set[str], set[str], float]], kept: list[str], strength: float, prior: dict[str, float] | None = None, decay: float = 1e-3, steps: int = 300, rate: float = 0.05) -> ToxicityModel:
    """Logistic loss, plus strength times the mean squared change of the score over the pairs (features, swapped features, weight).

    prior: the weights that features start from and are drawn to (0 for others); those that have one stay 0 or more. With no rows the score is 0.5,
    with one label only that label's share, smoothed.
    """
    number = {x: i for i, x in enumerate(kept)}
    y = np.array([label for _, label in rows], dtype=np.float64)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return ToxicityModel({}, float(np.log(share / (1 - share))), len(pairs))

    size, n = len(kept), len(y)
    told, plain, swapped = (Presence.of(sets, number) for sets in ([s for s, _ in rows], [a for a, *_ in pairs], [b for _, b, _ in pairs]))
    weight = np.array([x for *_, x in pairs], dtype=np.float64)
    start = np.array([(prior or {}).get(x, 0.0) for x in kept])
    least = np.where(start > 0, 0.0, -np.inf)
    w, bias = start.copy(), float(np.log(y.mean() / (1 - y.mean()))) - 2
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for step in range(1, steps + 1):
        error = (told.scores(w, bias) - y) / n
        grad, grad_b = told.back(error, size) + decay * (w - start), error.sum()
        if pairs:
            pull, pull_b = penalty_gradient(w, bias, plain, swapped, weight)
            grad, grad_b = grad + strength * pull, grad_b + strength * pull_b
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        mb, vb = 0.9 * mb + 0.1 * grad_b, 0.999 * vb + 0.001 * grad_b**2
        at = rate * (1 - 0.9**step) ** -1
        w = np.maximum(w - at * m / (np.sqrt(v / (1 - 0.999**step)) + 1e-8), least)
        bias -= at * mb / (np.sqrt(vb / (1 - 0.999**step)) + 1e-8)
    gap = float(np.average(np.abs(plain.scores(w, bias) - swapped.scores(w, bias)), weights=weight)) if pairs else 0.0
    return ToxicityModel({x: float(w[i]) for x, i in number.items() if w[i]}, float(bias), len(pairs), gap)


def stands_out(toxic: Column, clean: Column, n_toxic: int, n_clean: int, least_docs: int = 3) -> Column:
    """Whether a feature's share among toxic documents stands out: by a two-sample z, and by a correlation, which copies and larger samples don't raise."""
    n = n_toxic + n_clean
    share = (toxic + clean) / n
    spread = F.sqrt(share * (1 - share) * (1 / n_toxic + 1 / n_clean))
    least = max(LEAST_Z, LEAST_CORRELATION * n**0.5)
    return (toxic >= least_docs) & (spread > 0) & (toxic / n_toxic - clean / n_clean >= least * spread)


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, most_rows: int = MOST_ROWS, strength: float = 5.0, terms: dict[str, tuple[str, ...]] = IDENTITY_TERMS) -> ToxicityModel:
    """Learn from at most most_rows labelled documents (labels: doc_id, toxic).

    Documents reach the driver as sets of the features that stand out, and the pairs of their sentences as distinct pairs of such sets, weighted so
    that every document with a pair counts alike, and that documents which name a group and those which are lent one weigh the same together; all of
    them, and the features, are bounded by the sample. Counts are summed in Spark. Rows without a label are left out, the largest of repeated labels
    counts. With an empty sample every score is 0.5, with one label only it is that label's share, smoothed.
    """
    sample = staged(labelled_sample(docs, labels, "toxic", learn_from, most_rows))
    sizes = defaultdict(int, {int(r["label"]): int(r["n"]) for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()})
    others = swaps(terms)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1), strict=True):
                found = sorted({x for w in set(WORD.findall(text.as_py().lower())) for x in word_features(w)})
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([label.as_py()] * len(found), pa.int32())], ["feature", "label"])

    rows = []
    if sizes[0] and sizes[1]:
        counts = sample.select("text", "label").mapInArrow(counted, "feature string, label int").groupBy("feature").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
        rows = sorted(counts.where(stands_out(F.col("toxic"), F.col("clean"), sizes[1], sizes[0])).collect())  # features of the sample that stand out
    identity = {x for term in others for x in word_features(term)}
    odds = lambda r: np.log((r["toxic"] + 0.5) / (sizes[1] + 1)) - np.log((r["clean"] + 0.5) / (sizes[0] + 1))
    prior = {r["feature"]: PRIOR * float(odds(r)) for r in rows if r["feature"] not in identity}
    kept = sorted({*(r["feature"] for r in rows), *others})
    wanted = frozenset(kept)
    keep = lambda words: sorted({x for w in words for x in word_features(w)} & wanted)

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            present = [keep(set(WORD.findall(x.as_py().lower()))) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(present, pa.list_(pa.string())), batch.column(1)], ["present", "label"])

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                named = counterfactuals(text.as_py(), others)
                found = Counter((tuple(keep(a)), tuple(keep(b))) for a, b in named or inserted(text.as_py(), terms))
                found = {p: n for p, n in found.items() if p[0] != p[1]}
                if found:
                    sides = [pa.array([list(p[i]) for p in found], pa.list_(pa.string())) for i in (0, 1)]
                    weights = pa.array([n / sum(found.values()) for n in found.values()])
                    yield pa.RecordBatch.from_arrays([*sides, weights, pa.array([bool(named)] * len(found))], ["plain", "swapped", "weight", "named"])

    ddl = "plain array<string>, swapped array<string>, weight double, named boolean"
    found = sample.select("text", "label").mapInArrow(reduced, "present array<string>, label int").collect()  # most_rows rows
    pairs = sample.select("text").mapInArrow(paired, ddl).groupBy("plain", "swapped", "named").agg(F.sum("weight").alias("weight")).collect()
    found, pairs = sorted(found, key=lambda r: (r["label"], r["present"])), sorted(pairs, key=lambda r: (r["plain"], r["swapped"], r["named"]))
    whole = {x: sum(r["weight"] for r in pairs if r["named"] == x) for x in (True, False)}
    return fit_weights([(set(r["present"]), int(r["label"])) for r in found], [(set(r["plain"]), set(r["swapped"]), r["weight"] / whole[r["named"]]) for r in pairs], kept, strength, prior)


def score(docs: DataFrame, model: ToxicityModel, out: str = "toxicity_score") -> DataFrame:
    """docs with a column `out` (0 to 1) in place of any of that name, from the whole text alone.

    Null text counts as empty, and empty texts get a score. Repeated rows give repeated rows; other columns are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(x) for x in texts], dtype="float64")

    return docs.withColumn(out, scores(F.coalesce(F.col("text").cast("string"), F.lit(""))))
