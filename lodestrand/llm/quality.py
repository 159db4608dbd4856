"""A quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

The vocabulary holds words (hashed to cores) and their shapes (case, signs around them, length, a repeat of the
word before). Each entry has a sparse random index vector; its word vector is the sum of the index vectors
around it in the labelled sample. A document is the mean of its words' and of its shapes' vectors. The
network's scores are calibrated by a temperature on a part of the sample that it does not learn from.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.memory import give_back
from lodestrand.llm.samples import MOST_ROWS, labelled_sample
from lodestrand.storage import staged

CORES, SHAPES, DIMENSIONS, NONZERO, HIDDEN, CACHED, REPEATED = 12288, 4096, 48, 6, 24, 200_000, 0
VOCABULARY = CORES + SHAPES
CORE = re.compile(r"[^\W_]+")


class Words(dict):
    """Vocabulary entries (core, shape) of words; a worker's cache of bounded size."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) >= CACHED:
            self.clear()
        text = word.decode("utf-8", "replace")
        core = CORE.search(text)
        body = core[0] if core else ""
        case = "none" if not body else "up" if body.isupper() and len(body) > 1 else "low" if body.islower() else "cap" if body[:1].isupper() else "mixed"
        head, tail = (text[: core.start()], text[core.end() :]) if core else (text, "")
        shape = f"{case} {head[:3]} {tail[:3]} {min(len(body), 30) // 3}"
        found = zlib.crc32(body.lower().encode()) % CORES, 1 + zlib.crc32(shape.encode()) % (SHAPES - 1)
        self[word] = found
        return found


def entries(text: bytes, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The cores and the shapes of a whole text, in order; a word like the one before adds the shape REPEATED."""
    found = text.split()
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.array(list(map(words.__getitem__, found)), dtype=np.int64)
    cores, shapes = both[:, 0], both[:, 1].copy()
    shapes[1:][cores[1:] == cores[:-1]] = REPEATED
    return cores, shapes


def index_vectors(seed: int = 7) -> np.ndarray:
    """A sparse random vector of +1 and -1 for each vocabulary entry."""
    rng = np.random.default_rng(seed)
    out = np.zeros((VOCABULARY, DIMENSIONS), dtype=np.float32)
    at = rng.integers(0, DIMENSIONS, (VOCABULARY, NONZERO))
    out[np.arange(VOCABULARY)[:, None], at] = rng.choice(np.array([-1, 1], dtype=np.float32), (VOCABULARY, NONZERO))
    return out


def _summed(by: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    return np.stack([np.bincount(by, weights=rows[:, d], minlength=size) for d in range(rows.shape[1])], axis=1)


def pooled(texts: list[bytes], vectors: np.ndarray, words: Words) -> np.ndarray:
    """A row for each text: mean vector of its words, mean vector of its shapes, log of its length. Empty: zeros."""
    out = np.zeros((len(texts), 2 * DIMENSIONS + 1), dtype=np.float32)
    for row, text in enumerate(texts):
        cores, shapes = entries(text, words)
        if len(cores):
            kinds, n = np.unique(cores, return_counts=True)
            out[row, :DIMENSIONS] = n.astype(np.float32) @ vectors[kinds] / len(cores)
            kinds, n = np.unique(shapes, return_counts=True)
            out[row, DIMENSIONS:-1] = n.astype(np.float32) @ vectors[CORES + kinds] / len(cores)
            out[row, -1] = np.log1p(len(cores))
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def fit_network(x: np.ndarray, y: np.ndarray, epochs: int = 120, rate: float = 0.01, decay: float = 1e-3, seed: int = 7) -> Network:
    """Learn by Adam on four fifths of the rows, then set the temperature on the rest.

    With no rows the scores are 0.5; with one label only they are that label's share, smoothed.
    """
    rng = np.random.default_rng(seed)
    size = x.shape[1]
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Network(np.zeros(size), np.ones(size), np.zeros((size, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(share / (1 - share))))
    order = rng.permutation(len(y))
    held, learned = (order[::5], np.delete(order, np.s_[::5])) if len(y) >= 50 else (order, order)
    mean, scale = x[learned].mean(0), x[learned].std(0) + 1e-6
    share = np.clip(y[learned].mean(), 0.01, 0.99)
    p = {"w1": rng.normal(0, size**-0.5, (size, HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, HIDDEN**-0.5, HIDDEN), "b2": np.array(np.log(share / (1 - share)))}
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    z, step = (x - mean) / scale, 0
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(learned), max(1, len(learned) // 128)):
            hidden = np.tanh(z[batch] @ p["w1"] + p["b1"])
            error = (1 / (1 + np.exp(-np.clip(hidden @ p["w2"] + p["b2"], -50, 50))) - y[batch]) / len(batch)
            back = error[:, None] * p["w2"] * (1 - hidden**2)
            grads = {"w1": z[batch].T @ back + decay * p["w1"], "b1": back.sum(0), "w2": hidden.T @ error + decay * p["w2"], "b2": error.sum()}
            step += 1
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g**2
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        rate *= 0.98
    network = Network(mean, scale, p["w1"], p["b1"], p["w2"], float(p["b2"]))
    logits, truth = network.logits(x[held]), y[held]
    loss = lambda t: np.logaddexp(0, np.where(truth > 0, -logits, logits) / t).mean()
    network.temperature = float(min(np.geomspace(0.5, 8, 60), key=loss))
    return network


@dataclass
class QualityModel:
    vectors: np.ndarray
    network: Network

    def scores(self, texts: list[bytes], words: Words) -> np.ndarray:
        return self.network.scores(pooled(texts, self.vectors, words))


def word_vectors(sample: DataFrame, span: int = 2) -> np.ndarray:
    """Sum, for each vocabulary entry, of the index vectors of the words and shapes up to span words away.

    Every task sends the driver one matrix of fixed size (vocabulary x dimensions); the sample is bounded, and so are its tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, index, total = Words(), index_vectors(), np.zeros((VOCABULARY, DIMENSIONS))
        for batch in batches:
            for text in batch.column(0):
                cores, shapes = entries(text.as_py(), words)
                for at in range(0, len(cores), 50_000):
                    lo, hi = max(0, at - span), min(len(cores), at + 50_000 + span)
                    own = index[cores[lo:hi]] + index[CORES + shapes[lo:hi]]
                    run_sum = np.concatenate([np.zeros((1, DIMENSIONS)), np.cumsum(own, axis=0)])
                    here = np.arange(at, min(at + 50_000, len(cores)))
                    around = run_sum[np.minimum(here + span + 1, hi) - lo] - run_sum[np.maximum(here - span, lo) - lo]
                    total[:CORES] += _summed(cores[here], around, CORES)
                    total[CORES:] += _summed(shapes[here], around, SHAPES)
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f4").tobytes()], pa.binary())], ["sums"])

    parts = sample.select(F.col("text").cast("binary").alias("text")).coalesce(4).mapInArrow(run, "sums binary").collect()  # four rows at most
    total = sum((np.frombuffer(r["sums"], dtype="<f4").reshape(VOCABULARY, DIMENSIONS) for r in parts), np.zeros((VOCABULARY, DIMENSIONS), np.float32))
    total = total + index_vectors()  # an entry that the sample lacks keeps its own index vector
    return (total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, most_rows: int = MOST_ROWS) -> QualityModel:
    """Learn from at most most_rows labelled documents (labels: doc_id, quality)."""
    sample = staged(labelled_sample(docs, labels, "quality", learn_from, most_rows).orderBy("doc_id"))
    vectors = word_vectors(sample)
    shared = sample.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for row in range(batch.num_rows):
                x = pooled([batch.column(1)[row].as_py()], shared.value, words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), batch.column(2).slice(row, 1), pa.array([x.astype("<f4").tobytes()], pa.binary())], ["doc_id", "label", "x"])

    ddl = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label int, x binary"
    rows = sample.select("doc_id", F.col("text").cast("binary").alias("text"), "label").mapInArrow(run, ddl).collect()  # most_rows rows of fixed size
    rows = sorted(rows, key=lambda r: (str(r["doc_id"]), r["x"]))
    x = np.array([np.frombuffer(r["x"], dtype="<f4") for r in rows], dtype=np.float64).reshape(len(rows), 2 * DIMENSIONS + 1)
    return QualityModel(vectors, fit_network(x, np.array([r["label"] for r in rows], dtype=np.float64)))


def score(docs: DataFrame, model: QualityModel, out: str = "quality_score") -> DataFrame:
    """docs with a column `out` (0 to 1) in place of any of that name, from the whole text alone.

    Null text counts as empty, and empty texts get a score. Repeated rows give repeated rows; other columns are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = Words()
        for column in batches:
            yield pd.Series(shared.value.scores(list(column), words), dtype="float64")
        words.clear()
        give_back()

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.withColumn(out, scores(text))
