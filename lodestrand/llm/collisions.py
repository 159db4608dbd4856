"""Approximate nearest neighbours by collision counting.

Every vector has m projections; a block of vectors keeps each of them as a sorted array, made once when the block is
written. A query opens a window around its own projection in each array and counts in how many windows a row lies;
rows with enough collisions, and no others, are verified by their true distance. The windows grow with the radius (virtual
rehashing: the same arrays serve every radius), until a query's k-th best distance lies within its radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.blocks import SERVED, best, data_blocks, matrix, meet, parts_of, query_blocks, valid_vectors
from lodestrand.storage import staged

#: Projections; half the width of a window, in radii; share of the windows that make a candidate.
PROJECTIONS, HALF_WIDTH, SHARE = 48, 1.25, 0.7
#: Groups of near vectors, whose spans tell which queries need them: rows of each, the fewest and the most. Rows that the first radius is estimated from.
GROUP_ROWS, FEWEST, MOST, SAMPLE = 4096, 8, 4096, 4096
ROUNDS = 8


def projections(size: int, m: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(size, m))


def first_radius(sample: np.ndarray, k: int, rows: int) -> float:
    """The distance below which k of `rows` rows lie, by the distances of 200 rows of the sample to all of it."""
    some = sample[:200]
    d = np.sqrt(np.maximum((some**2).sum(1)[:, None] + (sample**2).sum(1)[None] - 2 * some @ sample.T, 0))
    d = np.sort(d[np.arange(len(some))[:, None] != np.arange(len(sample))[None]])
    return float(d[min(len(d) - 1, int(len(d) * k / max(rows, 1)))]) or 1e-9 if len(d) else 1e-9


def sorted_projections(vectors: np.ndarray, a: np.ndarray) -> bytes:
    """Each projection of the vectors as a sorted array, and the rows in its order."""
    p = (vectors @ a).astype("<f4")
    order = np.argsort(p, axis=0, kind="stable")
    return np.take_along_axis(p, order, 0).T.tobytes() + order.T.astype("<u2").tobytes()


def read_projections(kept: bytes, m: int) -> tuple[np.ndarray, np.ndarray]:
    """values, order: a row for each projection."""
    n = len(kept) // (6 * m)
    return np.frombuffer(kept, "<f4", n * m).reshape(m, n), np.frombuffer(kept, "<u2", n * m, 4 * n * m).reshape(m, n)


def collisions(values: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, needed: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each query that has enough open windows: its number, and the rows that lie in `needed` of its windows (a row of low and high)."""
    m, n = values.shape
    first = np.stack([np.searchsorted(values[j], low[:, j], side="left") for j in range(m)], axis=1)
    last = np.stack([np.searchsorted(values[j], high[:, j], side="right") for j in range(m)], axis=1)
    for i in np.flatnonzero((last > first).sum(1) >= needed):
        counts = np.bincount(np.concatenate([order[j, a:b] for j, (a, b) in enumerate(zip(first[i], last[i], strict=True))]), minlength=n)
        yield i, np.flatnonzero(counts >= needed)


def search(table: DataFrame, every: int = 100, k: int = 10, m: int = PROJECTIONS, half_width: float = HALF_WIDTH, share: float = SHARE, groups: int | None = None, radius: float | None = None) -> DataFrame:
    """The k nearest rows found for each query, by Euclidean distance.

    table: vec_id, embedding; which rows take part: see blocks.valid_vectors (zero vectors don't). Queries: the rows whose vec_id is
    divisible by `every`; a query is not its own candidate. Returns query_id, rank (int, from 1), vec_id, score (double, the
    distance of the vectors as given; infinite beyond the range of double); nearest first, ties to the smaller vec_id; a query with fewer candidates
    has them all. An empty table gives no rows. Every row is indexed; only the first radius comes from a sample of SAMPLE rows.
    """
    spark = table.sparkSession
    vectors = staged(valid_vectors(table, non_zero=True))
    asks = F.pmod("vec_id", F.lit(every)) == 0
    rows, largest, n_asked = vectors.agg(F.count("*"), F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))), F.count_if(asks)).first()
    if not rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    unit = 1.0 if 1e-100 <= largest <= 1e100 else 2.0 ** np.floor(np.log2(largest))  # a power of two: squares neither overflow nor vanish
    groups = groups or max(FEWEST, min(MOST, rows // GROUP_ROWS))
    sample = np.array([r["vector"] for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()], dtype=np.float64) / unit  # SAMPLE rows
    a, centres, needed = projections(sample.shape[1], m), sample[:groups], int(np.ceil(share * m))

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1)) / unit
                cell = ((centres**2).sum(1)[None] - 2 * x @ centres.T).argmin(1)
                kept = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column(0), kept], ["cell", "vec_id", "vector"])

    placed = staged(vectors.select("vec_id", "vector").mapInArrow(grouped, "cell int, vec_id long, vector array<double>"))

    def span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, n = np.full((groups, m), np.inf), np.full((groups, m), -np.inf), np.zeros(groups, np.int64)
        for batch in batches:
            if batch.num_rows:
                cell, p = batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1)) @ a
                np.minimum.at(low, cell, p)
                np.maximum.at(high, cell, p)
                n += np.bincount(cell, minlength=groups)
        at = np.flatnonzero(n)
        each = [pa.array(np.repeat(at, m).astype(np.int32)), pa.array(np.tile(np.arange(m, dtype=np.int32), len(at))), pa.array(low[at].ravel()), pa.array(high[at].ravel()), pa.array(np.repeat(n[at], m))]
        yield pa.RecordBatch.from_arrays(each, ["cell", "j", "low", "high", "n"])

    spans = placed.select("cell", "vector").mapInArrow(span, "cell int, j int, low double, high double, n long")
    low, high, n = np.full((groups, m), np.inf), np.full((groups, m), -np.inf), np.zeros(groups, np.int64)
    for r in spans.groupBy("cell", "j").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).collect():  # groups x projections rows
        low[r["cell"], r["j"]], high[r["cell"], r["j"]], n[r["cell"]] = r["low"], r["high"], r["n"]
    parts, chunks = parts_of(n), max(1, -(-n_asked // SERVED))
    data = staged(data_blocks(placed, parts, lambda vectors: sorted_projections(vectors, a)))

    def wanted(q: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """The groups that enough windows of the query overlap."""
        p, half = q @ a, half_width * radius[:, None, None] * (1 + 1e-6)
        at = range(0, len(q), 32)
        return np.concatenate([((p[i : i + 32, None] + half[i : i + 32] >= low[None]) & (p[i : i + 32, None] - half[i : i + 32] <= high[None])).sum(2) >= needed for i in at]) & (n > 0)[None]

    def kernel(block: tuple, query: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        (ids, x, kept), (asked, q, radius) = block, query
        values, order = read_projections(kept, m)
        p, half = (q @ a).astype("<f4"), half_width * radius[:, None]
        out = []
        for i, found in collisions(values, order, p - half, p + half, needed):
            found = found[ids[found] != asked[i]]
            d = np.sqrt(((x[found] - q[i]) ** 2).sum(1))
            if len(found) > k:
                near = d <= np.partition(d, k - 1)[k - 1]
                found, d = found[near], d[near]
            out.append((np.full(len(found), asked[i]), ids[found], d))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    begin = first_radius(sample, k, rows) if radius is None else radius / unit
    asked = staged(placed.where(asks).orderBy("cell").select("vec_id", "vector", F.lit(begin).alias("radius")))
    done = None
    for step in range(1, ROUNDS + 1):
        found = staged(best(meet(data, query_blocks(asked, ["radius"], wanted, parts, chunks), kernel, chunks), k, largest=False))
        kth = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("value").alias("kth"))
        state = staged(asked.join(kth, "vec_id", "left"))
        over = (F.col("kth") <= F.col("radius")) | F.lit(step == ROUNDS) | (F.col("radius") == float("inf"))
        over = F.coalesce(over, F.lit(False))
        settled = found.join(state.where(over).select(F.col("vec_id").alias("query_id")), "query_id", "left_semi")
        done = settled if done is None else done.unionByName(settled)
        # a k-th distance bounds the true one: as the next radius it is the last; without one, the radius grows, at last without bound
        grown = F.when(F.lit(step >= ROUNDS - 2), F.lit(float("inf"))).otherwise(F.coalesce("kth", F.col("radius") * 2))
        asked = staged(state.where(~over).select("vec_id", "vector", grown.alias("radius")))
        if asked.isEmpty():
            break
    return done.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", (F.col("value") * unit).alias("score"))
