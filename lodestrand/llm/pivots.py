"""Exact top-k inner products through a pivot-distance index.

Vectors are lifted by one coordinate onto a sphere, where the largest inner product is the smallest distance. Each is
keyed by its nearest pivot and its distance to it; the distances of a pivot are cut into sorted annuli. A query
expands the annuli in the order of their lower bounds, by the triangle inequality, and stops when the
next annulus can't hold a score as good as its k-th best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.blocks import SERVED, best, data_blocks, matrix, meet, parts_of, query_blocks, valid_vectors
from lodestrand.storage import staged

#: Rows for each pivot, the fewest and the most pivots, and annuli of each: the index grows with the rows up to this bound of what is broadcast.
PIVOT_ROWS, FEWEST, MOST, ANNULI = 4096, 8, 512, 8
#: How many annuli a query has expanded after each round; then all that its bound lets in.
EXPANSIONS = (6, 48)
LONG = 2**63


def integer_vectors(table: DataFrame, factor: int = 256) -> DataFrame:
    """Each component x as floor(factor * x); what is beyond the range of long is its nearest long."""
    return table.withColumn("vector", F.transform("vector", lambda x: F.floor(F.greatest(F.lit(-1e300), F.least(F.lit(1e300), x)) * factor).cast("double")))


def _lifted(v: np.ndarray, top: float) -> np.ndarray:
    return np.hstack([v, np.sqrt(np.maximum(top - (v**2).sum(1, keepdims=True), 0))])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0))


def _placed(vectors: DataFrame, pivots: np.ndarray, top: float) -> DataFrame:
    """vec_id, vector, pivot, distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _distances(_lifted(matrix(batch.column(1)), top), pivots)
                nearest = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype(np.int32)), pa.array(d[np.arange(len(d)), nearest])], ["vec_id", "vector", "pivot", "distance"])

    return vectors.select("vec_id", "vector").mapInArrow(run, "vec_id long, vector array<double>, pivot int, distance double")


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, row by row, without rounding; what is beyond the range of long is its nearest long."""
    told = [sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for p, q in zip(a.tolist(), b.tolist(), strict=True)]
    return np.array([max(-LONG, min(LONG - 1, x)) for x in told], dtype=np.int64)


def top_k(table: DataFrame, every: int = 50, k: int = 5, pivots: int | None = None, annuli: int = ANNULI, factor: int = 256, expansions: tuple[int, ...] = EXPANSIONS) -> DataFrame:
    """The k rows with the largest integer inner product with each query, exactly.

    table: vec_id, embedding; which rows take part: see blocks.valid_vectors. Queries: the rows whose vec_id is divisible
    by `every`; a query is not its own candidate. Returns query_id, rank (int, from 1), vec_id, score (long); ties go to the
    smaller vec_id, and a query with fewer candidates has them all. An empty table gives no rows. Any finite component is taken:
    where products exceed what a double holds exactly, what may count is scored again in whole numbers; scores beyond the range of long are the nearest long.
    """
    spark = table.sparkSession
    vectors = staged(integer_vectors(valid_vectors(table), factor))
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    asks = F.pmod("vec_id", F.lit(every)) == 0
    rows, top, n_asked = vectors.agg(F.count("*"), F.max(norm), F.count_if(asks)).first()
    if not rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pivots = pivots or max(FEWEST, min(MOST, rows // PIVOT_ROWS))
    sample = [r["vector"] for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()]  # `pivots` rows
    centres = _lifted(np.array(sample, dtype=np.float64), top)
    placed = _placed(vectors, centres, top)
    cuts = placed.groupBy("pivot").agg(F.percentile_approx("distance", [i / annuli for i in range(1, annuli)], 1000).alias("cuts")).collect()  # a row for each pivot
    bounds = np.zeros((len(centres), annuli - 1))
    for r in cuts:
        bounds[r["pivot"]] = r["cuts"]

    @F.pandas_udf("int")
    def cell_of(pivot: pd.Series, distance: pd.Series) -> pd.Series:
        d, p = distance.to_numpy(), pivot.to_numpy()
        return pd.Series(p * annuli + (d[:, None] >= bounds[p]).sum(1)).astype("int32")

    placed = staged(placed.withColumn("cell", cell_of("pivot", "distance")))
    size = len(centres) * annuli
    lo, hi, n = np.full(size, np.inf), np.full(size, -np.inf), np.zeros(size, np.int64)
    for r in placed.groupBy("cell").agg(F.min("distance").alias("lo"), F.max("distance").alias("hi"), F.count("*").alias("n")).collect():  # pivots x annuli rows
        lo[r["cell"]], hi[r["cell"]], n[r["cell"]] = r["lo"], r["hi"], r["n"]
    parts, chunks = parts_of(n), max(1, -(-n_asked // SERVED))
    data = staged(data_blocks(placed, parts, lambda vectors: b""))
    exact = top < 2.0**52
    near, far = 1e-6 * np.sqrt(top), 1e-6 * top + 1  # more than rounding can move a bound, and a score that it allows
    off = 0.0 if exact else 1e-15 * len(sample[0]) * top  # more than rounding can move a score

    def least_bounds(q: np.ndarray) -> np.ndarray:
        """How near a row of each cell can be to each query; infinite for empty cells."""
        d = np.repeat(_distances(np.hstack([q, np.zeros((len(q), 1))]), centres), annuli, axis=1)
        return np.where(n > 0, np.maximum(np.maximum(d - hi, lo - d), 0), np.inf)

    def first_cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bound up to which a query reads in each round, fixed once: what a round starts at is where the one before ended."""
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                bound = np.sort(least_bounds(matrix(part.column(1))), axis=1)
                ends = [bound[:, min(e, size) - 1] for e in expansions]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(e) for e in ends)], ["vec_id", "vector", *(f"end{i}" for i in range(len(ends)))])

    ends = [f"end{i}" for i in range(len(expansions))]
    queries = staged(placed.where(asks).orderBy("cell").select("vec_id", "vector").mapInArrow(first_cuts, "vec_id long, vector array<double>" + "".join(f", {e} double" for e in ends)))

    def wanted(q: np.ndarray, least: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        bound = least_bounds(q)
        most = ((q**2).sum(1)[:, None] + top - bound**2) / 2  # what a score can be there
        return np.isfinite(bound) & (bound >= start[:, None] - near) & (bound <= end[:, None] + near) & (most + far >= least[:, None])

    def kernel(block: tuple, query: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        (ids, x, _), (asked, q, least) = block, query
        scores = np.clip(q @ x.T, -float(LONG), float(LONG))
        scores[asked[:, None] == ids[None]] = -np.inf
        if len(ids) > k:  # the k-th best of the block, and its ties, are the least that can count
            least = np.maximum(least, np.partition(scores, -k, axis=1)[:, -k])
        i, j = np.nonzero((scores >= least[:, None] - 2 * off) & np.isfinite(scores))
        if exact:
            return asked[i], ids[j], scores[i, j].astype(np.int64)
        value = exact_scores(q[i], x[j])
        order = np.lexsort((ids[j], [-int(v) for v in value], i))  # many may be the nearest long: k of a query are enough
        order = order[np.arange(len(order)) - np.searchsorted(i[order], i[order], side="left") < k]
        return asked[i[order]], ids[j[order]], value[order]

    found, start = None, F.lit(float("-inf"))
    for end in [*(F.col(e) for e in ends), F.lit(float("inf"))]:
        if found is None:
            asked = queries.withColumn("least", F.lit(float("-inf")))
        else:
            kth = found.where((F.col("rank") == k) & (F.col("value") > -LONG)).select(F.col("query_id").alias("_id"), F.col("value").cast("double").alias("least"))
            asked = queries.join(kth, F.col("vec_id") == F.col("_id"), "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
        asked = asked.select("vec_id", "vector", "least", start.alias("start"), end.alias("end"))
        new = meet(data, query_blocks(asked, ["least", "start", "end"], wanted, parts, chunks), kernel, chunks, "long")
        if found is not None:
            new = new.unionByName(found.select("query_id", "vec_id", "value"))
        found, start = staged(best(new, k, largest=True)), end
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("value").alias("score"))
