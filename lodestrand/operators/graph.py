"""Connected components of a link table, by alternating stars; every round is a table in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.storage import discard, staged

#: Links that a task contracts at a time.
AT_ONCE = 1 << 20


def stars(size: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between the numbers below size as (number, least number of its component)."""
    least = np.arange(size)
    while True:
        low = np.minimum(least[a], least[b])
        now = least.copy()
        np.minimum.at(now, a, low)
        np.minimum.at(now, b, low)
        np.minimum.at(now, least[a], low)
        np.minimum.at(now, least[b], low)
        now = now[now]
        if (now == least).all():
            break
        least = now
    moved = np.flatnonzero(least != np.arange(size))
    return moved, least[moved]


def _contracted(edges: DataFrame) -> DataFrame:
    """The same components with each task's links as stars, so that chains inside a task need no rounds."""

    def told(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        both = pa.concat_arrays([b.column(i) for i in (0, 1) for b in held]).dictionary_encode()
        order = pc.sort_indices(both.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        number = rank[both.indices.to_numpy()]
        found = stars(len(order), *np.split(number, 2))
        return pa.RecordBatch.from_arrays([both.dictionary.take(pa.array(order[x])) for x in found], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= AT_ONCE:
                yield told(held)
                held, rows = [], 0
        if rows:
            yield told(held)

    kind = edges.schema["u"].dataType.simpleString()
    return edges.select("u", "v").mapInArrow(run, f"u {kind}, v {kind}")


def _least(edges: DataFrame) -> DataFrame:
    """The least neighbour of each u, as a table: the join with it has two plain sides, so a node with many links can be split over tasks."""
    return staged(edges.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("m")))


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both)
    return both.join(least, F.col("u") == F.col("_u")).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    least = _least(edges)
    moved = edges.join(least, F.col("u") == F.col("_u")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("_u").alias("u"), F.col("m").alias("v"))), least


def _settled(edges: DataFrame) -> bool:
    """Whether the links are stars that share no node: every u has one v, which is no u itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    told = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
    return told.where("up > 1 or (up = 1 and n > 1)").isEmpty()


def components(links: DataFrame, rounds: int = 60, at_once: int = 0) -> DataFrame:
    """The smallest node that each linked node reaches.

    links: u, v of one orderable type; either direction, repeats and self-links are allowed, rows with a null are
    not links. Returns node, root for every node that has a link to another one. No links give no rows. The
    number of rounds is logarithmic in the size of the largest component. at_once: as soon as no more links are left, one task contracts them.
    """
    edges = staged(_contracted(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()))
    for _ in range(rounds):
        if at_once and edges.limit(at_once + 1).count() <= at_once:  # what one task holds
            edges = staged(_contracted(edges.coalesce(1)))
            break
        if _settled(edges):
            break
        large, a = _large_star(edges)
        large = staged(large.distinct())
        small, b = _small_star(large)
        new = staged(_contracted(small.distinct()))
        for table in (edges, a, b, large):
            discard(table)
        edges = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
