"""Vectors in packed blocks: a block holds rows of one cell, and a query meets only the cells that it asks for.

A cell is dealt to parts of a bounded number of rows. Each part is a task's key: its data blocks are shipped to it once
and held, and the blocks of the queries that ask for the cell stream past them. So a cell of any size, and any number of queries, is
many keys of bounded memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a block of data, of a part of a cell, of a block of queries; queries that one copy of a part serves.
DATA_ROWS, PART_ROWS, QUERY_ROWS, SERVED = 2048, 32_768, 512, 1 << 17
BLOCK = "cell int, part int, kind int, ids binary, vectors binary, extra binary"


def valid_vectors(table: DataFrame, non_zero: bool = False) -> DataFrame:
    """vec_id (long), vector (array of double) of the rows that take part.

    Rows with a null vec_id, a null or empty vector, null or non-finite components (and zero vectors, if non_zero)
    take no part. Of vectors of several lengths those of the commonest take part (of equally common ones the
    shortest). Of rows with the same vec_id the one with the smallest vector takes part.
    """
    vector = F.col("embedding").cast("array<double>")
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).where((F.size("vector") > 0) & ~bad)
    if non_zero:
        rows = rows.where(F.exists("vector", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n"))
    commonest = sizes.orderBy(F.col("n").desc(), "size").limit(1).select(F.col("size").alias("_size"))
    rows = rows.join(F.broadcast(commonest), F.size("vector") == F.col("_size")).drop("_size")  # one row
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column, all of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def parts_of(cell_rows: np.ndarray) -> np.ndarray:
    """How many parts each cell has."""
    return np.maximum(1, -(-cell_rows.astype(np.int64) // PART_ROWS))


def data_blocks(rows: DataFrame, parts: np.ndarray, extra: Callable[[np.ndarray], bytes]) -> DataFrame:
    """The rows (cell, vec_id, vector) as blocks; extra: what else a block keeps of its vectors."""

    @F.pandas_udf("int")
    def part_of(cell: pd.Series, mixed: pd.Series) -> pd.Series:
        return pd.Series(mixed.to_numpy() % parts[cell.to_numpy()]).astype("int32")

    dealt = rows.withColumn("part", part_of("cell", F.xxhash64("vec_id"))).repartition("cell", "part").sortWithinPartitions("cell", "part", "vec_id")

    def told(key: tuple[int, int], held: list[tuple]) -> pa.RecordBatch:
        ids, vectors = (np.concatenate(x) for x in zip(*held, strict=True))
        columns = [[key[0]], [key[1]], [0], [ids.astype("<i8").tobytes()], [vectors.astype("<f8").tobytes()], [extra(vectors)]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32()] * 3 + [pa.binary()] * 3, strict=True)], ["cell", "part", "kind", "ids", "vectors", "extra"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, n = None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cells, parts_, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            vectors = matrix(batch.column(3))
            cuts = [0, *(np.flatnonzero((cells[1:] != cells[:-1]) | (parts_[1:] != parts_[:-1])) + 1).tolist(), len(cells)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                now = int(cells[lo]), int(parts_[lo])
                if held and now != key:
                    yield told(key, held)
                    held, n = [], 0
                key = now
                while lo < hi:
                    take = min(hi - lo, DATA_ROWS - n)
                    held.append((ids[lo : lo + take], vectors[lo : lo + take]))
                    n, lo = n + take, lo + take
                    if n == DATA_ROWS:
                        yield told(key, held)
                        held, n = [], 0
        if held:
            yield told(key, held)

    return dealt.select("cell", "part", "vec_id", "vector").mapInArrow(run, BLOCK)


def query_blocks(asked: DataFrame, numbers: list[str], wanted: Callable[..., np.ndarray], parts: np.ndarray, chunks: int) -> DataFrame:
    """Blocks of the queries (vec_id, vector and the numbers, doubles), one for each part of each cell that one of them wants.

    wanted(vectors, *numbers): a row for each query, a column for each cell. The first number goes with the block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_ROWS):
                part = batch.slice(at, QUERY_ROWS)
                ids, vectors = part.column(0).to_numpy(zero_copy_only=False), matrix(part.column(1))
                told = [part.column(2 + i).to_numpy(zero_copy_only=False) for i in range(len(numbers))]
                want = wanted(vectors, *told)
                chunk = int(ids[0]) // QUERY_ROWS % chunks
                for cell in np.flatnonzero(want.any(axis=0)).tolist():
                    mine = np.flatnonzero(want[:, cell])
                    payload = [ids[mine].astype("<i8").tobytes(), vectors[mine].astype("<f8").tobytes(), told[0][mine].astype("<f8").tobytes()]
                    n = int(parts[cell])
                    columns = [[cell] * n, list(range(n)), [1] * n, *([x] * n for x in payload), [chunk] * n]
                    kinds = [pa.int32()] * 3 + [pa.binary()] * 3 + [pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["cell", "part", "kind", "ids", "vectors", "extra", "chunk"])

    return asked.select("vec_id", "vector", *numbers).mapInArrow(run, f"{BLOCK}, chunk int")


Kernel = Callable[[tuple[np.ndarray, np.ndarray, bytes], tuple[np.ndarray, np.ndarray, np.ndarray]], tuple[np.ndarray, np.ndarray, np.ndarray]]


def meet(data: DataFrame, queries: DataFrame, kernel: Kernel, chunks: int, value: str = "double") -> DataFrame:
    """query_id, vec_id, value: what kernel finds for each block of queries in each data block of its part.

    A part is shipped once for each chunk of the queries (of about SERVED).
    """
    copies = data.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    both = copies.unionByName(queries).repartition("cell", "part", "chunk").sortWithinPartitions("cell", "part", "chunk", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in (0, 1, 6)), strict=True))
            kinds = batch.column(2).to_pylist()
            for i in range(batch.num_rows):
                if keys[i] != key:
                    key, held = keys[i], []
                ids = np.frombuffer(batch.column(3)[i].as_buffer(), dtype="<i8")
                vectors = np.frombuffer(batch.column(4)[i].as_buffer(), dtype="<f8").reshape(len(ids), -1)
                extra = batch.column(5)[i].as_py()
                if kinds[i] == 0:
                    held.append((ids.copy(), vectors.copy(), extra))
                    continue
                for block in held:
                    found = kernel(block, (ids, vectors, np.frombuffer(extra, dtype="<f8")))
                    if len(found[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "vec_id", "value"])

    return both.select("cell", "part", "kind", "ids", "vectors", "extra", "chunk").mapInArrow(run, f"query_id long, vec_id long, value {value}")


def best(found: DataFrame, k: int, largest: bool) -> DataFrame:
    """The k best values of each query, ties to the smaller vec_id; rank from 1. A vec_id that was found twice counts once."""
    value = F.col("value").desc() if largest else F.col("value").asc()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(value, "vec_id"))
    return found.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", rank).where(F.col("rank") <= k)
