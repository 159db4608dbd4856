"""How far the sources of a language differ in their words, in whole numbers.

Word counts of each source are packed by blocks of sources and chunks of the vocabulary. Every pair of source blocks of a
language is a tile: both blocks' counts are sent to it, it walks through its chunks, makes the two dense blocks of shares
for one chunk at a time and adds the chunk's part to the matrix of its pairs. What a task holds is bounded by the block and the chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrand.storage import staged

#: What lies between terms, the letters that are lower-cased.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Sources of a block, terms of a chunk, chunks that one task walks through.
BLOCK, CHUNK, SPAN = 64, 4096, 64
PARTIAL = "lang string, source string, item string, value long"


def _share(n: Column, total: Column) -> Column:
    """1 + floor(10^9 n / total) for 0 <= n <= total, three digits at a time, so that no product leaves 64 bits."""
    whole, rest = F.lit(0).cast("long"), n
    for _ in range(3):
        step = rest * 1000
        whole, rest = whole * 1000 + F.call_function("div", step, total), step % total
    return whole + 1


def shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The same for arrays."""
    whole, rest = np.zeros_like(n), n
    for _ in range(3):
        step = rest * 1000
        whole, rest = whole * 1000 + step // total, step % total
    return whole + 1


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    terms = F.sort_array(F.split(plain, BETWEEN)).alias("terms")  # splitting is linear in the text; extracting all matches copies it for each
    rows = docs.select(_name("lang"), _name("source"), terms).select("lang", "source", "terms", F.posexplode("terms").alias("at", "term")).where("term <> ''")
    first = F.coalesce(F.get("terms", F.col("at") - 1) != F.col("term"), F.lit(True))
    return rows.select("lang", "source", "term", first.cast("long").alias("first")).groupBy("lang", "source", "term").agg(F.count("*").alias("n"), F.sum("first").alias("docs"))


def _name(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias(column)


def _dense(row: dict, smoothing: int) -> np.ndarray:
    """The shares of one block in one chunk: a row for each source, a column for each term."""
    counts = np.zeros((len(row["totals"]), row["width"]), np.int64)
    counts[row["member"], row["position"]] = row["n"]
    return shares(counts + smoothing, row["totals"][:, None])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i] for c in batch.schema.names}
            yield {c: row[c].as_py() for c in ("lang", "a", "b", "span", "block", "width", "sources")} | {c: row[c].values.to_numpy(zero_copy_only=False) for c in ("totals", "member", "position", "n")}


def _tile_sums(smoothing: int):
    """Rows of a tile follow each other, chunk by chunk: the one block, then, unless the tile is on the diagonal, the other."""

    def told(lang: str, left: list[str], right: list[str], value: np.ndarray) -> pa.RecordBatch:
        i, j = np.nonzero(np.ones(value.shape, bool) if left is not right else ~np.eye(len(left), dtype=bool))
        a, b, v = pa.array(left).take(pa.array(i)), pa.array(right).take(pa.array(j)), pa.array(value[i, j])
        both = (a, b, v) if left is right else (pa.concat_arrays([a, b]), pa.concat_arrays([b, a]), pa.concat_arrays([v, v]))
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(both[0]), pa.string()), *both], ["lang", "source", "item", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = value = left = right = None
        rows = _unpacked(batches)
        for row in rows:
            other = row if row["a"] == row["b"] else next(rows)
            if tile != (now := (row["lang"], row["a"], row["b"], row["span"])):
                if tile:
                    yield told(tile[0], left, right, value)
                tile, left, right = now, row["sources"], other["sources"]
                value = np.zeros((len(left), len(right)), np.int64)
            p = _dense(row, smoothing)
            q = p if other is row else _dense(other, smoothing)
            for i in range(len(left)):
                value[i] += np.abs(q - p[i]).sum(1)
        if tile:
            yield told(tile[0], left, right, value)

    return run


def source_divergence(docs: DataFrame, least_docs: int = 30, smoothing: int = 5, top: int = 50, block: int = BLOCK, chunk: int = CHUNK, span: int = SPAN) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source is from each other source of its language (part pair), and its own words (part term).

    docs: text, lang, source; nulls count as empty text, empty names. Terms are runs of letters, only A-Z lower-cased;
    a language keeps the terms that occur in least_docs of its documents (rows; repeated rows count each).
    A share is 1 + floor(10^9 (n + smoothing) / (N + smoothing V)), N the occurrences of kept terms, V their number. pair: the
    sum over kept terms of the differences of shares, 0 if no term is kept. term: by how much the source's share exceeds its language's,
    for the terms that it has, the first `top`; ties by item in byte order. No rows give no rows.
    """
    counts = staged(term_counts(docs))
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    langs = staged(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("all_total")))
    kept = kept.join(langs, "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / chunk)).cast("int"))
    position = (F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1).alias("position")
    kept = staged(kept.select("lang", "term", "all_n", (F.col("all_total") + smoothing * F.col("v")).alias("all_total"), "chunk", position))
    known = staged(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "all_n", "all_total", "chunk", "position"))

    sums = known.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select(_name("lang"), _name("source")).distinct().join(sums, ["lang", "source"], "left").join(langs.select("lang", "v"), "lang", "left")
    index = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    total = F.coalesce("total", F.lit(0)) + smoothing * F.coalesce("v", F.lit(0))
    groups = staged(groups.select("lang", "source", F.greatest(total, F.lit(1)).alias("total"), index.alias("at")))
    groups = groups.withColumn("block", F.call_function("div", F.col("at"), F.lit(block)).cast("int")).withColumn("member", (F.col("at") % block).cast("int"))

    own = known.join(groups.select("lang", "source", "total"), ["lang", "source"])
    above = _share(F.col("n") + smoothing, F.col("total")) - _share(F.col("all_n") + smoothing, F.col("all_total"))
    terms = own.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), above.alias("value")).where("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    widths = kept.groupBy("lang", "chunk").agg(F.count("*").cast("int").alias("width"))
    member = F.struct("member", "source", "total")
    blocks = groups.groupBy("lang", "block").agg(F.sort_array(F.collect_list(member)).alias("of"))  # `block` rows at most
    blocks = blocks.select("lang", "block", F.col("of.source").alias("sources"), F.col("of.total").alias("totals"))
    grid = blocks.join(widths, "lang", "left").select("lang", "block", F.coalesce("chunk", F.lit(0)).alias("chunk"), F.coalesce("width", F.lit(0)).alias("width"), "sources", "totals")
    entry = F.struct("member", "position", "n")
    packed = known.join(groups.select("lang", "source", "block", "member"), ["lang", "source"]).groupBy("lang", "block", "chunk").agg(F.collect_list(entry).alias("of"))  # block x chunk entries at most
    packed = staged(grid.join(packed, ["lang", "block", "chunk"], "left"))
    most = packed.groupBy("lang").agg(F.max("block").alias("last"))
    sent = packed.join(most, "lang").withColumn("with", F.explode(F.sequence(F.lit(0), "last")))
    sent = sent.select(
        "lang", F.least("block", "with").alias("a"), F.greatest("block", "with").alias("b"), F.call_function("div", F.col("chunk"), F.lit(span)).cast("int").alias("span"), "chunk", "block", "width", "sources", "totals",
        *(F.coalesce(F.col(f"of.{c}"), F.array().cast(f"array<{kind}>")).alias(c) for c, kind in (("member", "int"), ("position", "int"), ("n", "bigint"))),
    )
    tiles = sent.repartition("lang", "a", "b", "span").sortWithinPartitions("lang", "a", "b", "span", "chunk", "block")
    pairs = tiles.mapInArrow(_tile_sums(smoothing), PARTIAL).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
