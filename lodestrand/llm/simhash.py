"""SimHash near-duplicate groups with a pigeonring filter.

A fingerprint of 64 bits is a ring of 8 segments. If two fingerprints differ in at most t bits, some segment
of the ring starts a chain whose first l segments together differ in at most floor(l * t / 8) bits, for every l.
Fingerprints meet where the part of such a chain that must be equal is equal; the whole chain is tested next,
then the full distance. Links are told as stars inside a bucket, so copies never become all their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrand.llm.shingles import shingle_hashes
from lodestrand.operators.graph import components, stars
from lodestrand.storage import discard, staged

SEGMENTS, SEGMENT_BITS = 8, 8
LANES = np.uint64(0x0101010101010101)
BATCH_HASHES, PAIRS_AT_ONCE = 1 << 20, 1 << 20


def mixed(hashes: np.ndarray, block: int) -> np.ndarray:
    """The hashes for a further block of 64 bits; block 0 keeps them."""
    if not block:
        return hashes
    z = hashes + np.uint64(block * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def majority_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A fingerprint for each run of hashes: the bits that over half of its hashes have. An empty run gives 0."""
    out = np.zeros(len(sizes), dtype=np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    n = sizes[full]
    pieces = -(-n // 255)  # a byte counts up to 255
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    at = np.repeat(first, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(np.concatenate([[0], np.cumsum(pieces)[:-1]]), pieces))
    counts = np.stack([np.add.reduceat((hashes >> np.uint64(j)) & LANES, at) for j in range(8)], axis=1)
    by_bit = counts.view(np.uint8).reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 64).astype(np.int64)
    totals = np.add.reduceat(by_bit, np.concatenate([[0], np.cumsum(pieces)[:-1]]), axis=0)
    out[full] = np.packbits(2 * totals > n[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def packed(bits: np.ndarray) -> pa.Array:
    """Fingerprints as binary; a row holds its blocks, most significant byte first."""
    return pa.array([x.tobytes() for x in bits.reshape(len(bits), -1).astype(">u8")], pa.binary())


def fingerprints(docs: DataFrame, words: int = 3, blocks: int = 1) -> DataFrame:
    """doc_id and fingerprint (binary, 8 bytes for each block, most significant first) of every whole text.

    Null text counts as empty: a fingerprint of zeros. Repeated rows give repeated rows.
    """

    def told(ids: list, hashes: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(x) for x in hashes], dtype=np.int64)
        every = np.concatenate(hashes)
        bits = np.stack([majority_bits(mixed(every, b), sizes) for b in range(blocks)], axis=1)
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), packed(bits)], ["doc_id", "fingerprint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, held, hashes = 0, 0, []
            for row, text in enumerate(batch.column(1)):
                hashes.append(shingle_hashes(text.as_py() or b"", words))
                held += len(hashes[-1])
                if held >= BATCH_HASHES or row + 1 == batch.num_rows:
                    yield told([batch.column(0).slice(start, row + 1 - start)], hashes)
                    start, held, hashes = row + 1, 0, []

    ddl = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint binary"
    return docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, ddl)


def budgets(most: int) -> np.ndarray:
    """How many bits the first 1, 2, ... segments of a chain may differ in."""
    return np.arange(1, SEGMENTS + 1) * most // SEGMENTS


def key_masks(most: int) -> list[np.ndarray]:
    """Bits that must be equal in a chain, as masks of its segments, one for each way to meet.

    The segments with a budget of 0 are equal (six of them are enough for a key). Of those after them with a
    budget of 1, cut into parts, all parts but one are equal.
    """
    budget = budgets(most)
    base = np.where((budget == 0) & (np.arange(SEGMENTS) < 6), 255, 0).astype(np.uint8)
    loose = np.flatnonzero(budget == 1)
    if not len(loose) or (base > 0).sum() + len(loose) > 6:
        return [base]
    if len(loose) == 1:
        parts = [(loose[0], 0x0F), (loose[0], 0xF0)]
        return [np.where(np.arange(SEGMENTS) == s, m, base).astype(np.uint8) for s, m in parts]
    return [np.where(np.isin(np.arange(SEGMENTS), loose[loose != s]), 255, base).astype(np.uint8) for s in loose]


def _bytes_of(column: pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    raw = np.frombuffer(column.buffers()[2], dtype=np.uint8)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return raw[offsets[0] : offsets[-1]].reshape(len(column), width)


def chain_keys(nodes: DataFrame, blocks: int, most: int) -> DataFrame:
    """key, fingerprint: a row for each place where a fingerprint can meet others (block, start in the ring, mask)."""
    masks = key_masks(most)
    ways = [(b, s, m) for b in range(blocks) for s in range(SEGMENTS) for m in range(len(masks))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.column(0).slice(at, 4096)
                rows = _bytes_of(part, 8 * blocks)
                keys = []
                for way, (b, s, m) in enumerate(ways):
                    chain = rows[:, 8 * b + (s + np.arange(SEGMENTS)) % SEGMENTS] & masks[m]
                    kept = np.ascontiguousarray(chain[:, masks[m] > 0])
                    value = np.zeros(len(rows), dtype=np.int64)
                    for column in range(kept.shape[1]):
                        value = value << 8 | kept[:, column]
                    keys.append(value | way << 48)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.concat_arrays([part] * len(ways))], ["key", "fingerprint"])

    return nodes.select("fingerprint").mapInArrow(run, "key long, fingerprint binary")


def bucket_links(keyed: DataFrame, blocks: int, most: int, most_total: int, bucket_rows: int, share: int = 8) -> DataFrame:
    """u, v: links as stars, from rows (key, fingerprint) that meet in a key.

    A large bucket is dealt to chunks, and each pair of its chunks is a bucket of its own: memory stays bounded.
    Large buckets are known from the share-th part of the fingerprints; what is missed is only slower.
    """
    budget, width, masks = budgets(most), 8 * blocks, len(key_masks(most))
    part = keyed.where(F.pmod(F.xxhash64("fingerprint"), F.lit(share)) == 0)
    large = part.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") * share > bucket_rows)
    large = staged(large.select(F.col("key").alias("_key"), F.ceil(F.col("n") * share / bucket_rows).cast("int").alias("chunks")))
    dealt = keyed.withColumn("cell", F.lit(0).cast("long"))
    if not large.isEmpty():
        chunk = F.pmod(F.xxhash64("fingerprint", F.lit(1)), F.col("chunks")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
        hot = keyed.join(large, F.col("key") == F.col("_key")).withColumn("chunk", chunk).withColumn("other", other)
        cell = (F.least("chunk", "other").cast("long") * 1_000_000 + F.greatest("chunk", "other") + 1).alias("cell")
        cold = dealt.join(large, F.col("key") == F.col("_key"), "left_anti")
        dealt = cold.unionByName(hot.select("key", "fingerprint", cell))
    dealt = dealt.repartition("key", "cell").sortWithinPartitions("key", "cell")

    def linked(keys: np.ndarray, cells: np.ndarray, rows: np.ndarray) -> pa.RecordBatch | None:
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (cells[1:] != cells[:-1])])
        run_of = np.cumsum(new) - 1
        ends = np.append(np.flatnonzero(new)[1:], len(keys))
        partners = ends[run_of] - np.arange(len(keys)) - 1
        found_a, found_b, before = [], [], np.concatenate([[0], np.cumsum(partners)])
        way = keys >> 48
        block, start = way // (SEGMENTS * masks), way // masks % SEGMENTS
        for lo in range(0, int(before[-1]), PAIRS_AT_ONCE):
            pair = np.arange(lo, min(lo + PAIRS_AT_ONCE, int(before[-1])))
            a = np.searchsorted(before, pair, side="right") - 1
            b = a + 1 + pair - before[a]
            chain = 8 * block[a][:, None] + (start[a][:, None] + np.arange(SEGMENTS)) % SEGMENTS
            differ = np.bitwise_count(np.take_along_axis(rows[a], chain, 1) ^ np.take_along_axis(rows[b], chain, 1))
            passed = (np.cumsum(differ, axis=1) <= budget).all(axis=1)  # the last budget is the full distance
            a, b = a[passed], b[passed]
            if blocks > 1:
                near = np.bitwise_count(rows[a] ^ rows[b]).sum(axis=1) <= most_total
                a, b = a[near], b[near]
            found_a.append(a)
            found_b.append(b)
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_a, found_b))
        if not len(a):
            return None
        kinds = np.ascontiguousarray(rows[np.concatenate([a, b])]).view(f"V{width}")[:, 0]
        nodes, number = np.unique(kinds, return_inverse=True)
        moved, least = stars(len(nodes), number[: len(a)], number[len(a) :])
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in nodes[i]], pa.binary()) for i in (moved, least)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = (batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False), _bytes_of(batch.column(1), width))
            if held is not None:
                now = tuple(np.concatenate([x, y]) for x, y in zip(held, now, strict=True))
            keys, cells, rows = now
            last = int(np.flatnonzero((keys != keys[-1]) | (cells != cells[-1]))[-1]) + 1 if (keys[0], cells[0]) != (keys[-1], cells[-1]) else 0
            held = (keys[last:], cells[last:], rows[last:])
            if last and (out := linked(keys[:last], cells[:last], rows[:last])) is not None:
                yield out
        if held is not None and (out := linked(*held)) is not None:
            yield out

    return dealt.select("key", "fingerprint", "cell").mapInArrow(run, "u binary, v binary")


def near_duplicates(docs: DataFrame, words: int = 3, most: int = 3, blocks: int = 1, most_total: int | None = None, bucket_rows: int = 2000) -> DataFrame:
    """Every document's fingerprint and group.

    docs: doc_id, text; other columns are ignored. Two fingerprints link if in one of their blocks at most
    `most` (below 8) bits differ and, with more blocks, at most most_total bits differ over all. Returns doc_id, fingerprint
    (lower-case hex), component_id: the smallest doc_id that links reach, itself included (null if all there
    are null). Null and empty texts have the fingerprint zero and link like any other; repeated rows give
    repeated rows; an empty table gives an empty table.
    """
    prints = staged(fingerprints(docs, words, blocks))
    nodes = staged(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    links = bucket_links(chain_keys(nodes, blocks, most), blocks, most, most_total or most, bucket_rows)
    roots = staged(components(links))
    grouped = nodes.join(roots, nodes["fingerprint"] == roots["node"]).select("fingerprint", "least", "root")
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    joined = grouped.join(least, "root").select(F.col("fingerprint").alias("_node"), "component_id")
    alone = nodes.join(roots, nodes["fingerprint"] == roots["node"], "left_anti").select(F.col("fingerprint").alias("_node"), F.col("least").alias("component_id"))
    groups = joined.unionByName(alone)
    found = prints.join(groups, prints["fingerprint"] == groups["_node"])
    return found.select("doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id (without one only if no other is there).

    Near copies are texts whose sets of shingles (five words) have a Jaccard of `least` or more; fingerprints don't decide. Rows of one doc_id
    whose texts are no near copies all stay; if they are near copies, the one with the least hash of its text stays, and of rows equal in
    doc_id and text the one whose other columns come first as JSON. Null and empty texts are one group. All columns of docs are kept;
    an empty table gives an empty table.
    """
    from lodestrand.llm import near_copies  # which builds on this module

    groups = near_copies.similar_groups(docs, words, least)
    by = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    first = groups.groupBy("component").agg(F.min(by).alias("b")).select(F.col("b.doc_id").alias("id"), F.col("b.text_key").alias("key"))
    repeated = groups.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.count("*").alias("n"))
    stay = staged(first.join(repeated, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))).select("id", "key", "n"))
    discard(groups)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))  # whole rows: their names can't clash
    rows = rows.withColumn("_key", near_copies.text_key(F.col("row.text")))
    met = F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("_key") == F.col("key"))
    kept = rows.join(stay.where("n = 1"), met, "left_semi").select("row.*")
    more = stay.where("n > 1")
    if more.isEmpty():
        return kept
    place = F.row_number().over(Window.partitionBy("id", "key").orderBy(F.to_json("row")))
    return kept.unionByName(rows.join(more, met).withColumn("place", place).where("place = 1").select("row.*"))
