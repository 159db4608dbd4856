"""Packing documents into training windows by best-fit decreasing.

Overlong documents are first cut into full windows. What goes where depends on the lengths alone, so the
placement is computed from the histogram of piece lengths (one count per length up to the window: its
size does not grow with the data), with a segment tree over remaining capacity that finds the tightest
open window. Each piece then finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.byte_bpe import encode_texts, tokenizers_codec
from lodestrand.llm.memory import give_back
from lodestrand.storage import staged, with_rank


HELD = 1 << 18


class CapacityTree:
    """A segment tree over the capacities 0..top that marks those with open windows."""

    def __init__(self, top: int):
        self.leaves = 1 << top.bit_length()
        self.open = [False] * (2 * self.leaves)

    def mark(self, capacity: int, is_open: bool) -> None:
        node = capacity + self.leaves
        self.open[node] = is_open
        while node > 1:
            node //= 2
            self.open[node] = self.open[2 * node] or self.open[2 * node + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest capacity >= least with an open window."""
        node = least + self.leaves
        if self.open[node]:
            return least
        while node > 1:
            if node % 2 == 0 and self.open[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


def place(counts: dict[int, int], window: int) -> np.ndarray:
    """Best-fit decreasing of counts[length] pieces of each length.

    Rows (length, first rank, pieces, pieces a window, first window, offset): the pieces of that length from
    that rank on go to successive windows, so many to each, from that offset on. Windows are numbered from 0.
    """
    tree, ranges, rows, windows = CapacityTree(window), {}, [], 0

    def put(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            ranges.setdefault(capacity, []).append((first, n))
            tree.mark(capacity, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                fresh = -(-left // (window // length))
                put(window, windows, fresh)
                windows += fresh
                continue
            first, n = ranges[capacity].pop()
            if not ranges[capacity]:
                tree.mark(capacity, False)
            each = capacity // length
            full = min(n, left // each)
            if full:
                rows.append((length, rank, full * each, each, first, window - capacity))
                rank, left = rank + full * each, left - full * each
                put(capacity - each * length, first, full)
            if full < n and left:  # fewer than `each` pieces are left, for one more window
                rows.append((length, rank, left, left, first + full, window - capacity))
                put(capacity - left * length, first + full, 1)
                full, left = full + 1, 0
            put(capacity, first + full, n - full)
    return np.array(rows, dtype=np.int64).reshape(-1, 6)


def tokenized(docs: DataFrame, vocabulary: str, window: int = 2048, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Cut every document's ids, and the end id after them, into full windows and a rest.

    docs: doc_id, text; other columns are ignored. Null text counts as empty, a null doc_id stays null, repeated rows give repeated pieces.
    Ids are those of a plain encode without the added special tokens; where a text holds the letters of a special token, that is its id.
    Returns a row for each piece: doc_id, start, length, ids_crc32, doc_tokens, and with keep_ids the ids. vocabulary: a tokenizers JSON file on every executor.
    """
    ddl = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids
    end = np.array([end_id], dtype="<u4").tobytes()

    def told(docs_: pa.Array, owner: list, start: list, length: list, crc: list, total: list, ids: list) -> pa.RecordBatch:
        columns = [docs_.take(pa.array(owner, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
        if keep_ids:
            ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))))
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = tokenizers_codec(vocabulary)
        for batch in batches:
            owner, start, length, crc, total, ids, held = [], [], [], [], [], [], 0
            for row, found in enumerate(encode_texts(batch.column(1), codec)):
                raw = memoryview(found.astype("<u4").tobytes() + end)
                n = len(raw) // 4
                for at in range(0, n, window):
                    piece = raw[4 * at : 4 * (at + window)]
                    owner.append(row)
                    start.append(at)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
                    if keep_ids:
                        ids.append(piece)
                held += n
                if held >= HELD:  # tokens that a task holds before it passes them on
                    yield told(batch.column(0), owner, start, length, crc, total, ids)
                    owner, start, length, crc, total, ids, held = [], [], [], [], [], [], 0
            if held:
                yield told(batch.column(0), owner, start, length, crc, total, ids)
            give_back()  # what a batch needed for a moment, before the next one needs it elsewhere

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, ddl)


def pack(pieces: DataFrame, window: int = 2048) -> DataFrame:
    """Give each piece (doc_id, start, length <= window, ids_crc32, ...) its sequence_id and offset.

    Pieces that are equal in all of doc_id, start and ids_crc32 are alike, so either order of them is the
    same result. An empty table gives an empty table.
    """
    pieces = staged(pieces)
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row for each length up to the window
    plan = place(counts, window)
    first = {}
    for at, length in enumerate(plan[:, 0].tolist()):
        first.setdefault(length, at)
    order = [F.col("doc_id"), F.col("start"), F.col("ids_crc32")]
    ranked = with_rank(pieces, "length", order, counts)
    # ranks and lengths in one key: successive lengths lie far apart, so one sorted search finds the row of the plan
    lengths = np.array(sorted(counts), dtype=np.int64)
    base = np.concatenate([[0], np.cumsum([counts[int(x)] for x in lengths])]).astype(np.int64)
    key = base[np.searchsorted(lengths, plan[:, 0])] + plan[:, 1]
    by_key = np.argsort(key, kind="stable")
    plan, key = plan[by_key], key[by_key]
    names = ranked.columns
    length_at, rank_at = names.index("length"), names.index("rank")
    kept = [i for i, name in enumerate(names) if name != "rank"]

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(length_at).to_numpy(zero_copy_only=False)
            mine = base[np.searchsorted(lengths, length)] + batch.column(rank_at).to_numpy(zero_copy_only=False)
            row = plan[np.searchsorted(key, mine, side="right") - 1]
            inside = mine - base[np.searchsorted(lengths, length)] - row[:, 1]
            sequence, offset = row[:, 4] + inside // row[:, 3], row[:, 5] + inside % row[:, 3] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(sequence), pa.array(offset)], [*(names[i] for i in kept), "sequence_id", "offset"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(locate, f"{ddl}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, window: int = 2048, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Tokenize and pack whole documents; see tokenized() and pack()."""
    return pack(tokenized(docs, vocabulary, window, end_id, keep_ids), window)
