"""Byte-level BPE encoding and decoding with a local vocabulary file.

A text is cut before every space that a non-space follows. The split pattern always starts a new match
there, so the pieces are encoded apart, equal pieces of a batch once, and common ones once in a worker.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: where a text may be cut without changing any match of the split pattern.
SAFE_CUT = re.compile(r" (?=\S)")
#: Characters of a long text, and bytes of a batch of texts, that are handled at a time.
SEGMENT, BATCH_BYTES, JOINED = 1 << 15, 8 << 20, 32
#: Pieces whose ids a worker keeps (about 40 bytes each).
KNOWN = 1 << 18


def segments(text: str, size: int = SEGMENT, safe: re.Pattern = SAFE_CUT) -> Iterator[str]:
    """Cut a long text at safe places about every `size` characters."""
    start = 0
    while len(text) - start > size:
        cut = safe.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def _joined(pieces: pa.Array, each: int) -> list[str]:
    """Texts of so many pieces, a space before each piece."""
    ends = np.append(np.arange(0, len(pieces), each), len(pieces)).astype(np.int32)
    return [" " + x for x in pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), pieces), " ").to_pylist()]


class TiktokenCodec:
    """The tiktoken library with a rank file."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.known = KnownPieces()
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.token_bytes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.token_bytes[rank] = len(token)

    def encode(self, text: str) -> np.ndarray:
        return np.concatenate([np.asarray(self.encoding.encode_ordinary(x), dtype=np.uint32) for x in segments(text)])

    def encode_joined(self, pieces: pa.Array) -> np.ndarray:
        """The ids of the pieces, a space before each."""
        return np.concatenate([np.asarray(self.encoding.encode_ordinary(x), dtype=np.uint32) for x in _joined(pieces, 4096)])

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)


class TokenizersCodec:
    """The tokenizers library with a byte-level vocabulary; the letters of a special token in a text are that token."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; each thread of the library would keep memory of its own
        self.known = KnownPieces()
        self.tokenizer = Tokenizer.from_file(path)
        special = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.safe = re.compile(rf" (?=\S)(?!(?:{special}))" if special else SAFE_CUT.pattern)  # white space before a special token ends a text of its own
        vocabulary = self.tokenizer.get_vocab()
        self.token_bytes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, rank in vocabulary.items():
            self.token_bytes[rank] = len(token)  # a character stands for a byte

    def encode(self, text: str) -> np.ndarray:
        return np.concatenate([np.asarray(self.tokenizer.encode(x, add_special_tokens=False).ids, dtype=np.uint32) for x in segments(text, safe=self.safe)])

    def encode_joined(self, pieces: pa.Array) -> np.ndarray:
        groups = _joined(pieces, JOINED)
        found: list[np.ndarray] = []
        for i in range(0, len(groups), 256):  # the library's results are far larger than the ids, so those of one part are held
            found += [np.asarray(x.ids, dtype=np.uint32) for x in self.tokenizer.encode_batch_fast(groups[i : i + 256], add_special_tokens=False)]
        return np.concatenate(found)


@cache
def tiktoken_codec(path: str, pattern: str) -> TiktokenCodec:
    """A worker's own codec, kept between its tasks."""
    return TiktokenCodec(path, pattern)


@cache
def tokenizers_codec(path: str) -> TokenizersCodec:
    return TokenizersCodec(path)


def _slices(column: pa.Array, most: int = BATCH_BYTES) -> Iterator[pa.Array]:
    """Slices of about `most` bytes of text (one row at least)."""
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(column):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield column.slice(start, end - start)
        start = end


def _spaced(pieces: pa.Array, codec) -> pa.ListArray:
    """The ids of each piece (none is empty or starts with white space) with a space before it."""
    ids = codec.encode_joined(pieces) if len(pieces) else np.zeros(0, np.uint32)
    byte_ends = np.cumsum(pc.binary_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    ends = np.searchsorted(np.cumsum(codec.token_bytes[ids]), byte_ends, side="left") + 1  # the token that ends a piece
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))


class KnownPieces:
    """The ids of pieces that a worker has met, in two flat Arrow arrays: the first `most` of them, and short ones only."""

    def __init__(self, most: int = KNOWN, longest: int = 64):
        self.most, self.longest = most, longest
        self.pieces, self.ids = pa.array([], pa.string()), pa.array([], pa.list_(pa.uint32()))

    def find(self, pieces: pa.Array, wanted: np.ndarray, codec) -> tuple[pa.ListArray, np.ndarray]:
        """A table of ids, and the row of each wanted piece there (others: no row that is of use). What isn't known is encoded, and kept while there is room."""
        at = pc.fill_null(pc.index_in(pieces, value_set=self.pieces), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero((at < 0) & wanted)
        fresh = pieces.take(pa.array(new))
        ids = _spaced(fresh, codec)
        at[new] = len(self.pieces) + np.arange(len(new))
        table = pa.concat_arrays([self.ids, ids])
        room = self.most - len(self.pieces)
        if room > 0 and len(new):
            kept = pa.array(np.flatnonzero(pc.binary_length(fresh).to_numpy(zero_copy_only=False) <= self.longest)[:room])
            self.pieces, self.ids = pa.concat_arrays([self.pieces, fresh.take(kept)]), pa.concat_arrays([self.ids, ids.take(kept)])
        return table, at


def _encode_slice(column: pa.Array, codec) -> Iterator[np.ndarray]:
    split = pc.split_pattern(column, " ")
    starts = split.offsets.to_numpy()
    pieces = split.flatten().dictionary_encode()
    at = pieces.indices.to_numpy(zero_copy_only=False)
    starts = starts - starts[0]
    unique = pieces.dictionary
    unsafe = pc.or_(pc.equal(unique, ""), pc.utf8_is_space(pc.utf8_slice_codeunits(unique, 0, 1))).to_numpy(zero_copy_only=False)
    first = np.zeros(len(at), dtype=bool)
    first[starts[:-1]] = True
    odd = np.logical_or.reduceat(unsafe[at] & ~first, starts[:-1])  # here a space is followed by white space or the end
    table, known = codec.known.find(unique, ~unsafe, codec)
    for row in range(len(column)):
        if odd[row]:
            yield codec.encode(column[row].as_py())
            continue
        lo, hi = starts[row], starts[row + 1]
        head = unique[at[lo]].as_py()
        rest = table.take(pa.array(known[at[lo + 1 : hi]])).flatten().to_numpy() if hi > lo + 1 else np.zeros(0, np.uint32)
        yield np.concatenate([codec.encode(head), rest]) if head else rest


def encode_texts(column: pa.Array, codec) -> Iterator[np.ndarray]:
    """The ids (uint32) of each whole text; null counts as empty."""
    column = pc.fill_null(column.cast(pa.string()), "")
    for part in _slices(column):
        yield from _encode_slice(part, codec)


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again.

    docs: doc_id, text; other columns are ignored. Null text counts as empty (no ids), repeated rows give
    repeated rows, an empty table gives an empty table, and texts of any length are encoded whole.
    Returns doc_id, n_tokens, ids_sha256, decoded_sha256, and with keep_ids the ids and the decoded bytes.
    The rank file is a path that every executor has (it is part of an installed package).
    """
    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    ddl = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        fields += [("ids", pa.list_(pa.int32())), ("decoded", pa.binary())]
        ddl += ", ids array<int>, decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = tiktoken_codec(ranks_path, pattern)
        written = list(map(str, range(len(codec.token_bytes))))
        for batch in batches:
            rows: list[list] = [[] for _ in fields]
            for found in encode_texts(batch.column(1), codec):
                ids = found.tolist()
                decoded = codec.decode(ids)
                row = [len(ids), hashlib.sha256(" ".join(map(written.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()]
                for column, value in zip(rows, row + [ids, decoded] * keep_ids, strict=True):
                    column.append(value)
            made = [pa.array(x, kind) for x, (_, kind) in zip(rows, fields, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["doc_id", *(name for name, _ in fields)])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, ddl)
