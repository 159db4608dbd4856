"""Edit-aware token counts.

Every document keeps a segment tree. Its leaves are runs of whole pre-tokens, its nodes the sums of characters
and tokens below. An edit finds its leaves by the sums, and only those, with the run before where their first
pre-token may have changed, are encoded again; then the sums above them are updated. The trees are a table (the leaves'
texts and counts of each document): a batch of edits reads it, encodes what the edits touch, and gives the table for the next batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.byte_bpe import SAFE_CUT, segments, tiktoken_codec

LEAF = 256


class TokenTree:
    """The text of one document under edits, with its token count."""

    def __init__(self, texts: list[str], encode, leaf: int = LEAF, counts: list[int] | None = None):
        """counts: the leaves' token counts, where they are known; else every leaf is encoded."""
        self.encode, self.leaf, self.encoded_chars = encode, leaf, 0
        self._build(texts, [self._count(x) for x in texts] if counts is None else counts)

    @classmethod
    def of(cls, text: str, encode, leaf: int = LEAF) -> TokenTree:
        return cls(list(segments(text, leaf)), encode, leaf)

    def _build(self, texts: list[str], counts: list[int]) -> None:
        self.texts = texts
        self.size = 1 << max(0, len(texts) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, (x, n) in enumerate(zip(texts, counts, strict=True)):
            self.chars[self.size + i], self.tokens[self.size + i] = len(x), n
        for node in range(self.size - 1, 0, -1):
            self._sum(node)

    def leaves(self) -> tuple[list[str], list[int]]:
        """Texts and token counts of the leaves that hold text (one leaf at least)."""
        both = [(x, n) for x, n in zip(self.texts, self.tokens[self.size :], strict=False) if x] or [("", 0)]
        return [x for x, _ in both], [n for _, n in both]

    def _count(self, text: str) -> int:
        self.encoded_chars += len(text)
        return len(self.encode(text)) if text else 0

    def _sum(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def _put(self, at: int, text: str) -> None:
        self.texts[at] = text
        node = self.size + at
        self.chars[node], self.tokens[node] = len(text), self._count(text)
        while node > 1:
            node //= 2
            self._sum(node)

    def _leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds the character at position (or the last), and where it starts."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if position >= start + self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return node - self.size, start

    def _filled_before(self, at: int) -> int | None:
        return next((i for i in range(at - 1, -1, -1) if self.texts[i]), None)

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(self.texts)

    def edit(self, position: int, removed: int, inserted: str) -> None:
        """Replace `removed` characters from position by `inserted`; both are cut to the text."""
        position = min(max(position, 0), self.chars[1])
        removed = min(max(removed, 0), self.chars[1] - position)
        if not removed and not inserted:
            return
        first, start = self._leaf_at(position)
        last = self._leaf_at(position + removed - 1)[0] if removed else first
        last = max(first, last)
        whole = "".join(self.texts[first : last + 1])
        whole = whole[: position - start] + inserted + whole[position - start + removed :]
        # a run must begin where a pre-token always begins: else it joins the run before; so must the run after
        while (before := self._filled_before(first)) is not None and not SAFE_CUT.match(whole):
            whole, first = self.texts[before] + whole, before
        after = next((i for i in range(last + 1, len(self.texts)) if self.texts[i]), None)
        if after is not None and not SAFE_CUT.match(self.texts[after]):
            whole, last = whole + self.texts[after], after
        if len(whole) > 16 * self.leaf and SAFE_CUT.search(whole, self.leaf):  # the run outgrew its leaf: deal the text anew, and keep known counts
            self._rebuild(first, last, whole)
            return
        for i in range(first + 1, last + 1):
            if self.texts[i]:
                self._put(i, "")
        self._put(first, whole)

    def _rebuild(self, first: int, last: int, whole: str) -> None:
        fresh = list(segments(whole, self.leaf))
        counts = [self._count(x) for x in fresh]
        texts = self.texts[:first] + fresh + self.texts[last + 1 :]
        kept = self.tokens[self.size : self.size + len(self.texts)]
        tokens = kept[:first] + counts + kept[last + 1 :]
        both = [(x, n) for x, n in zip(texts, tokens, strict=True) if x] or [("", 0)]
        self._build([x for x, _ in both], [n for _, n in both])


EDIT = "array<struct<position:bigint,removed:bigint,inserted:string>>"


TREE = "leaves array<string>, counts array<int>"


def build_trees(docs: DataFrame, ranks_path: str, pattern: str, leaf: int = LEAF) -> DataFrame:
    """doc_id, leaves, counts: the tree of every whole text (null: empty) as a row. Repeated rows give repeated rows; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tiktoken_codec(ranks_path, pattern).encoding.encode_ordinary
        for batch in batches:
            leaves = [list(segments(x.as_py() or "", leaf)) for x in batch.column(1)]
            counts = [[len(encode(x)) for x in y] for y in leaves]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(leaves, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int32()))], ["doc_id", "leaves", "counts"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {TREE}")


def apply_edits(trees: DataFrame, ranks_path: str, pattern: str, leaf: int = LEAF) -> DataFrame:
    """The trees after their edits, and what that took. Only leaves that an edit touches, with the context their ends need, are encoded.

    trees: doc_id, leaves, counts (of build_trees, or of an apply_edits before), edits (array of position, removed, inserted: in
    order, in characters of the text as the edits before left it); other columns are ignored. Positions and lengths are cut to the text; a null edit,
    or one with a null position, changes nothing; a null length removes nothing, a null insertion inserts nothing; null edits are none.
    Repeated rows give repeated rows; an empty table gives an empty table. Returns doc_id, leaves, counts, n_tokens (before),
    edited_tokens, n_edits, encoded_again (characters that the edits made encode again), edited_chars.
    """
    names = ["n_tokens", "edited_tokens", "n_edits", "encoded_again", "edited_chars"]
    ddl = f"doc_id {trees.schema['doc_id'].dataType.simpleString()}, {TREE}, " + ", ".join(f"{x} long" for x in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tiktoken_codec(ranks_path, pattern).encoding.encode_ordinary
        for batch in batches:
            rows, kept = [], []
            for leaves, counts, edits in zip(*(batch.column(i) for i in (1, 2, 3)), strict=True):
                tree = TokenTree(leaves.as_py(), encode, leaf, counts.as_py())
                n, done = tree.n_tokens, 0
                for edit in edits.as_py() or []:
                    if edit and edit["position"] is not None:
                        tree.edit(edit["position"], edit["removed"] or 0, edit["inserted"] or "")
                        done += 1
                rows.append((n, tree.n_tokens, done, tree.encoded_chars, tree.chars[1]))
                kept.append(tree.leaves())
            numbers = np.array(rows, dtype=np.int64).reshape(-1, len(names))
            new = [pa.array([x for x, _ in kept], pa.list_(pa.string())), pa.array([n for _, n in kept], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *new, *(pa.array(numbers[:, i]) for i in range(len(names)))], ["doc_id", "leaves", "counts", *names])

    return trees.select("doc_id", "leaves", "counts", F.col("edits").cast(EDIT)).mapInArrow(run, ddl)


def with_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """trees with the edits of a table (doc_id, seq, position, removed, inserted) as the array that apply_edits takes."""
    of = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "position", "removed", "inserted"))).alias("_all"))
    told = of.select("doc_id", F.transform("_all", lambda e: F.struct(e["position"].alias("position"), e["removed"].alias("removed"), e["inserted"].alias("inserted"))).alias("edits"))
    return trees.drop("edits").join(told, "doc_id", "left")
