"""Groups of texts by the exact Jaccard similarity of their shingle sets, without comparing all pairs.

SimHash fingerprints that meet by the pigeonring filter (see simhash) link texts first; each such link is confirmed on the whole sets. Sets may have the
similarity while their fingerprints are further apart, so what is still in different components then meets in an exact way, by prefixes. Two sets with a similarity of t share one of their first n - ceil(t * n) + 1 members in any one order of all members,
so that prefix is all that is sent to find candidates, and none is lost. Members known from a sample to be frequent
come last in the order, so buckets stay small; what the sample misses is only slower. Up to where both prefixes reach, two prefixes
tell what the sets share and what not, which bounds the whole overlap and rules out most candidates, again without loss. Every link that is
left is confirmed on the whole sets (64-bit hashes of shingles), which are made only for its ends. Equal sets are one node. Nodes meet a centre of their
bucket, which is done with the bucket then; after that only nodes that links don't join yet meet each other. The centre is a node that has the bucket's member
earliest in its prefix: of copies that were each changed elsewhere, the one with the fewest members of its own, which is near to most others.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.llm import simhash
from lodestrand.llm.memory import giving_back
from lodestrand.llm.shingles import shingle_hashes
from lodestrand.operators.graph import components
from lodestrand.storage import discard, staged

SLACK = 1e-9
#: How many frequent members the tasks know, and how often large buckets meet a centre before all that is left meets.
FREQUENT, STAR_ROUNDS = 200_000, 4
#: Nodes of a bucket that meet in one task.
CHUNK = 2000
#: Nodes that are sent to every task, so that a larger table that is joined with them isn't shuffled.
FEW = 1 << 17


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text or b"", words))


def _small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that a task holds the sets of few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def digest(members: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(members.tobytes())


def text_key(text: Column) -> Column:
    """A hash of a text (null: empty) that tells rows apart when their texts are fetched again; never decides on likeness."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_key(F.col("text")).alias("text_key"), F.col("text").cast("string").cast("binary").alias("text"))


def _frequent(docs: DataFrame, words: int, share: int, least: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Members that `least` or more documents of a share-th part of the documents have, sorted, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(2):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text.as_py(), words).view(np.int64))], ["member"])

    part = docs.where(F.pmod(F.xxhash64("doc_id", text_key(F.col("text")), F.lit(7)), F.lit(share)) == 0)
    counts = _texts(part).mapInArrow(run, "member long").groupBy("member").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    rows = counts.orderBy(F.col("n").desc(), "member").limit(FREQUENT).toPandas()  # FREQUENT rows at most
    members, n = rows["member"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    order = np.argsort(members)
    return members[order], n[order]


def prefixes(docs: DataFrame, words: int, least: float, known: np.ndarray, counts: np.ndarray) -> DataFrame:
    """doc_id, text_key, digest, n (size of the set), prefix (its first members, 8 bytes each), fingerprint (as by simhash.fingerprints) of every whole text."""

    def first(members: np.ndarray) -> bytes:
        if not len(members):
            return b""
        if len(known):
            at = np.minimum(np.searchsorted(known, members), len(known) - 1)
            members = members[np.lexsort((members, np.where(known[at] == members, counts[at], 0)))]
        return members[: len(members) - int(np.ceil(least * len(members) - SLACK)) + 1].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            hashes = [shingle_hashes(text.as_py() or b"", words) for text in batch.column(2)]
            bits = np.concatenate([simhash.majority_bits(x, np.array([len(x)])) for x in hashes])
            sets = [np.unique(x) for x in hashes]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([digest(x) for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int32()), pa.array([first(x) for x in sets], pa.binary()), simhash.packed(bits)],
                ["doc_id", "text_key", "digest", "n", "prefix", "fingerprint"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _texts(docs).mapInArrow(giving_back(run), f"doc_id {kind}, text_key long, digest binary, n int, prefix binary, fingerprint binary")


def _bucket_rows(nodes: DataFrame) -> DataFrame:
    """key, node, n, at, root: a row for each member of a node's prefix; at is its place, from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, n, prefix, root in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                keys = np.frombuffer(prefix, dtype=np.int64)
                made = [keys, np.full(len(keys), node, np.int64), np.full(len(keys), n, np.int32), np.arange(1, len(keys) + 1, dtype=np.int32), np.full(len(keys), root, np.int64)]
                if len(keys):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], ["key", "node", "n", "at", "root"])

    return nodes.select("node", "n", "prefix", "root").mapInArrow(run, "key long, node long, n int, at int, root long")


def fingerprint_pairs(nodes: DataFrame, most: int) -> DataFrame:
    """u, v: nodes whose fingerprints differ in at most `most` bits, as stars. nodes: node, fingerprint.

    Nodes of one fingerprint meet the least of them; fingerprints meet as simhash.near_duplicates links them, each as the least of its nodes.
    """
    kinds = staged(nodes.groupBy("fingerprint").agg(F.min("node").alias("first"), F.count("*").alias("size")))
    links = simhash.bucket_links(simhash.chain_keys(kinds, 1, most), 1, most, most, CHUNK).distinct()
    u, v = (kinds.select(F.col("fingerprint").alias(x), F.col("first").alias(f"f{x}")) for x in ("u", "v"))
    same = nodes.join(kinds.where("size > 1"), "fingerprint").where("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v"))
    far = links.join(u, "u").join(v, "v").select(F.least("fu", "fv").alias("u"), F.greatest("fu", "fv").alias("v"))
    return same.unionByName(far)


def _few(table: DataFrame) -> DataFrame:
    """A staged table of a few narrow columns, sent to every task if it is small."""
    return F.broadcast(table) if table.limit(FEW + 1).count() <= FEW else table


def _ends(pairs: DataFrame) -> DataFrame:
    """node: the ends of the pairs."""
    return pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()


def _may_reach(n: str, at: str, m: str, where: str, least: float):
    """Whether sizes and the places of the first shared member allow the similarity. No pair that has it is refused at that member."""
    needed = F.lit(least / (1 + least)) * (F.col(n) + F.col(m))
    return (F.least(n, m) >= F.lit(least) * F.greatest(n, m) - SLACK) & (1 + F.least(F.col(n) - F.col(at), F.col(m) - F.col(where)) >= needed - SLACK)


def confirmed(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """u, v: the pairs whose sets have the similarity. pairs: u, v; sets: node, members (sorted, 8 bytes each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for row, (a, b) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                a, b = (np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in (a, b))
                shared = len(np.intersect1d(a, b, assume_unique=True))
                keep[row] = shared >= least * (len(a) + len(b) - shared) - SLACK
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], ["u", "v"])

    left, right = (sets.select(F.col("node").alias(x), F.col("members").alias(f"m{x}")) for x in ("u", "v"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "mu", "mv").mapInArrow(giving_back(run), "u long, v long")


def reachable(a: np.ndarray, b: np.ndarray, n: int, m: int, known: np.ndarray, least: float) -> bool:
    """Whether sets of n and m members with these prefixes may have the similarity.

    Members that aren't known to be frequent come in the order of their hashes, so up to the lesser of the two prefixes' ends both sets are told in
    full: they share there what their prefixes share, and elsewhere at most the rest of either.
    """
    ends = []
    for x in (a, b):
        common = known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)
        ends.append(np.uint64(2**64 - 1) if common.any() else x[-1])  # a prefix that comes to frequent members holds all others
        x = x[~common]
        a, b = (x, b) if len(ends) == 1 else (a, x)
    a, b = a[a <= min(ends)], b[b <= min(ends)]
    most = len(np.intersect1d(a, b, assume_unique=True)) + min(n - len(a), m - len(b))
    return most >= least / (1 + least) * (n + m) - SLACK


def pruned(pairs: DataFrame, nodes: DataFrame, known: np.ndarray, least: float) -> DataFrame:
    """u, v: the pairs that their prefixes don't rule out. nodes: node, n, prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 4))
            keep = [reachable(np.frombuffer(batch.column(3)[i].as_buffer(), np.uint64), np.frombuffer(batch.column(5)[i].as_buffer(), np.uint64), int(n[i]), int(m[i]), known, least) for i in range(batch.num_rows)]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(mask) for i in (0, 1)], ["u", "v"])

    side = lambda x, n, p: nodes.select(F.col("node").alias(x), F.col("n").alias(n), F.col("prefix").alias(p))
    return pairs.join(side("u", "n", "pu"), "u").join(side("v", "m", "pv"), "v").select("u", "v", "n", "pu", "m", "pv").mapInArrow(run, "u long, v long")


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node, members of the wanted nodes (a table of node, digest, sample: the text_key and doc_id of a row that has it). Only whole texts that are wanted are hashed, where they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            sets = [shingle_set(text.as_py(), words) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([pa.array([digest(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], ["digest", "members"])

    sampled = wanted.select(F.col("sample.text_key").alias("_key"), F.col("sample.doc_id").alias("_id"))
    texts = _texts(docs).join(_few(sampled), (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    found = texts.mapInArrow(giving_back(run), "digest binary, members binary").join(_few(wanted.select("digest", "node")), "digest")
    return found.groupBy("node").agg(F.first("members").alias("members"))


def _pairs(rows: DataFrame, least: float) -> DataFrame:
    """u, v: pairs of nodes of a bucket that have different roots and may reach the similarity.

    A bucket's nodes are dealt to chunks by its size, and each pair of chunks meets in a task of its own.
    """
    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    dealt = rows.withColumn("_mine", F.pmod(F.xxhash64("node"), chunks).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    dealt = dealt.withColumns({"_low": F.least("_mine", "_other"), "_high": F.greatest("_mine", "_other")})
    a = dealt.select("key", "_low", "_high", F.col("node").alias("u"), "n", "at", F.col("root").alias("ru"), F.col("_mine").alias("mu"))
    b = dealt.select("key", "_low", "_high", F.col("node").alias("v"), F.col("n").alias("m"), F.col("at").alias("place"), F.col("root").alias("rv"), F.col("_mine").alias("mv"))
    met = a.join(b, ["key", "_low", "_high"]).where((F.col("u") < F.col("v")) & (F.col("ru") != F.col("rv"))).where(_may_reach("n", "at", "m", "place", least))
    return met.where((F.col("_low") == F.col("_high")) | (F.col("mu") != F.col("mv"))).select("u", "v")


def _told(rows: DataFrame, **facts: Column) -> DataFrame:
    """A row for each bucket that holds more than one node. Tasks sum up before the shuffle, and the join with the rows can be split, so no bucket passes through one task."""
    return rows.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("size"), *(c.alias(k) for k, c in facts.items())).where("size > 1")


def _open(rows: DataFrame) -> DataFrame:
    """The rows (key, node, n, at, root) of buckets that hold nodes of different roots, with size and c, the bucket's centre."""
    centre = F.min(F.struct("at", F.xxhash64("node").alias("h"), "node", "n", "root"))
    told = _told(rows, low=F.min("root"), high=F.max("root"), c=centre).where("low < high").select("_key", "size", "c")
    return staged(rows.join(told, F.col("key") == F.col("_key")).select("key", "node", "n", "at", "size", "root", "c"))


def similar_groups(docs: DataFrame, words: int = 5, least: float = 0.8, direct: int = 256, most: int = 3) -> DataFrame:
    """doc_id, text_key, component of every row: a number that the rows which links reach share.

    docs: doc_id, text; other columns are ignored. Two texts link if the sets of their shingles have a Jaccard of
    `least` or more. Texts without a word have the empty set and are one group. Nodes whose fingerprints differ in at most `most` bits meet first. Then
    the nodes of a bucket of a prefix's member meet one of them, in buckets of more than `direct` nodes up to STAR_ROUNDS more of them (smaller ones wait
    meanwhile), and then those of other components: the components are the same as by all pairs. The result is a table of its own.
    """
    known, counts = _frequent(docs, words, 16)
    prints = staged(prefixes(docs, words, least, known, counts))
    nodes = prints.groupBy("digest").agg(F.min(F.struct("text_key", "doc_id")).alias("sample"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.min("fingerprint").alias("fingerprint"))
    nodes = staged(nodes.withColumn("node", F.monotonically_increasing_id()))
    held: list[DataFrame] = []  # the sets of nodes that were ends of a pair so far

    def links_of(pairs: DataFrame) -> DataFrame:
        pairs = staged(pairs)
        ends = staged(_ends(pairs))
        new = staged(reduce(lambda x, sets: x.join(sets.select("node"), "node", "left_anti"), held, ends))
        wanted = staged(nodes.select("node", "digest", "sample").join(_few(new), "node", "left_semi"))
        if not wanted.isEmpty():
            held.append(staged(_sets(docs, wanted, words)))
        sets = reduce(DataFrame.unionByName, held).join(_few(ends), "node", "left_semi") if held else None
        found = staged(confirmed(pairs, sets, least) if held else pairs)  # without sets there are no pairs
        for table in (pairs, ends, new, wanted):
            discard(table)
        return found

    def near(pairs: DataFrame) -> DataFrame:
        pairs = staged(pairs.distinct())
        ends = staged(_ends(pairs))
        found = links_of(pruned(pairs, nodes.join(_few(ends), "node", "left_semi"), known, least))
        discard(pairs)
        discard(ends)
        return found

    def stars(rows: DataFrame) -> DataFrame:
        """u, v: each node of a bucket and its centre."""
        met = rows.where("node <> c.node and root <> c.root").where(_may_reach("n", "at", "c.n", "c.at", least))
        return met.select(F.col("node").alias("u"), F.col("c.node").alias("v"))

    links = links_of(fingerprint_pairs(nodes, most))
    roots = staged(components(links))

    def joined(found: DataFrame) -> bool:
        """Take the links that were found in; whether there are any."""
        nonlocal links, roots
        before = [found]
        if some := not found.isEmpty():
            before += [links, roots]
            links = staged(links.unionByName(found))
            roots = staged(components(links))
        for table in before:
            discard(table)
        return some

    def rooted(table: DataFrame) -> DataFrame:
        return table.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def still_open(rows: DataFrame) -> DataFrame:
        now = staged(rooted(rows.select("key", "node", "n", "at")))  # _open reads it twice
        found = _open(now)
        discard(now)
        return found

    made = staged(_bucket_rows(rooted(nodes.select("node", "n", "prefix"))))
    apart = made.groupBy(F.col("key").alias("_key")).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("_key")
    members = staged(made.join(apart, F.col("key") == F.col("_key")).drop("_key"))
    discard(made)
    rows = _open(members)
    discard(members)
    joined(near(stars(rows)))
    kept = [still_open(rows.where("node <> c.node"))]  # a centre has met all of its bucket
    discard(rows)
    moved = False
    for _ in range(STAR_ROUNDS):  # of large buckets only: the others wait for the last step
        large = kept[-1].where(F.col("size") > direct)
        if large.isEmpty():
            break
        moved |= joined(near(stars(large)))
        kept.append(still_open(large.where("node <> c.node")))
    rows = reduce(DataFrame.unionByName, [x.where(F.col("size") <= direct) for x in kept[:-1]], kept[-1])
    if moved:
        kept.append(rows := still_open(rows))
    if not rows.isEmpty():
        joined(near(_pairs(rows, least)))
    groups = rooted(nodes.select("digest", "node")).select("digest", F.col("root").alias("component"))
    groups = staged(prints.select("doc_id", "text_key", "digest").join(groups, "digest").drop("digest"))
    for table in (*kept, *held, links, roots, nodes, prints):
        discard(table)
    return groups
