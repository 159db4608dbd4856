"""Repair of conversations: the cheapest edits after which roles read system, then user and assistant in turn.

Roles are a walk through a small grammar. A recursive query in DuckDB takes the conversations of a hash-partitioned batch
together: each recursion moves all of them on by one turn and keeps, for each state of the grammar, the least cost and the least
audit of that cost. A conversation longer than a batch allows is cut into runs of turns. Each run is walked from every
state, which gives a table of moves like that of a single turn, and runs are walked in the same way until one is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrand.storage import staged

#: White space, costs of the edits, and the grammar of role initials: start, after a system, user, assistant turn.
WHITE = " \t\n\x0b\x0c\r"
DELETE, REROLE, INSERT, CUT_OFF = 2, 1, 5, 5
STATES, ENDS = "0SUA", "0A"
GRAMMAR = {("0", "s"): "S", ("0", "u"): "U", ("S", "u"): "U", ("U", "a"): "A", ("A", "u"): "U"}
#: Turns (a run has no more) and bytes of text up to which a conversation stays whole; rows that one query takes together; runs that are walked at once.
RUN, WHOLE_BYTES, TOGETHER, FAN = 256, 8 << 20, 8192, 8
FACTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _moves() -> pa.Table:
    """What each kind of turn (its initial and d: must go, t: cut off, -: sound) offers in each state; an insertion comes before the turn."""
    rows = []
    for initial in "sua?":
        for fault in "dt-":
            for b in STATES:
                rows.append((initial + fault, b, b, DELETE, "D"))
                before = [(b, 0, "")] + [(e, INSERT, "I") for x in "ua" if (e := GRAMMAR.get((b, x)))]
                edits = [("K", initial, 0), ("R", "u", REROLE), ("R", "a", REROLE)] if fault != "d" else []
                rows += [(initial + fault, b, e, c + cost + CUT_OFF * (fault == "t"), first + letter) for m, c, first in before for letter, x, cost in edits if (e := GRAMMAR.get((m, x)))]
    return pa.table(dict(zip(("kind", "b", "e", "cost", "audit"), map(list, zip(*rows, strict=True)), strict=True)))


MOVES = _moves()
#: steps: g, i, b, e, cost, audit (what the i-th element of g offers); starts: g, b.
WALK = """CREATE OR REPLACE TEMP TABLE walked AS WITH RECURSIVE walk(g, i, b, e, cost, audit) AS (
    SELECT g, 0, b, b, 0::BIGINT, '' FROM starts
    UNION ALL
    SELECT g, i + 1, b, e, best.cost, best.audit FROM (
        SELECT w.g, w.i, w.b, s.e, min({'cost': w.cost + s.cost, 'audit': w.audit || s.audit}) AS best FROM walk w JOIN steps s ON s.g = w.g AND s.i = w.i AND s.b = w.e GROUP BY w.g, w.i, w.b, s.e))
    SELECT walk.g, b, e, cost, audit FROM walk JOIN (SELECT g, max(i) + 1 AS n FROM steps GROUP BY g) sizes ON sizes.g = walk.g AND walk.i = sizes.n"""
#: The least of the walks that end well, an insertion at the end included.
ENDED = f"SELECT g, min({{'cost': cost, 'audit': audit}}) AS best FROM (SELECT g, b, e, cost, audit FROM walked UNION ALL SELECT g, b, 'A', cost + {INSERT}, audit || 'I' FROM walked WHERE e = 'U') WHERE b = '0' AND e IN ('0', 'A') GROUP BY g"
#: turns: g, pos, turn, role, text, initial, blank, truncated.
FAULTS = """CREATE OR REPLACE TEMP TABLE faults AS SELECT g, pos, turn, initial, (row_number() OVER (PARTITION BY g ORDER BY pos) - 1)::INTEGER AS i,
    CASE WHEN blank THEN 'blank' WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN truncated THEN 'truncated' ELSE '' END AS fault FROM turns"""
STEPS = "CREATE OR REPLACE TEMP TABLE steps AS SELECT g, i, b, e, cost, audit FROM faults JOIN moves ON moves.kind = CASE WHEN initial IN ('s', 'u', 'a') THEN initial ELSE '?' END || CASE fault WHEN '' THEN '-' WHEN 'truncated' THEN 't' ELSE 'd' END"
SUMMARY = """SELECT g, CASE WHEN count(turn) = 0 THEN 0 ELSE least(max(turn)::HUGEINT - min(turn) + 1 - count(DISTINCT turn), 9223372036854775807)::BIGINT END AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT *, lag(initial) OVER (PARTITION BY g ORDER BY pos) AS before FROM faults) GROUP BY g"""


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, kept: conversations with known faults, by a checksum of conversation and turn; dropped rows stay with kept false."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    act = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    text = F.when(act == 1, "").when(act == 2, F.regexp_replace(name("text"), "[.!?]", "")).otherwise(name("text"))
    role = F.when(act == 4, "user").otherwise(name("role"))
    made = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (act != 0).alias("kept"), F.when(act == 3, 2).otherwise(1).alias("_times"))
    return made.withColumn("_time", F.explode(F.sequence(F.lit(1), "_times"))).drop("_times", "_time")


def with_signs(rows: DataFrame) -> DataFrame:
    last = F.substring(F.rtrim("text", F.lit(WHITE)), -1, 1)
    return rows.select("conv_id", "turn", "role", "text", "kept", F.substring("role", 1, 1).alias("initial"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"))


def repaired_digest(audit: str, rows: Iterable[tuple[str, str]]) -> str:
    """sha256 of the repaired conversation: the number of turns that remain tells the role of each."""
    odd, n, told, rows = (len(audit) - audit.count("D")) % 2, 0, hashlib.sha256(), iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if (n - odd) % 2 else "user"
        told.update(f"{chr(10) if n else ''}{role}:{text}".encode())
        n += 1
    return told.hexdigest()


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups, with the group's number g and the row's number pos; rows of a group follow each other."""
    held: pa.Table | None = None

    def numbered(table: pa.Table) -> pa.Table:
        new = np.zeros(table.num_rows, bool)
        for key in keys:
            codes = pc.dictionary_encode(table.column(key).combine_chunks(), null_encoding="encode").indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        return table.append_column("g", pa.array(np.cumsum(new))).append_column("pos", pa.array(np.arange(table.num_rows)))

    for batch in batches:
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now])
        if held.num_rows >= TOGETHER or held.nbytes > WHOLE_BYTES:
            found = numbered(held)
            g = found.column("g").to_numpy()
            whole = int(np.searchsorted(g, g[-1]))
            if whole:
                yield found.slice(0, whole)
                held = held.slice(whole)
    if held is not None and held.num_rows:
        yield numbered(held)


def _connected() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
    con.register("moves", MOVES)
    return con


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole conversations."""
    with _connected() as con:
        for table in _whole_groups(batches, ["conv_id"]):
            turns = table.filter(table.column("kept"))
            con.register("turns", turns)
            con.execute(FAULTS)
            con.execute(STEPS)
            con.execute("CREATE OR REPLACE TEMP TABLE starts AS SELECT DISTINCT g, '0' AS b FROM faults")
            con.execute(WALK)
            found = {g: f for g, *f in con.execute(f"SELECT s.*, best.cost, best.audit FROM ({SUMMARY}) s JOIN ({ENDED}) e USING (g)").fetchall()}
            g, first = np.unique(table.column("g").to_numpy(), return_index=True)
            lines = zip(turns.column("role").to_pylist(), turns.column("text").to_pylist(), strict=True)
            rows = []
            for i in g.tolist():  # groups and turns come in the same order
                gaps, blank, duplicate, truncated, illegal, cost, audit = found.get(i, (0, 0, 0, 0, 0, 0, ""))
                rows.append((gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_digest(audit, lines)))
            names = [part.split()[0] for part in FACTS.split(", ")]
            facts = [pa.array(c, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)]
            yield pa.RecordBatch.from_arrays([table.column("conv_id").take(pa.array(first)).combine_chunks(), *facts], ["conv_id", *names])


def _walk_groups(keys: list[str], of_turns: bool):
    """Each group's table of moves, from every state. Elements are turns (kind) or runs (their moves)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _connected() as con:
            for table in _whole_groups(batches, keys):
                con.register("rows", table)
                steps = "SELECT g, (row_number() OVER (PARTITION BY g ORDER BY pos) - 1)::INTEGER AS i, kind FROM rows"
                steps = f"SELECT g, i, b, e, cost, audit FROM ({steps}) JOIN moves USING (kind)" if of_turns else "SELECT g, i, b, e, cost, audit FROM rows"
                con.execute(f"CREATE OR REPLACE TEMP TABLE steps AS {steps}")
                con.execute(f"CREATE OR REPLACE TEMP TABLE starts AS SELECT g, b FROM (SELECT DISTINCT g FROM steps), (VALUES {', '.join(f"('{s}')" for s in STATES)}) states(b)")
                con.execute(WALK)
                told = con.execute("SELECT g, b, e, cost, audit FROM walked").to_arrow_table()
                g, first = np.unique(table.column("g").to_numpy(), return_index=True)
                at = pa.array(first[np.searchsorted(g, told.column("g").to_numpy())])
                yield pa.RecordBatch.from_arrays([*(table.column(k).take(at).combine_chunks() for k in keys), *(told.column(c).combine_chunks() for c in ("b", "e", "cost", "audit"))], [*keys, "b", "e", "cost", "audit"])

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's audit comes before its turns; the digest is made as turns stream past. sha256 can't be cut, so a conversation is read by one task."""

    kind = pa.null()

    def rows() -> Iterator[tuple]:
        nonlocal kind
        for batch in batches:
            kind = batch.column("conv_id").type
            yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text")), strict=True)

    def turns() -> Iterator[tuple[str, str]]:
        nonlocal row
        while (row := next(stream, None)) is not None and row[1] >= 0:
            yield row[2], row[3]

    stream = rows()
    row = next(stream, None)
    while row is not None:
        conv_id, _, _, audit = row
        lines = turns()
        digest = repaired_digest(audit, lines)
        for _ in lines:  # no turn is left; this reads on to the next audit
            pass
        yield pa.RecordBatch.from_arrays([pa.array([conv_id], kind), pa.array([digest])], ["conv_id", "repaired_sha256"])


def _in_order(column: str) -> Column:
    return F.col(column).asc_nulls_first()


def _long(rows: DataFrame, run: int) -> DataFrame:
    """The same for conversations of any length, in runs of `run` turns at most: rows with signs, those that are kept."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    ordered = [_in_order("conv_id"), _in_order("turn"), "role", "text"]
    placed = staged(rows.repartitionByRange(*ordered).sortWithinPartitions(*ordered).withColumn("place", F.monotonically_increasing_id()))
    key = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("key")
    light = placed.select("conv_id", "turn", "place", "initial", "blank", "truncated", key)
    firsts = light.groupBy(F.col("conv_id").alias("of"), F.col("key").alias("of_key")).agg(F.min("place").alias("first"))
    light = light.join(firsts, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key")))
    fault = F.when(F.col("blank"), "blank").when(F.col("place") > F.col("first"), "duplicate").when(F.col("truncated"), "truncated").otherwise("")
    light = staged(light.select("conv_id", "turn", "place", "initial", fault.alias("fault"), F.call_function("div", F.col("place"), F.lit(run)).alias("run")))

    edge = lambda pick: pick(F.struct("place", "initial"))["initial"]
    joined = F.array_sort(F.collect_list(F.struct("place", "initial")))  # `run` rows at most
    pairs = F.filter(F.transform(F.col("of"), lambda x, i: F.concat(F.get(F.col("of"), i - 1)["initial"], x["initial"])), lambda x: x.isNotNull() & ~x.isin("su", "ua", "au"))
    runs = light.groupBy("conv_id", "run").agg(joined.alias("of"), edge(F.min).alias("opens"), edge(F.max).alias("closes"), *(F.sum((F.col("fault") == f).cast("long")).alias(f) for f in ("blank", "duplicate", "truncated")))
    before = F.concat(F.lag("closes").over(Window.partitionBy("conv_id").orderBy("run")), "opens")
    runs = runs.withColumn("illegal", F.size(pairs) + F.coalesce((~before.isin("su", "ua", "au")).cast("int"), F.lit(0)))
    faults = runs.groupBy("conv_id").agg(*(F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal")))
    wide = F.col("turn").cast("decimal(38, 0)")
    gaps = light.select("conv_id", "turn").distinct().groupBy("conv_id").agg(F.coalesce(F.least(F.max(wide) - F.min(wide) + 1 - F.count("turn"), F.lit(2**63 - 1)), F.lit(0)).cast("long").alias("gaps"))

    initial = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("?")
    letter = F.when(F.col("fault") == "", "-").when(F.col("fault") == "truncated", "t").otherwise("d")
    elements = light.select("conv_id", "run", "place", F.concat(initial, letter).alias("kind")).repartition("conv_id", "run").sortWithinPartitions("conv_id", "run", "place")
    walked = staged(elements.mapInArrow(_walk_groups(["conv_id", "run"], True), f"conv_id {kind}, run long, b string, e string, cost long, audit string"))
    numbers = walked.select("conv_id", "run").distinct().withColumn("no", F.row_number().over(Window.partitionBy("conv_id").orderBy("run")) - 1).select(F.col("conv_id").alias("of"), F.col("run").alias("of_run"), F.col("no").cast("long"))
    walked = staged(walked.join(numbers, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("run") == F.col("of_run"))).select("conv_id", "no", "b", "e", "cost", "audit"))
    while not walked.where("no > 0").isEmpty():
        cell = F.call_function("div", F.col("no"), F.lit(FAN))
        some = walked.withColumn("run", cell).withColumn("i", (F.col("no") % FAN).cast("int")).repartition("conv_id", "run").sortWithinPartitions("conv_id", "run", "i")
        walked = staged(some.mapInArrow(_walk_groups(["conv_id", "run"], False), f"conv_id {kind}, run long, b string, e string, cost long, audit string").withColumnRenamed("run", "no"))
    over = walked.where("b = '0'")
    over = over.unionByName(over.where("e = 'U'").withColumn("e", F.lit("A")).withColumn("cost", F.col("cost") + INSERT).withColumn("audit", F.concat("audit", F.lit("I")))).where(F.col("e").isin(*ENDS))
    ended = staged(over.groupBy("conv_id").agg(F.min(F.struct("cost", "audit")).alias("best")).select("conv_id", "best.cost", "best.audit"))

    texts = placed.select("conv_id", "place", "role", "text").unionByName(ended.select("conv_id", F.lit(-1).cast("long").alias("place"), F.lit("").alias("role"), F.col("audit").alias("text")))
    digests = texts.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(_digests, f"conv_id {kind}, repaired_sha256 string")
    found = ended
    for more in (faults, gaps, digests):
        more = more.withColumnRenamed("conv_id", "of")
        found = found.join(more, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    return found.select("conv_id", *(part.split()[0] for part in FACTS.split(", ")))


def repair_conversations(rows: DataFrame, run: int = RUN, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """A row for each conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    rows: conv_id, turn, role, text without nulls in role and text, kept (false: the row only says that the conversation exists). Turns go by
    (turn, nulls first; role; text). A row without a sign is blank; one whose role and text came before is a duplicate; one that doesn't end in
    `.`, `!` or `?` is truncated; the first that holds counts. Blank and duplicate rows must be deleted (D, 2); others may be kept (K), given
    the role user or assistant (R, 1), or deleted; an empty turn may be inserted anywhere (I, 5); truncated rows that stay cost 5. The cheapest edits win,
    the least audit of those. Null is a conv_id like any other. No rows give no rows.

    Conversations of more than `run` rows or whole_bytes bytes are cut into runs. Only their digest is made by one task each, as rows stream past.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    signs = with_signs(rows)
    sizes = signs.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    large = staged(sizes.where((F.col("n") > run) | (F.col("bytes") > whole_bytes)).select(F.col("conv_id").alias("of")))
    none = large.isEmpty()
    same = F.col("conv_id").eqNullSafe(F.col("of"))
    short = signs if none else signs.join(large, same, "left_anti")
    batches = short.repartition("conv_id").sortWithinPartitions(_in_order("conv_id"), _in_order("turn"), "role", "text")
    found = batches.mapInArrow(_repair, f"conv_id {kind}, {FACTS}")
    if none:
        return found
    told = large.join(_long(signs.join(large, same, "left_semi").where("kept"), run), same, "left").drop("conv_id").withColumnRenamed("of", "conv_id")
    nothing = {c: 0 for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")} | {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return found.unionByName(told.select("conv_id", *(F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in nothing.items())))
