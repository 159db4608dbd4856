"""Repair of conversations against every possible edit, and against a plain walk over the whole table."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from lodestrand.llm import queries, turns

SF = "/root/testdata/sf0.001"
ROWS = "conv_id long, turn long, role string, text string, kept boolean, g int, at int, cost long"
WHITE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    """rows: conv_id, turn, role, text. Gives them by conversation, in order."""
    found = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        act = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        found.setdefault(conv, [])
        if act:
            row = (turn, "user" if act == 4 else role, "" if act == 1 else re.sub("[.!?]", "", text) if act == 2 else text)
            found[conv] += [row] * (1 + (act == 3))
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in found.items()}


def faults(rows):
    told, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(WHITE)
        told.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return told


def offers(row, fault):
    """letter, role of the repaired row, cost."""
    yield "D", None, 2
    if fault not in ("blank", "duplicate"):
        cut = 5 * (fault == "truncated")
        yield "K", row[1], cut
        yield "R", "user", 1 + cut
        yield "R", "assistant", 1 + cut


def every_edit(rows):
    found = []
    inserted = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    told = faults(rows)
    for before in itertools.product(inserted, repeat=len(rows) + 1):
        for edits in itertools.product(*(list(offers(r, f)) for r, f in zip(rows, told, strict=True))):
            roles, audit, cost = [], "", 0
            for new, edit in itertools.zip_longest(before, edits):
                roles, audit, cost = roles + list(new), audit + "I" * len(new), cost + 5 * len(new)
                if edit:
                    roles, audit, cost = roles + [edit[1]] * (edit[0] != "D"), audit + edit[0], cost + edit[2]
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r in roles)):
                found.append((cost, audit, roles))
    return min(found)


def plain_walk(rows):
    """The same over states, for conversations of any length; ties by audit."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "", ())}
    add = lambda new, state, value: new.__setitem__(state, min(new.get(state, value), value))
    for row, fault in zip(rows, faults(rows), strict=True):
        opened = [(s, v) for s, v in best.items()] + [(t, (v[0] + 5, v[1] + "I", (*v[2], role))) for s, v in best.items() for role in ("user", "assistant") if (t := after.get((s, role[0])))]
        new = {}
        for s, (cost, audit, roles) in opened:
            for letter, role, more in offers(row, fault):
                t = s if role is None else after.get((s, role[:1]))
                if t is not None:
                    add(new, t, (cost + more, audit + letter, roles + ((role,) if role is not None else ())))
        best = new
    ends = [best[s] for s in ("", "a") if s in best] + [(v[0] + 5, v[1] + "I", (*v[2], "assistant")) for s, v in best.items() if s == "u"]
    return min(ends)


def plain_row(rows, best=plain_walk):
    cost, audit, roles = best(rows)
    source, out = iter(rows), []
    roles = iter(roles)
    for letter in audit:
        text = "" if letter == "I" else next(source)[2]
        if letter != "D":
            out.append(f"{next(roles)}:{text}")
    told, seen = faults(rows), [r[0] for r in rows if r[0] is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    gaps = max(seen) - min(seen) + 1 - len(set(seen)) if seen else 0
    return (gaps, *(told.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def rows_of(found):
    return {r["conv_id"]: tuple(r)[1:] for r in found.collect()}


def random_rows(rng, size):
    roles, texts = ["user", "assistant", "system", "unicorn", "", " ", "tool", "user"], ["Yes.", "No!", "cut off", "", " \t", "Yes.", "Wait? \n", "é"]
    return [(rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts)) for _ in range(size)]


def frame(spark, conversations):
    rows = [(c, t, r, x, True, 0, 0, 0) for c, some in conversations.items() for t, r, x in some]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, ROWS)


def in_order(rows):
    return sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))


def test_every_edit(spark):
    rng = random.Random(1)
    made = {c: in_order(random_rows(rng, rng.choice([1, 2, 2, 3]))) for c in range(40)}
    expected = {c: plain_row(rows, every_edit) for c, rows in made.items()}
    assert rows_of(turns.repair_conversations(frame(spark, made))) == expected
    assert {c: plain_row(rows) for c, rows in made.items()} == expected


@pytest.mark.parametrize(("run", "whole_bytes"), [(256, 8 << 20), (3, 8 << 20), (1, 8 << 20), (256, 20)])
def test_long_and_short(spark, run, whole_bytes):
    rng = random.Random(run)
    made = {c: in_order(random_rows(rng, rng.randint(1, 25))) for c in [None, *range(30)]}
    assert rows_of(turns.repair_conversations(frame(spark, made), run=run, whole_bytes=whole_bytes)) == {c: plain_row(rows) for c, rows in made.items()}


def test_whole_table(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(queries.op12_turns(spark, SF)) == {c: plain_row(r) for c, r in plain_damage(rows).items()}


def test_one_very_long_conversation(spark):
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([f"Turn {t}.", "again.", "cut", ""])) for t in range(3000)] + [(8, 0, "user", "Hi.")]
    found = rows_of(turns.repair_conversations(turns.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))
    assert found == {c: plain_row(r) for c, r in plain_damage(rows).items()}


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "x" * 1_000_000 + "."), (1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, None, "assistant", None), (2, 5, None, "Yes."), ]
    far = next(c for c in range(100, 1000) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 > 4 for t in (2**62 + 5, -(2**62))))
    rows += [(far, 2**62 + 5, "user", "A."), (far, -(2**62), "assistant", "B.")]
    dropped = next(c for c in range(100, 1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(dropped, 0, "user", "gone.")]
    wide = [(*r, True, 1, 1, 5) for r in rows]
    found = rows_of(turns.repair_conversations(turns.damaged(spark.createDataFrame(wide, ROWS))))
    expected = {c: plain_row(r) for c, r in plain_damage(rows).items()}
    expected[far] = (2**63 - 1, *expected[far][1:])  # more gaps than 64 bits hold
    assert found == expected
    assert found[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_no_rows(spark):
    assert turns.repair_conversations(turns.damaged(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect() == []
