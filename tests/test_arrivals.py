"""Rows as they arrive: late ones, lives of items, and jobs that are killed and run again."""

import datetime

import pytest
from pyspark.sql import functions as F

from lodestrand import plans
from lodestrand.operators import drain
from lodestrand.streaming import intake

SF = "/root/testdata/sf0.01"
AT = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)


def test_late_rows_are_dropped(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").count()
    kept = plans.QUERIES["late_events"](spark, SF).count()
    assert 0.9 * events < kept < events  # every fiftieth comes four days late


def test_a_late_row(spark, tmp_path):
    rows = [(1, AT(0), 0), (2, AT(50), 0), (3, AT(20), 1), (4, AT(30), 1), (2, AT(50), 1), (5, AT(90), 1), (6, AT(60), 2)]
    found = intake.replayed(spark.createDataFrame(rows, "id int, ts timestamp, batch int"), "batch", lambda s: intake.deduplicated(s, ["id"]), str(tmp_path)).collect()
    assert sorted(r["id"] for r in found) == [1, 2, 4, 5]  # 3 is behind 50 - 24 hours, 6 behind 90 - 24


@pytest.mark.parametrize("turned", [False, True])
def test_lives_in_any_order(spark, tmp_path, turned):
    """Two batches; rows of an item come in either order within the watermark."""
    rows = [(1, "fetched", 0), (1, "analyzed", 5), (1, "triaged", 9), (1, "failed", 7), (2, "failed", 1), (2, "failed", 3), (1, "fetched", 200), (3, "odd", 10), (9, "fetched", 400)]
    early = [r for r in rows if r[2] < 24]
    landed = [(i, s, AT(h), int(h >= 24)) for i, s, h in (early[::-1] if turned else early) + rows[6:7] + rows[8:]]
    told = intake.replayed(spark.createDataFrame(landed, "id int, state string, at timestamp, batch int"), "batch", lambda s: intake.lifetimes(s, ("fetched", "triaged", "analyzed", "embedded")), str(tmp_path))
    hours = lambda t: None if t is None else (t - AT(0)).total_seconds() / 3600
    found = {(r["id"], hours(r["began"])): (hours(r["ended"]), r["state"], hours(r["reached_at"]), r["failures"], hours(r["retry_at"])) for r in told.collect()}
    assert found == {(1, 0): (9, "analyzed", 5, 1, None), (2, 1): (3, None, None, 2, 5), (3, 10): (10, None, None, 1, 11), (1, 200): (200, "fetched", 200, 0, None)}  # the life of 9 goes on


def backlog(spark):
    return spark.range(40).select("id", (F.col("id") * 7 % 40).alias("rank"))


def test_drain_goes_on_after_a_kill(spark, tmp_path):
    folder, calls = str(tmp_path / "job"), []

    def work(batch):
        calls.append(batch.count())
        if len(calls) == 3:
            raise KeyboardInterrupt
        return batch.select("id", (F.col("id") * 2).alias("twice"))

    with pytest.raises(KeyboardInterrupt):
        drain.drain(backlog(spark), "id", [F.col("rank")], work, folder, 10)
    assert drain.committed(spark, folder) == 2
    backlog(spark).limit(3).withColumn("twice", F.col("id")).write.parquet(f"{folder}/round=2")
    (tmp_path / "job" / "round=2" / "_SUCCESS").unlink()  # written, but killed before the commit
    found = drain.drain(backlog(spark), "id", [F.col("rank")], work, folder, 10)
    assert {(r["id"], r["twice"], r["round"]) for r in found.collect()} == {(i, 2 * i, (i * 7 % 40) // 10) for i in range(40)}
    assert calls == [10] * 5  # two rounds, the one that failed, and the two that were left
    again = drain.drain(backlog(spark), "id", [F.col("rank")], work, folder, 10)
    assert again.count() == 40 and calls == [10] * 5
    assert drain.drain(backlog(spark).where("id < 0"), "id", [F.col("rank")], work, str(tmp_path / "none"), 10).count() == 0


def test_cold_fill_takes_each_source_once(spark, tmp_path):
    items = spark.createDataFrame([(i, i % 5, i % 3 == 0) for i in range(30)], "id int, source int, ok boolean")
    deck = spark.range(5).select(F.col("id").cast("int").alias("id"), F.col("id").cast("int").alias("place"))
    fetch = lambda some: items.join(some.select(F.col("id").alias("s")), F.col("source") == F.col("s")).drop("s")
    all_of_it = drain.cold_fill(deck, fetch, F.col("ok"), str(tmp_path / "a"), 2, 1000)
    assert {r["id"] for r in all_of_it.collect()} == set(range(30)) and all_of_it.agg(F.max("round")).first()[0] == 2
    some = drain.cold_fill(deck, fetch, F.col("ok"), str(tmp_path / "b"), 2, 4)
    assert {r["source"] for r in some.collect()} == {0, 1}
