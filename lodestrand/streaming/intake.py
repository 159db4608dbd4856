"""Structured Streaming: intake with a watermark, windowed activity, and a queue kept across micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestrand.operators.ordering import merge_queue, upsert


def deduplicated(stream: DataFrame, keys: list[str], time: str = "ts", late: str = "24 hours") -> DataFrame:
    """First row of each key; rows later than the watermark are dropped, and so is the state of old keys."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def activity(stream: DataFrame, time: str = "ts", width: str = "2 hours", late: str = "24 hours") -> DataFrame:
    """Events and sum of values for each window and kind."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def collected(arrived: DataFrame, folder: str, keys: tuple[str, ...] = ("event_id",), time: str = "ts") -> DataFrame:
    """What an intake of rows keeps, as a table in folder: they land as files and are read as a stream, each key once within the watermark."""
    spark = arrived.sparkSession
    arrived.withColumn(time, F.col(time).cast("timestamp")).write.parquet(f"{folder}/landed")
    stream = spark.readStream.schema(spark.read.parquet(f"{folder}/landed").schema).parquet(f"{folder}/landed")
    run = deduplicated(stream, list(keys), time).writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/log").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/rows")


def keep_queue(stream: DataFrame, queue_path: str, store: DataFrame, cutoff_ms: int, most: int, checkpoint: str) -> StreamingQuery:
    """Merge each micro-batch into a bounded, freshest-first queue table (one version for each batch; the newest is current)."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{queue_path}/batch={batch_id - 1}") if batch_id else batch.limit(0)
        merge_queue(before, batch, store, cutoff_ms, most).write.mode("overwrite").parquet(f"{queue_path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_state(stream: DataFrame, state_path: str, key: str, version: str, checkpoint: str) -> StreamingQuery:
    """Upsert each micro-batch into a state table by key, the newest version wins (one table version for each batch)."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{state_path}/batch={batch_id - 1}") if batch_id else batch.limit(0)
        upsert(before, batch, key, version).write.mode("overwrite").parquet(f"{state_path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replayed(arrived: DataFrame, batch: str, keep: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """What a stream keeps of rows that land batch by batch, as a table in folder.

    The batches (whole numbers, few) land in their order. Each is read by a run that goes on from the checkpoint of the last, so watermarks, state and
    what is late are those of a stream that is fed as the rows arrive, and a run that fails is repeated from its checkpoint.
    """
    spark = arrived.sparkSession
    rows = arrived.drop(batch)
    for b in sorted(r[0] for r in arrived.select(batch).distinct().collect()):
        arrived.where(F.col(batch) == b).drop(batch).write.mode("append").parquet(f"{folder}/landed")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/landed")
        run = keep(stream).writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/log").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.parquet(f"{folder}/rows")


def lifetimes(events: DataFrame, states: Sequence[str], ttl: str = "5 days", late: str = "24 hours", retry: str = "1 hour") -> DataFrame:
    """id, began, ended, state, reached_at, failures, retry_at: the lives of items, in a batch or as a stream that gives a life when it has ended.

    events: id, state, at (timestamp). A life goes on while its item's events follow each other within ttl; it ends, and its state is dropped, when the
    watermark has passed ttl after the last. Its state is the farthest of `states` that an event tells of, reached when first told; states don't go
    back, whatever order events arrive in. Other states are failures: the item is tried again `retry` after the last one, doubled for each before it (ten times at most), unless it went on after it.
    """
    place = F.array_position(F.array(*(F.lit(s) for s in states)), F.col("state"))
    known = F.when(place > 0, place)
    life = events.withWatermark("at", late).groupBy("id", F.session_window("at", ttl).alias("life"))
    told = life.agg(
        F.max("at").alias("ended"), F.max(F.struct(known.alias("place"), (-F.unix_micros("at")).alias("before"))).alias("far"), F.count_if(place == 0).alias("failures"),
        F.max(F.when(place == 0, F.col("at"))).alias("failed_at"), F.max(F.when(place > 0, F.col("at"))).alias("went_on"),
    )
    reached = F.timestamp_micros(-F.col("far.before"))
    wait = F.expr(f"interval {retry}") * F.pow(F.lit(2), F.least(F.col("failures") - 1, F.lit(10)))
    due = F.when(F.col("failed_at").isNotNull() & (F.col("went_on").isNull() | (F.col("failed_at") > F.col("went_on"))), F.col("failed_at") + wait)
    state = F.when(F.col("far.place") > 0, F.element_at(F.array(*(F.lit(s) for s in states)), F.col("far.place").cast("int")))
    return told.select("id", F.col("life.start").alias("began"), "ended", state.alias("state"), F.when(F.col("far.place") > 0, reached).alias("reached_at"), "failures", due.alias("retry_at"))
