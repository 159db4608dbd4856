"""Jobs in rounds that can be stopped at any point: a backlog worked off in bounded batches, a cold pool filled from a deck of sources."""

from __future__ import annotations

from collections.abc import Callable

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def committed(spark: SparkSession, folder: str) -> int:
    """How many rounds of a job are done: a round counts from when its write was committed, and rounds are done in turn."""
    n = 0
    while True:
        path, files = _path(spark, f"{folder}/round={n}/_SUCCESS")
        if not files.exists(path):
            return n
        n += 1


def done(spark: SparkSession, folder: str, rounds: int) -> DataFrame | None:
    """The rows of the first `rounds` rounds, with round; None before the first."""
    if not rounds:
        return None
    return spark.read.option("basePath", folder).parquet(*(f"{folder}/round={n}" for n in range(rounds)))


def drain(backlog: DataFrame, key: str, order: list[Column], work: Callable[[DataFrame], DataFrame], folder: str, size: int, target: int | None = None, most_rounds: int | None = None) -> DataFrame:
    """Work off a backlog in rounds of `size` rows in its order, until nothing is left, `target` rows are done, or most_rounds rounds were.

    work takes a round's rows and gives a table with the key; it is written as the round's table, whose commit is the job's progress. What a killed
    run left uncommitted is written again, what it had committed is not: a rerun goes on where the job stood. Rows that work leaves out
    are not tried again in this job. backlog may grow between runs. Returns the rows of all rounds, with round. A round is a distributed top-k.
    """
    spark, rounds = backlog.sparkSession, committed(backlog.sparkSession, folder)
    while (most_rounds is None or rounds < most_rounds) and (target is None or rounds * size < target):
        tried = done(spark, f"{folder}/tried", rounds)
        left = backlog if tried is None else backlog.join(tried.select(F.col(key).alias("_tried")), F.col(key) == F.col("_tried"), "left_anti")
        taken = left.orderBy(*order).limit(size)
        taken.select(key).write.mode("overwrite").parquet(f"{folder}/tried/round={rounds}")  # which rows a round has is fixed before it is worked on
        ids = spark.read.parquet(f"{folder}/tried/round={rounds}")
        if ids.isEmpty():
            break
        batch = backlog.join(ids.select(F.col(key).alias("_taken")), F.col(key) == F.col("_taken"), "left_semi")
        work(batch).write.mode("overwrite").parquet(f"{folder}/round={rounds}")
        rounds += 1
    found = done(spark, folder, rounds)
    return work(backlog.limit(0)).withColumn("round", F.lit(0)) if found is None else found


def cold_fill(sources: DataFrame, fetch: Callable[[DataFrame], DataFrame], servable: Column, folder: str, budget: int, target: int) -> DataFrame:
    """Fill a pool: pull the next `budget` sources of the deck, round by round, until it has `target` servable rows or every source was pulled once.

    sources: id, place (its place in the deck). fetch gives the rows of some sources. Returns the rows pulled, with round. At least one round is pulled;
    progress is kept as drain keeps it.
    """
    spark, all_rounds = sources.sparkSession, -(-sources.count() // max(1, budget))
    rounds = committed(spark, folder)
    while rounds < max(1, all_rounds):
        pulled = done(spark, folder, rounds)
        if pulled is not None and pulled.where(servable).count() >= target:
            break
        turn = sources.where((F.col("place") >= rounds * budget) & (F.col("place") < (rounds + 1) * budget))
        fetch(turn).write.mode("overwrite").parquet(f"{folder}/round={rounds}")
        rounds += 1
    return done(spark, folder, rounds)
