"""Aggregates of clusters, readers and answers. All combine on the map side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrand.functions.numbers import clamp01, half_up, political


def coverage(covered_by: Column) -> Column:
    return F.sum(F.greatest(F.lit(1), F.coalesce(covered_by, F.lit(1)))).cast("long")


def severity(importance: Column, source: Column, developing: Column | None = None) -> Column:
    breadth = F.least(F.lit(1.0), F.count_distinct(source) / 8)
    score = 0.6 * F.greatest(F.lit(0.0), F.max(importance)) + 0.4 * breadth
    return clamp01(score if developing is None else score + F.when(developing, 0.15).otherwise(0.0))


def aggregate_lean(lean: Column, importance: Column) -> Column:
    """Mean lean of the political rows, weighted by importance (0.1 at least); null without any."""
    weight = F.when(political(lean), F.greatest(F.lit(0.1), importance))
    mean = F.sum(weight * lean) / F.sum(weight)
    return F.when(mean.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), mean)))


def majority(items: DataFrame, group: str, value: str, position: str) -> DataFrame:
    """The commonest value of each group; of equally common ones that which occurs first."""
    counts = items.groupBy(group, value).agg(F.count("*").alias("n"), F.min(position).alias("first"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.col("n").desc(), "first"))
    return counts.withColumn("_rank", rank).where("_rank = 1").select(group, value, "n")


#: Stages of work, the one that is told first when several run.
STAGES = ("analyzing", "triage", "transcripts", "embedding", "synthesizing", "fetching")


def dominant(tasks: DataFrame, group: str, stage: str, task: str) -> DataFrame:
    """group, stage, task: of each group's running tasks the one whose stage comes first in STAGES, its first by task; unknown stages aren't told."""
    place = F.array_position(F.array(*(F.lit(s) for s in STAGES)), F.col(stage))
    best = F.min_by(F.struct(stage, task), F.struct(place.alias("p"), F.col(task).alias("t")))
    return tasks.where(F.col(stage).isin(*STAGES)).groupBy(group).agg(best.alias("b")).select(group, f"b.{stage}", f"b.{task}")


def lean_minutes(lean: Column, minutes: Column) -> list[Column]:
    """Minutes left, right, centre and non-political."""
    total = lambda c: F.coalesce(F.sum(F.when(c, minutes)), F.lit(0.0))
    return [
        total(political(lean) & (lean <= -0.2)).alias("left_minutes"), total(political(lean) & (lean >= 0.2)).alias("right_minutes"),
        total(political(lean) & (lean > -0.2) & (lean < 0.2)).alias("center_minutes"), total(~political(lean)).alias("other_minutes"),
    ]


def knowledge(graded: DataFrame, topic: str, score: str, pass_score: int = 70) -> DataFrame:
    """For each topic: answers, mean score (halves up), whether it is weak."""
    told = graded.groupBy(topic).agg(F.count("*").alias("answers"), F.avg(score).alias("_mean"))
    return told.select(topic, "answers", half_up(F.col("_mean")).cast("long").alias("mean_score"), (F.col("_mean") < pass_score).alias("weak"))
