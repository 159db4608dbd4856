"""What a reader consumed, remembers and has seen: folds that combine on the map side, and capped histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.functions.numbers import half_up, political
from lodestrand.operators.ordering import first_per_key, top_per_group


def fold_completions(done: DataFrame, keys: list[str]) -> DataFrame:
    """keys, consumed, lean_weight, lean_minutes, left_minutes, right_minutes. done: keys, item, at, minutes, lean.

    An item that is completed again counts once, by its first completion, whatever the order in which they come. Exactly centred
    minutes count half to each side.
    """
    once = first_per_key(done, [*keys, "item"], [F.col("at")])
    lean, minutes, sided = F.col("lean"), F.col("minutes"), political(F.col("lean"))
    total = lambda c, x: F.coalesce(F.sum(F.when(c, x)), F.lit(0.0))
    return once.groupBy(*keys).agg(
        F.sum("minutes").alias("consumed"), total(sided, lean * minutes).alias("lean_weight"), total(sided, minutes).alias("lean_minutes"),
        total(sided & (lean <= 0), F.when(lean < 0, minutes).otherwise(minutes / 2)).alias("left_minutes"), total(sided & (lean >= 0), F.when(lean > 0, minutes).otherwise(minutes / 2)).alias("right_minutes"),
    )


def drift(weight: Column, minutes: Column, left: Column, right: Column, threshold: float) -> Column:
    """struct(mean, direction, warn, left_share, right_share): how far from balance; without sided minutes the shares are one half."""
    mean, sided = F.when(minutes > 0, weight / minutes), left + right
    warn = F.coalesce(F.abs(mean) > threshold, F.lit(False))
    share = lambda x: F.when(sided > 0, x / sided).otherwise(0.5)
    direction = F.when(warn, F.when(mean < 0, "left").otherwise("right")).otherwise("balanced")
    return F.struct(mean.alias("mean"), direction.alias("direction"), warn.alias("warn"), share(left).alias("left_share"), share(right).alias("right_share"))


def profile(graded: DataFrame, topics: list, pass_score: int = 70) -> DataFrame:
    """topic, answers, mean_score, weak of every topic, those never graded too (weak), with the overall mean of all answers. graded: topic, score."""
    spark = graded.sparkSession
    every = spark.createDataFrame([(t,) for t in topics], f"topic {graded.schema['topic'].dataType.simpleString()}")
    told = graded.groupBy("topic").agg(F.count("*").alias("answers"), half_up(F.avg("score")).cast("long").alias("mean_score"))
    overall = graded.agg(F.coalesce(half_up(F.avg("score")), F.lit(0)).cast("long").alias("overall"))
    both = every.join(told, "topic", "full").join(overall)  # one row
    weak = F.coalesce(F.col("mean_score") < pass_score, F.lit(True))
    return both.select("topic", F.coalesce("answers", F.lit(0)).cast("long").alias("answers"), "mean_score", weak.alias("weak"), "overall")


def capped(kept: DataFrame, fresh: DataFrame, reader: str, key: str, at: str, most: int) -> DataFrame:
    """A reader's records after an upsert by key (fresh rows win), the newest `most`."""
    both = kept.withColumn("_old", F.lit(1)).unionByName(fresh.withColumn("_old", F.lit(0)))
    once = first_per_key(both, [reader, key], [F.col("_old"), F.col(at).desc()]).drop("_old")
    return top_per_group(once, [reader], [F.col(at).desc(), F.col(key)], most).drop("rank")
