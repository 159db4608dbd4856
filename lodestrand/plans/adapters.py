"""The driver's tables as items, readers and places: the same expressions as SQL_ITEMS in queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW_MS = 1_706_659_200_000  # 2024-01-31


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as news items; clickbait is what labels mark as of low quality."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    n = F.col("doc_id")
    return docs.join(labels, "doc_id", "left").select(
        n.alias("id"), F.col("source").alias("source_id"), F.split("text", "\n")[0].alias("title"), F.col("text").alias("summary"), F.col("text"), "lang",
        (n % 8).alias("topic"), (n % 3).alias("kind"), (F.lit(NOW_MS) - (n * 7919) % 1209600 * 1000).alias("published_at"),
        F.when(n % 5 != 0, (n * 37) % 201 / 100.0 - 1).alias("lean"), ((n * 53) % 101 / 100.0).alias("importance"),
        F.nullif((n * 31) % 4, F.lit(0)).alias("covered_by"), F.coalesce(F.col("quality") == 0, F.lit(False)).alias("clickbait"),
    )


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as the stores of their pools keep them, with what became of them; every fifth is in the front pool too."""
    n, rows = F.col("id"), items(spark, sf_dir)
    base = rows.withColumns({
        "analyzed": n % 9 != 0, "clone_of": F.when(n % 13 == 0, n - 1), "global": F.when(n % 6 == 0, True).when(n % 6 == 1, False), "prescreen": F.when(n % 3 != 0, (n * 29) % 101 / 100.0),
        "zone": F.when(n % 7 == 0, "ua"), "thumbnail": F.when(n % 3 == 0, F.concat(F.lit("https://img/"), n.cast("string"))).when(n % 3 == 1, "data:x"),
        "countries": F.when(n % 2 == 0, F.array("lang")).otherwise(F.array("lang", F.lit("us"))),
    })
    pool = F.when(n % 4 == 0, "front").when(n % 4 == 1, F.concat(F.lit("place-"), "lang")).when(n % 4 == 2, F.concat(F.lit("geo-n"), (n % 25).cast("string"))).otherwise("geo-r1")
    return base.withColumn("pool", pool).unionByName(base.where("id % 5 = 0 and id % 4 <> 0").withColumn("pool", F.lit("front")))


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a reader's consumed minutes, with a lean."""
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.to_date("ts").alias("day"), F.col("value").alias("minutes"), F.when(n % 5 != 0, (n * 37) % 201 / 100.0 - 1).alias("lean"))


def geo_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, parent, level, label of regions and nations."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    top = region.select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit("world").alias("parent"), F.lit("continent").alias("level"), F.col("r_name").alias("label"))
    return top.unionByName(nation.select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.lit("country").alias("level"), F.col("n_name").alias("label")))
