"""Tables that cut lineage, kept in the folder that the session's ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder. Only a local session without the setting gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="lodestrand-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def staged(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: a lost executor costs no recomputation beyond this."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/staged-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._staged_path = path
    return made


def discard(df: DataFrame) -> None:
    """Delete a table that staged() wrote and nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged_path)
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def with_rank(df: DataFrame, key: str, order: list[Column], counts: dict[int, int], out: str = "rank", cell_rows: int = 100_000) -> DataFrame:
    """Add the row's position (from 0) among the rows of its key.

    counts: the rows of each key, a bounded number of keys. A key may hold any share of the rows: its rows are dealt to
    as many salts as it has cell_rows, by a hash of the order columns, numbered inside each salt and shifted by the counts of the salts before.
    """
    spark, kind = df.sparkSession, df.schema[key].dataType.simpleString()
    salts = spark.createDataFrame([(k, -(-n // cell_rows)) for k, n in counts.items() if n > cell_rows], f"_of {kind}, _salts long")
    salted = df.join(F.broadcast(salts), F.col(key) == F.col("_of"), "left")  # as many rows as the keys
    salted = salted.withColumn("_salt", F.pmod(F.xxhash64(*order), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_of", "_salts")
    cells = salted.groupBy(F.col(key).alias("_key"), F.col("_salt").alias("_cell")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_key").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("_key", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")).where("_cell > 0")
    inside = F.row_number().over(Window.partitionBy(key, "_salt").orderBy(*order))
    ranked = salted.withColumn("_inside", inside)
    joined = ranked.join(cells, (ranked[key] == cells["_key"]) & (ranked["_salt"] == cells["_cell"]), "left")
    return joined.withColumn(out, F.coalesce("_before", F.lit(0)) + F.col("_inside") - 1).drop("_salt", "_key", "_cell", "_before", "_inside")
