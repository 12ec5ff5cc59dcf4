"""Arrival numbers: the place of a row in its source, taken from files and positions without sorting rows.

Files count in the order of their names, rows in the order of each file, from 0 without gaps.  Only a table of
one row per file (or per split of a text file) is ordered; it is broadcast, so that the rows of a file, which may be
all, never meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segmentflow.session import ensure_checkpoint_dir


def _offset(rows: DataFrame, parts: list[str], name: str) -> DataFrame:
    """rows with name = rows of all earlier parts + place; place, from 0 in every part, goes with the parts."""
    sizes = rows.groupBy(*parts).agg((F.max("place") + 1).alias("n"))
    earlier = Window.orderBy(*parts).rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    offsets = sizes.select(*parts, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    return rows.join(F.broadcast(offsets), parts).withColumn(name, F.col("offset") + F.col("place")).drop(*parts, "place", "offset")


def numbered_parquet(spark: SparkSession, path: str, name: str = "arrival", columns: list[str] | None = None) -> DataFrame:
    """The rows of Parquet files with their arrival number; the files tell each row's place."""
    rows = spark.read.parquet(path)
    chosen = [F.col(f"`{c}`") for c in columns or rows.columns]
    return _offset(rows.select(*chosen, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")), ["file"], name)


def numbered_csv(spark: SparkSession, path: str, name: str = "arrival") -> DataFrame:
    """The rows of CSV files with a header and their arrival number; values stay text.

    A split's rows are read in order by one task, so their running ids rise; ids are stored once, as a second
    reading may deal splits to tasks in another way.
    """
    ensure_checkpoint_dir(spark)
    rows = spark.read.option("header", True).csv(path)
    kept = rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")).checkpoint()
    first = kept.groupBy("file", "block").agg(F.min("id").alias("first_id"))
    placed = kept.join(F.broadcast(first), ["file", "block"]).withColumn("place", F.col("id") - F.col("first_id")).drop("id", "first_id")
    return _offset(placed, ["file", "block"], name)
