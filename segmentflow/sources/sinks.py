"""Writers: result tables, CSV exports, metadata and versioned runs.  Paths are Spark paths throughout."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segmentflow.session import ensure_checkpoint_dir


def sink_ready(df: DataFrame) -> DataFrame:
    """Timestamps as text and infinities as null, as the result tables store them."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.typeName()
        if kind in ("timestamp", "timestamp_ntz"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind in ("double", "float"):
            c = F.when(~c.isin(float("inf"), float("-inf")) & ~F.isnan(c), c)
        out.append(c.alias(f.name))
    return df.select(*out)


def write_table(df: DataFrame, run_path: str, name: str, by_cycle: bool = True, mode: str = "overwrite") -> None:
    """One result table of a run; large ones are partitioned by cycle."""
    writer = df.write.mode(mode)
    if by_cycle and "cycle_number" in df.columns:
        writer = writer.partitionBy("cycle_number")
    writer.parquet(f"{run_path}/{name}")


def replace_table(df: DataFrame, run_path: str, name: str, by_cycle: bool = True) -> None:
    """Write a table beside the old one and swap names when it is whole; a failed job leaves the old one.

    ``df`` may read the table that it replaces.  Between the two renames readers find no table.
    """
    new, old = f"{name}__new_{uuid.uuid4().hex}", f"{name}__old_{uuid.uuid4().hex}"
    write_table(df, run_path, new, by_cycle, mode="errorifexists")
    jvm = df.sparkSession.sparkContext._jvm
    to_path = jvm.org.apache.hadoop.fs.Path
    target = to_path(f"{run_path}/{name}")
    files = target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())

    def rename(source, goal) -> None:
        if not files.rename(source, goal):
            raise OSError(f"cannot rename {source} to {goal}")

    held = files.exists(target)
    if held:
        rename(target, to_path(f"{run_path}/{old}"))
    rename(to_path(f"{run_path}/{new}"), target)
    if held:
        files.delete(to_path(f"{run_path}/{old}"), True)


def read_table(spark: SparkSession, run_path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{run_path}/{name}")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def slug(name: Column) -> Column:
    """Lower-case letters and digits, other runs as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def write_profile_csvs(df: DataFrame, path: str, profile_col: str) -> None:
    """One CSV folder per profile, named by its slug."""
    named = df.withColumn("slug", slug(F.col(profile_col)))
    named.write.mode("overwrite").partitionBy("slug").option("header", True).csv(path)


def upsert_metadata(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Key/value rows with the keys of ``changes`` replaced."""
    return current.join(changes, "key", "left_anti").unionByName(changes)


def with_surrogate_ids(df: DataFrame, id_col: str, order: list[str], group: str = "cycle_number") -> DataFrame:
    """Numbers 1..n in (group, order): rows are dealt by ranges and sorted there, and each range counts on from those before it.

    The sorted rows are stored once, as a second sort may cut other ranges.
    """
    ensure_checkpoint_dir(df.sparkSession)
    placed = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("place", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("place", 33).alias("part")
    sizes = placed.groupBy(part).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn(id_col, F.col("offset") + own + 1).drop("part", "place", "offset")


def derive_run(spark: SparkSession, source: str, target: str, kept: list[str], replaced: dict[str, DataFrame]) -> None:
    """A new run from an old one: copies the kept tables, writes the replaced ones, never overwrites."""
    for name in kept:
        spark.read.parquet(f"{source}/{name}").write.mode("errorifexists").parquet(f"{target}/{name}")
    for name, df in replaced.items():
        df.write.mode("errorifexists").parquet(f"{target}/{name}")
