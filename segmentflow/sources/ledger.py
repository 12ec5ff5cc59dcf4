"""The invoice-line ledger: its schema, reader, and a view of the driver's tables in its shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segmentflow.session import table
from segmentflow.sources.arrival import numbered_csv, numbered_parquet

LEDGER_SCHEMA = T.StructType(
    [
        T.StructField("invoice_no", T.StringType()),
        T.StructField("stock_code", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("quantity", T.DoubleType()),
        T.StructField("invoice_date", T.TimestampType()),
        T.StructField("unit_price", T.DoubleType()),
        T.StructField("customer_id", T.DoubleType()),
        T.StructField("country", T.StringType()),
    ]
)
LEDGER_COLUMNS = LEDGER_SCHEMA.names


def require_columns(df: DataFrame, needed: list[str]) -> DataFrame:
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_ledger(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """The ledger's columns from Parquet or CSV; fails if one is missing.  CSV values stay text until cleaning."""
    reader = spark.read.option("header", True) if kind == "csv" else spark.read
    return require_columns(reader.format(kind).load(path), LEDGER_COLUMNS).select(*LEDGER_COLUMNS)


def read_ordered_ledger(spark: SparkSession, path: str, kind: str = "parquet", name: str = "arrival") -> DataFrame:
    """The ledger's columns with the arrival number of each row."""
    rows = numbered_csv(spark, path, name) if kind == "csv" else numbered_parquet(spark, path, name)
    return require_columns(rows, LEDGER_COLUMNS).select(*LEDGER_COLUMNS, name)


def order_ledger(spark: SparkSession, sf_dir: str, arrival: str | None = None) -> DataFrame:
    """lineitem, orders, part, supplier and nation as a ledger, with returns, gaps, zero prices and repeats.

    Dimension tables are joined by key; Catalyst broadcasts them while they are small.  ``arrival`` names a column
    for the place of each row in the line file, repeats directly behind their line.
    """
    needed = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"]
    if arrival:
        lines = numbered_parquet(spark, f"{sf_dir}/lineitem.parquet", "line_no", needed)
    else:
        lines = table(spark, sf_dir, "lineitem").select(*needed, F.lit(0).alias("line_no"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    places = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select("s_suppkey", "n_name")
    )
    returned = F.col("l_returnflag") == "R"
    once = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(places, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.concat(F.when(returned, "C").otherwise(""), F.col("l_orderkey").cast("string")).alias("invoice_no"),
            F.col("l_partkey").cast("string").alias("stock_code"),
            F.when(F.col("l_partkey") % 37 != 0, F.col("p_name")).alias("description"),
            F.when(returned, -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("quantity"),
            F.col("o_orderdate").cast("timestamp").alias("invoice_date"),
            F.when(F.col("l_partkey") % 41 == 0, 0.0).otherwise(F.col("p_retailprice")).alias("unit_price"),
            F.when(F.col("o_custkey") % 50 != 0, F.col("o_custkey")).cast("double").alias("customer_id"),
            F.when(F.col("l_suppkey") % 29 != 0, F.col("n_name")).alias("country"),
            F.explode(F.when(F.col("l_orderkey") % 97 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
            "line_no",
        )
    )
    return once.select(*LEDGER_COLUMNS, *([(2 * F.col("line_no") + F.col("copy")).alias(arrival)] if arrival else []))
