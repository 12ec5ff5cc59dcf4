"""Returns matched to earlier purchases of the same customer, product and exact price, in arrival order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["customer_id", "stock_code", "unit_price"]


def match_reversals(rows: DataFrame, order_col: str, quantity_col: str = "quantity") -> DataFrame:
    """Each row with ``consumed``: how many returned units meet units on hand.

    Purchases add units, returns take what is there.  With S the running sum of signed quantities, the
    stock after a row is S - min(0, running min of S), so one window replaces the sequential loop.
    """
    upto = Window.partitionBy(*KEY).orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    order = Window.partitionBy(*KEY).orderBy(order_col)
    summed = rows.withColumn("running", F.sum(quantity_col).over(upto))
    stocked = summed.withColumn("on_hand", F.col("running") - F.least(F.min("running").over(upto), F.lit(0.0)))
    before = F.coalesce(F.lag("on_hand").over(order), F.lit(0.0))
    consumed = F.when(F.col(quantity_col) < 0, before - F.col("on_hand")).otherwise(0.0)
    return stocked.withColumn("consumed", consumed).drop("running")
