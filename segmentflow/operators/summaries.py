"""Period summaries by customer, segment and product."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmentflow.operators.calendar import in_periods

AT_RISK = ("At risk", "Slipping")


def _ratio(a, b):
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def labelled_rows(ledger: DataFrame, cycles: DataFrame, state: DataFrame) -> DataFrame:
    """Ledger rows of each period with their customer's segment in that cycle."""
    labels = state.select("cycle_number", "customer_id", "stable_cluster_id", "segment_name")
    return in_periods(ledger, cycles).join(labels, ["cycle_number", "customer_id"])


def customer_summary(state: DataFrame) -> DataFrame:
    """One row per cycle and customer; the panel already holds the period's totals."""
    return state.select(
        "cycle_number", "customer_id", "stable_cluster_id", "segment_name", "activity_status", "top_membership",
        F.col("current_orders").alias("orders"),
        F.col("current_products").alias("products"),
        F.col("current_quantity").alias("quantity"),
        F.col("current_revenue").alias("revenue"),
        _ratio(F.col("current_revenue"), F.col("current_orders")).alias("average_basket_value"),
        "recency", "lifecycle_status", "risk_status",
    )


def segment_summary(customers: DataFrame) -> DataFrame:
    """Totals and means per (cycle, stable id, name)."""
    return (
        customers.groupBy("cycle_number", "stable_cluster_id", "segment_name")
        .agg(
            F.count("*").alias("customers"),
            F.sum("orders").alias("orders"),
            F.sum("quantity").alias("quantity"),
            F.sum("revenue").alias("revenue"),
            F.avg("top_membership").alias("average_membership"),
            F.count_if(F.col("risk_status").isin(*AT_RISK)).alias("at_risk_customers"),
        )
        .withColumns(
            {
                "at_risk_share": _ratio(F.col("at_risk_customers").cast("double"), F.col("customers")),
                "average_order_value": _ratio(F.col("revenue"), F.col("orders")),
                "revenue_per_customer": _ratio(F.col("revenue"), F.col("customers")),
            }
        )
    )


def product_summary(rows: DataFrame) -> DataFrame:
    """Per (cycle, stable id, name, description): quantity, revenue, customers, orders, mean price."""
    return rows.groupBy("cycle_number", "stable_cluster_id", "segment_name", "description").agg(
        F.sum("quantity").alias("quantity"),
        F.sum("total_price").alias("revenue"),
        F.count_distinct("customer_id").alias("customers"),
        F.count_distinct("purchase_invoice_no").alias("orders"),
        F.avg("unit_price").alias("average_price"),
    )
