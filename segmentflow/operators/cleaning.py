"""Cleaning of the ledger: exact dedup, normalised text, coerced values, paid-sale filter, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmentflow.sources.ledger import LEDGER_COLUMNS, require_columns


def dedup_exact(raw: DataFrame, arrival: str | None = None) -> DataFrame:
    """One of each row equal in all eight raw columns; nulls equal nulls.  With ``arrival``, the first to come."""
    if arrival:
        return raw.groupBy(*LEDGER_COLUMNS).agg(F.min(arrival).alias(arrival))
    return raw.dropDuplicates(LEDGER_COLUMNS)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & ~c.isin(float("inf"), float("-inf"))


def _normalised() -> list[Column]:
    def text(name: str, default: str) -> Column:
        return F.trim(F.coalesce(F.col(name).cast("string"), F.lit(default))).alias(name)

    customer = F.col("customer_id").try_cast("double")
    whole = finite(customer) & (customer == F.floor(customer)) & customer.between(-9.2e18, 9.2e18)
    return [
        text("invoice_no", ""),
        text("stock_code", "nan"),
        text("description", "Unknown product"),
        F.col("quantity").try_cast("double").alias("quantity"),
        F.col("invoice_date").try_cast("timestamp").alias("invoice_date"),
        F.col("unit_price").try_cast("double").alias("unit_price"),
        F.when(whole, customer).cast("long").alias("customer_id"),
        text("country", "Unspecified"),
    ]


def normalise(raw: DataFrame, *kept: str) -> DataFrame:
    """Trimmed text with defaults, and values coerced to their types (null where that fails)."""
    require_columns(raw, LEDGER_COLUMNS)
    return raw.select(*_normalised(), *kept)


def is_cancellation(invoice: Column) -> Column:
    return F.upper(invoice).startswith("C")


def is_paid_sale(start: str, end: str) -> Column:
    """A linked, positive, priced line inside [start, end) that is not a cancellation."""
    return (
        F.col("customer_id").isNotNull()
        & (F.col("invoice_no") != "")
        & (F.col("invoice_date") >= F.lit(start).cast("timestamp"))
        & (F.col("invoice_date") < F.lit(end).cast("timestamp"))
        & finite(F.col("unit_price"))
        & (F.col("unit_price") > 0)
        & finite(F.col("quantity"))
        & (F.col("quantity") > 0)
        & ~is_cancellation(F.col("invoice_no"))
    )


def clean(raw: DataFrame, start: str, end: str, deduplicate: bool = True, arrival: str | None = None) -> DataFrame:
    """Paid sales of the range, with their value.

    Equal rows pass or fail the filter alike, so filtering before the dedup gives the same rows and
    shuffles fewer.  The dedup compares raw columns, before any trimming.  ``arrival`` names the column with the
    place of a row in its source, which then goes with the sale; (invoice_date, arrival) is the stable order.
    """
    carried = [arrival] if arrival else []
    if not deduplicate:
        kept = normalise(raw, *carried).where(is_paid_sale(start, end))
    else:
        roomy = raw.where(
            (F.col("invoice_date").try_cast("timestamp") >= F.lit(start).cast("timestamp"))
            & (F.col("invoice_date").try_cast("timestamp") < F.lit(end).cast("timestamp"))
            & (F.col("unit_price").try_cast("double") > 0)
            & (F.col("quantity").try_cast("double") > 0)
            & F.col("customer_id").isNotNull()
        )
        kept = normalise(dedup_exact(roomy, arrival), *carried).where(is_paid_sale(start, end))
    return kept.withColumns(
        {
            "total_price": F.col("quantity") * F.col("unit_price"),
            "purchase_invoice_no": F.col("invoice_no"),
            "transaction_type": F.lit("Sale"),
        }
    )


def cleaning_report(raw: DataFrame, start: str, end: str) -> DataFrame:
    """One row of counts: raw rows, duplicates, deduplicated, qualifying, customers, sales, rejected.

    Equal rows are counted once per group, so one aggregation gives the counts with and without repeats.
    """
    groups = raw.groupBy(*LEDGER_COLUMNS).agg(F.count("*").alias("copies"))
    flagged = normalise(groups, "copies").withColumn("ok", is_paid_sale(start, end))
    value = F.when(F.col("ok"), F.col("quantity") * F.col("unit_price"))
    return flagged.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("raw_rows"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates_removed"),
        F.count("*").alias("deduplicated_rows"),
        F.count_if("ok").alias("qualifying_rows"),
        F.count_distinct(F.when(F.col("ok"), F.col("customer_id"))).alias("qualifying_customers"),
        F.round(F.coalesce(F.sum(value), F.lit(0.0)), 2).alias("qualifying_sales"),
        F.count_if(~F.coalesce(F.col("ok"), F.lit(False))).alias("rejected_rows"),
    )


def cleaning_decisions(raw: DataFrame, start: str, end: str) -> DataFrame:
    """Counts behind the cleaning rules, over one range: returns, zero prices, unlinked lines, repeats."""
    inside = raw.where((F.col("invoice_date") >= F.lit(start).cast("timestamp")) & (F.col("invoice_date") < F.lit(end).cast("timestamp")))
    groups = inside.groupBy(*LEDGER_COLUMNS).agg(F.count("*").alias("copies"))
    rows = normalise(groups, "copies")
    back, value = is_cancellation(F.col("invoice_no")), F.col("quantity") * F.col("unit_price")

    def many(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("copies"))), F.lit(0))

    return rows.agg(
        many(F.lit(True)).alias("rows_in_period"),
        many((F.col("quantity") < 0) & back).alias("negative_cancellations"),
        many((F.col("quantity") < 0) & ~back).alias("negative_other"),
        many(F.col("unit_price") == 0).alias("zero_price"),
        many(F.col("unit_price") < 0).alias("negative_price"),
        many(F.col("customer_id").isNull() & ~back).alias("unlinked_sales"),
        many(F.col("customer_id").isNull() & back).alias("unlinked_reversals"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_rows"),
        F.round(F.coalesce(F.sum((F.col("copies") - 1) * value), F.lit(0.0)), 2).alias("duplicate_value"),
    )


def duplicate_examples(ordered: DataFrame, order_col: str, limit: int = 20) -> DataFrame:
    """The first repeats of whole rows, with the arrival number of their first occurrence and their own values.

    Of a row repeated more often than the limit, only as many repeats as could be shown are kept per task before
    they meet.
    """
    same = Window.partitionBy(*LEDGER_COLUMNS).orderBy(order_col)
    early = ordered.select(*LEDGER_COLUMNS, order_col).withColumn("occurrence", F.row_number().over(same)).where(F.col("occurrence") <= limit + 1)
    marked = early.withColumn("first_row", F.min(order_col).over(Window.partitionBy(*LEDGER_COLUMNS)))
    return marked.where("occurrence > 1").select(order_col, "first_row", "occurrence", *LEDGER_COLUMNS).orderBy(order_col).limit(limit)


def first_and_last(sales: DataFrame, order_col: str) -> DataFrame:
    """Each customer's first and last invoice in the stable order (invoice_date, order_col)."""
    place = F.struct("invoice_date", order_col)
    return sales.groupBy("customer_id").agg(
        F.min_by("invoice_no", place).alias("first_invoice"), F.max_by("invoice_no", place).alias("last_invoice"),
        F.min_by(order_col, place).alias("first_row"), F.max_by(order_col, place).alias("last_row"), F.count("*").alias("rows"),
    )


def out_of_order_rows(ordered: DataFrame, order_col: str, time_col: str = "invoice_date", buckets: int = 1 << 20) -> DataFrame:
    """How many rows are earlier than the row before them in arrival order; rows without a time are passed over.

    Arrival numbers are cut into ranges; each range compares its own neighbours, and the seams between
    ranges are compared from one row per range.
    """
    rows = ordered.select(F.col(order_col).alias("no"), F.col(time_col).alias("at")).where("at is not null").withColumn("range", F.floor(F.col("no") / buckets))
    inner = rows.withColumn("before", F.lag("at").over(Window.partitionBy("range").orderBy("no")))
    within = inner.agg(F.count_if(F.col("at") < F.col("before")).alias("n"))
    ends = rows.groupBy("range").agg(F.min_by("at", "no").alias("first_at"), F.max_by("at", "no").alias("last_at"))
    seams = ends.withColumn("before", F.lag("last_at").over(Window.orderBy("range")))  # one row per range
    across = seams.agg(F.count_if(F.col("first_at") < F.col("before")).alias("n"))
    return within.unionByName(across).agg(F.sum("n").alias("out_of_order_rows"))
