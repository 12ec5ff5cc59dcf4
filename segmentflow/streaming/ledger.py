"""Ledger rows as a stream: cleaning, dedup within the watermark, and sales by closed period."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from segmentflow.operators.cleaning import is_paid_sale, normalise
from segmentflow.sources.ledger import LEDGER_COLUMNS, LEDGER_SCHEMA


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(LEDGER_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def sales_by_day(rows: DataFrame, start: str, end: str, late: str = "7 days") -> DataFrame:
    """Paid sales per day and country; a day is final once the watermark passes it.

    Exact repeats are dropped while they arrive within the watermark, which bounds the state; rows later
    than that are late data and left out, as a closed cycle does not change.
    """
    marked = rows.withWatermark("invoice_date", late)
    once = marked.dropDuplicatesWithinWatermark(LEDGER_COLUMNS)
    timed = once.withColumn("event_time", F.col("invoice_date"))  # keeps the watermark through the casts
    paid = normalise(timed, "event_time").where(is_paid_sale(start, end))
    return paid.groupBy(F.window("event_time", "1 day"), "country").agg(
        F.count("*").alias("rows"), F.sum(F.col("quantity") * F.col("unit_price")).alias("sales")
    )


def write_days(days: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Closed days appended as Parquet; restarts go on from the checkpoint."""
    flat = days.select(F.col("window.start").alias("day"), "country", "rows", "sales")
    return (
        flat.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def on_each_batch(rows: DataFrame, step, checkpoint: str) -> StreamingQuery:
    """Run ``step(batch, batch_id)`` on every micro-batch, such as one cycle's update from stored centres."""
    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
