"""Cycle calendar, period and trailing-window joins."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CycleConfig:
    """Baseline [start, end), then one cycle a month; windows of ``window_days`` or of calendar months."""

    baseline_start: str = "1995-01-01"
    baseline_end: str = "1995-04-01"
    cycles: int = 10
    window_days: int = 90
    window_mode: str = "days"
    window_months: int = 3

    @property
    def end(self) -> str:
        first = date.fromisoformat(self.baseline_end)
        months = first.month - 1 + self.cycles - 1
        return date(first.year + months // 12, months % 12 + 1, first.day).isoformat()


def calendar(spark: SparkSession, config: CycleConfig) -> DataFrame:
    """One row per cycle; a handful of rows, so joins with it are always broadcast."""
    n = F.col("id").cast("int")
    end = F.add_months(F.lit(config.baseline_end).cast("date"), n)
    start = F.when(n == 0, F.lit(config.baseline_start).cast("date")).otherwise(F.add_months(end, -1))
    if config.window_mode == "days":
        window = F.date_sub(end, config.window_days)
    else:
        window = F.add_months(end, -config.window_months)
    return spark.range(config.cycles).select(
        n.alias("cycle_number"),
        F.concat(F.lit("Cycle_"), n).alias("cycle_id"),
        start.cast("timestamp").alias("period_start"),
        end.cast("timestamp").alias("period_end"),
        window.cast("timestamp").alias("window_start"),
        end.cast("timestamp").alias("snapshot_date"),
        F.when(n == 0, "baseline").otherwise("dynamic").alias("phase"),
    )


def require_coverage(ledger: DataFrame, config: CycleConfig) -> None:
    """Fail unless the ledger starts before the baseline ends and reaches the last cycle."""
    low, high = ledger.agg(F.min("invoice_date"), F.max("invoice_date")).first()
    if low is None or low.date().isoformat() >= config.baseline_end:
        raise ValueError("the ledger has no rows in the baseline cycle")
    last = F.add_months(F.lit(config.end).cast("date"), -1)
    if not ledger.where(F.col("invoice_date") >= last.cast("timestamp")).limit(1).count():
        raise ValueError("the ledger does not reach the last cycle")


def in_periods(ledger: DataFrame, cycles: DataFrame) -> DataFrame:
    """Each row with the one cycle whose period holds it."""
    c = F.broadcast(cycles.select("cycle_number", "period_start", "period_end"))
    return ledger.join(c, (F.col("invoice_date") >= F.col("period_start")) & (F.col("invoice_date") < F.col("period_end"))).drop(
        "period_start", "period_end"
    )


def in_windows(ledger: DataFrame, cycles: DataFrame) -> DataFrame:
    """Each row once for every trailing window that holds it (four at most for monthly 90-day windows)."""
    c = F.broadcast(cycles.select("cycle_number", "window_start", "snapshot_date"))
    return ledger.join(
        c, (F.col("invoice_date") >= F.col("window_start")) & (F.col("invoice_date") < F.col("snapshot_date"))
    ).drop("window_start", "snapshot_date")


def with_first_cycle(rows: DataFrame, cycles: DataFrame, time_col: str) -> DataFrame:
    """Each row with ``first_cycle``, the first cycle whose cutoff lies after it; later rows go."""
    c = F.broadcast(cycles.select(F.col("cycle_number").alias("first_cycle"), "period_start", "snapshot_date"))
    own = (F.col(time_col) < F.col("snapshot_date")) & ((F.col("first_cycle") == 0) | (F.col(time_col) >= F.col("period_start")))
    return rows.join(c, own).drop("period_start", "snapshot_date")


def cycles_from(first, last: int):
    """The cycle numbers from a column to the last one; no cycle where the column lies beyond it."""
    return F.when(first <= last, F.sequence(first, F.lit(last))).otherwise(F.array().cast("array<int>"))


def cycle_number_of(cycle_id):
    """The number in a cycle's name, for ordering by number rather than text."""
    return F.regexp_extract(cycle_id, "([0-9]+)$", 1).try_cast("int")
