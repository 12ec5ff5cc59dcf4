"""The ledger stream against the same rows as a batch."""

from pyspark.sql import functions as F

from segmentflow.operators.cleaning import clean
from segmentflow.plans import state
from segmentflow.streaming import ledger


def test_streamed_days_equal_the_batch(spark, sf_dir, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    raw = state.raw_ledger(spark, sf_dir).where("invoice_date < '1995-06-01'")
    raw.coalesce(1).write.parquet(source)
    days = ledger.sales_by_day(ledger.read_stream(spark, source), "1995-01-01", "1996-01-01")
    query = ledger.write_days(days, out, mark)
    query.awaitTermination(120)
    assert query.exception() is None
    got = {(r.day, r.country): (r.rows, round(r.sales, 2)) for r in spark.read.parquet(out).collect()}
    batch = clean(raw, "1995-01-01", "1996-01-01").groupBy(F.date_trunc("day", "invoice_date").alias("day"), "country").agg(
        F.count("*").alias("rows"), F.sum("total_price").alias("sales")
    )
    want = {(r.day, r.country): (r.rows, round(r.sales, 2)) for r in batch.collect()}
    assert got and all(want[k] == v for k, v in got.items())
    closed = max(k[0] for k in got)
    assert {k for k in want if k[0] <= closed} == set(got)


def test_foreach_batch(spark, sf_dir, tmp_path):
    source, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    state.raw_ledger(spark, sf_dir).write.parquet(source)
    seen = []
    ledger.on_each_batch(ledger.read_stream(spark, source), lambda df, n: seen.append(df.count()), mark).awaitTermination(120)
    assert sum(seen) == spark.read.parquet(source).count()
