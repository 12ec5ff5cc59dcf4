"""Customer master, as-of country and the customer-by-cycle panel, all cycles in one job.

Rows are pre-aggregated by (customer, day, invoice, product), and windows never multiply them.  What
concerns all history before a cutoff is summed by the first cycle that sees it, and one small array per
customer then gives every cycle's value, so no row of history meets all later cycles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmentflow.operators.calendar import cycles_from, with_first_cycle


def customer_master(ledger: DataFrame) -> DataFrame:
    """First and last purchase, and the country with most rows (ties: A to Z)."""
    by_country = ledger.groupBy("customer_id", "country").agg(
        F.count("*").alias("n"), F.min("invoice_date").alias("first"), F.max("invoice_date").alias("last")
    )
    return by_country.groupBy("customer_id").agg(
        F.min_by("country", F.struct(-F.col("n"), "country")).alias("country"),
        F.min("first").alias("first_purchase"),
        F.max("last").alias("last_purchase"),
    )


def country_asof(ledger: DataFrame, cycles: DataFrame) -> DataFrame:
    """Per cycle and customer, the country with most distinct invoices before the cutoff (ties: A to Z).

    An invoice counts from the first cycle that sees it, so distinct counts over growing histories are
    running sums of first sights instead of one pass over all history per cycle.
    """
    first_seen = ledger.groupBy("customer_id", "country", "purchase_invoice_no").agg(F.min("invoice_date").alias("seen"))
    counted = with_first_cycle(first_seen, cycles, "seen").groupBy("customer_id", "country", "first_cycle").agg(F.count("*").alias("n"))
    last = cycles.agg(F.max("cycle_number")).first()[0]
    # One entry per cycle at most.
    pairs = counted.groupBy("customer_id", "country").agg(F.min("first_cycle").alias("start"), F.collect_list(F.struct("first_cycle", "n")).alias("sights"))

    def upto(c: Column) -> Column:
        return F.aggregate("sights", F.lit(0).cast("long"), lambda s, x: s + F.when(x["first_cycle"] <= c, x["n"]).otherwise(0))

    sums = F.transform(cycles_from(F.col("start"), last), lambda c: F.struct(c.alias("cycle_number"), upto(c).alias("n")))
    running = pairs.select("customer_id", "country", F.explode(sums).alias("s")).select("s.cycle_number", "customer_id", "country", "s.n")
    return running.groupBy("cycle_number", "customer_id").agg(
        F.min_by("country", F.struct(-F.col("n"), "country")).alias("country"),
        F.max("n").alias("country_invoices"),
    )


ROLLING = ("frequency", "monetary", "products", "window_quantity")
CURRENT = ("current_orders", "current_revenue", "current_products", "current_quantity")


def compact(ledger: DataFrame) -> DataFrame:
    """The ledger summed by customer, time, invoice and product: enough for every measure of the panel."""
    return ledger.groupBy("customer_id", "invoice_date", "purchase_invoice_no", "description").agg(
        F.sum("total_price").alias("total_price"), F.sum("quantity").alias("quantity")
    )


#: Cycles told by the bits of one long.
MASK_CYCLES = 60


def activity(rows: DataFrame, cycles: DataFrame, months: int) -> DataFrame:
    """Rolling and current measures per cycle and customer with any.

    Rows are not multiplied by cycles: bits tell the cycles whose window or period holds a row.  An invoice or product
    of a customer unites the bits of its rows, so distinct counts are sums of bits; values are summed by customer and
    bits, of which a calendar has a few dozen.
    """
    calendar = cycles.select("cycle_number", "window_start", "snapshot_date", "period_start", "period_end").orderBy("cycle_number").collect()  # a row per cycle
    parts = [_activity(rows, calendar[i : i + MASK_CYCLES], months) for i in range(0, len(calendar), MASK_CYCLES)]
    return reduce(DataFrame.unionByName, parts)


def _activity(rows: DataFrame, calendar: list, months: int) -> DataFrame:
    def bits(low: str, high: str) -> Column:
        at = F.col("invoice_date")
        held = [F.when((at >= F.lit(c[low])) & (at < F.lit(c[high])), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(calendar)]
        return reduce(lambda a, b: a.bitwiseOR(b), held)

    told = rows.select(
        "customer_id", "purchase_invoice_no", "description", "total_price", "quantity",
        bits("window_start", "snapshot_date").alias("rolls"), bits("period_start", "period_end").alias("counts"),
    ).where("rolls <> 0 or counts <> 0")
    by_bits = [F.coalesce(F.bit_or(f), F.lit(0)).cast("long").alias(f) for f in ("rolls", "counts")]

    def distinct(name: str) -> DataFrame:
        """A row per set of bits and customer, with the number of distinct values that have them."""
        united = told.where(F.col(name).isNotNull()).groupBy("customer_id", name).agg(*by_bits)
        return united.groupBy("customer_id", "rolls", "counts").agg(F.count("*").alias(name))

    sums = told.groupBy("customer_id", "rolls", "counts").agg(F.sum("total_price").alias("total_price"), F.sum("quantity").alias("quantity"))
    values = ("purchase_invoice_no", "total_price", "description", "quantity")
    parts = [df.select("customer_id", "rolls", "counts", *[(F.col(v) if v in df.columns else F.lit(None)).cast("double").alias(v) for v in values])
             for df in (distinct("purchase_invoice_no"), distinct("description"), sums)]
    every = F.explode(F.array(*[F.struct(F.lit(c["cycle_number"]).alias("cycle_number"), F.lit(1 << i).cast("long").alias("bit")) for i, c in enumerate(calendar)])).alias("c")
    placed = reduce(DataFrame.unionByName, parts).select("customer_id", "rolls", "counts", *values, every)
    has = lambda flag: F.col(flag).bitwiseAND(F.col("c.bit")) != 0
    placed = placed.where(has("rolls") | has("counts")).select("c.cycle_number", "customer_id", *values, has("rolls").alias("rolls"), has("counts").alias("counts"))
    measures = [
        (F.coalesce(F.sum(F.when(F.col(flag), F.col(v))), F.lit(0.0)) * F.lit(share)).alias(n)
        for names, flag, share in ((ROLLING, "rolls", 1.0 / months), (CURRENT, "counts", 1.0)) for v, n in zip(values, names)
    ]
    return placed.groupBy("cycle_number", "customer_id").agg(*measures)


def panel(ledger: DataFrame, cycles: DataFrame, months: int = 3) -> DataFrame:
    """One row per cycle and customer known before its cutoff.

    Rolling measures are monthly rates over the trailing window; current measures cover the cycle's own
    period; recency counts days between midnights and has no upper bound; absent activity is zero.
    """
    rows = compact(ledger)
    c = F.broadcast(cycles.select("cycle_number", "period_start", "period_end", "window_start", "snapshot_date"))
    active = activity(rows, cycles, months)
    days = with_first_cycle(rows.select("customer_id", "invoice_date"), cycles, "invoice_date")
    seen = days.groupBy("customer_id", "first_cycle").agg(F.min("invoice_date").alias("first"), F.max("invoice_date").alias("latest"))
    last = cycles.agg(F.max("cycle_number")).first()[0]
    # One entry per cycle at most.
    history = seen.groupBy("customer_id").agg(
        F.min("first_cycle").alias("start"), F.min("first").alias("first_purchase"), F.collect_list(F.struct("first_cycle", "latest")).alias("sights")
    )

    def latest(n: Column) -> Column:
        return F.array_max(F.transform(F.filter("sights", lambda x: x["first_cycle"] <= n), lambda x: x["latest"]))

    values = F.transform(cycles_from(F.col("start"), last), lambda n: F.struct(n.alias("cycle_number"), latest(n).alias("latest_purchase")))
    known = history.select("customer_id", "first_purchase", F.explode(values).alias("v")).select("v.*", "customer_id", "first_purchase")
    joined = (
        known.join(active, ["cycle_number", "customer_id"], "left")
        .na.fill(0.0, [*ROLLING, *CURRENT])
        .join(c, "cycle_number")
    )
    return joined.select("cycle_number", "customer_id", "first_purchase", "latest_purchase", *ROLLING, *CURRENT, *_derived())


def recency_bucket(recency: Column) -> Column:
    return (
        F.when(recency <= 30, "0-30 days")
        .when(recency <= 60, "31-60 days")
        .when(recency <= 90, "61-90 days")
        .otherwise("91+ days: hibernating/lost")
    )


def _derived() -> list[Column]:
    recency = F.datediff(F.to_date("snapshot_date"), F.to_date("latest_purchase"))

    def log(c: Column) -> Column:
        return F.log1p(F.greatest(c, F.lit(0.0)))

    r, f, m = log(recency.cast("double")), log(F.col("frequency")), log(F.col("monetary"))
    return [
        recency.alias("recency"),
        (F.col("latest_purchase") >= F.col("window_start")).cast("int").alias("bought_in_window"),
        F.when(recency > 90, "Hibernating / Lost").otherwise("Within 90-day window").alias("lifecycle_status"),
        F.when(F.col("current_orders") > 0, "Active").otherwise("Inactive").alias("activity_status"),
        ((F.col("first_purchase") >= F.col("period_start")) & (F.col("first_purchase") < F.col("period_end"))).cast("int").alias("is_new"),
        recency_bucket(recency).alias("recency_bucket"),
        r.alias("log_r"),
        f.alias("log_f"),
        m.alias("log_m"),
        (r * f).alias("rf_score"),
        (r * m).alias("rm_score"),
        (f * m).alias("fm_score"),
    ]


RANGES = 200


def running_counts(counts: DataFrame, keys: list[str], value: str, ranges: int = RANGES) -> DataFrame:
    """Distinct values with their ``ties`` become values with ``below`` and ``total``, the rows below them and in all.

    A group's values are cut into ranges at approximate quantiles; each range counts its own, and the few
    sums per range give the offsets, so no task sorts a whole group.
    """
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    cuts = counts.groupBy(*keys).agg(F.percentile_approx(value, shares, 10 * ranges).alias("cuts"))
    # One row per group, such as a cycle.
    placed = counts.join(F.broadcast(cuts), keys).withColumn("part", F.size(F.filter("cuts", lambda c: c < F.col(value)))).drop("cuts")
    sums = placed.groupBy(*keys, "part").agg(F.sum("ties").alias("rows"))
    over = Window.partitionBy(*keys).orderBy("part")  # at most ``ranges`` rows
    offsets = sums.select(
        *keys, "part", F.coalesce(F.sum("rows").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
        F.sum("rows").over(Window.partitionBy(*keys)).alias("total"),
    )
    inside = Window.partitionBy(*keys, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("own", F.coalesce(F.sum("ties").over(inside), F.lit(0)))
        .join(F.broadcast(offsets), [*keys, "part"])
        .select(*keys, value, "ties", (F.col("own") + F.col("offset")).alias("below"), "total")
    )


def rank_share(df: DataFrame, value: str, group: str = "cycle_number", out: str = "rank_share") -> DataFrame:
    """Average-tie percentile rank of a value within its group.

    Equal values are counted first; running counts over ranges of distinct values follow, and one join
    brings the shares back, so a whole group is never sorted in one task.
    """
    counts = df.groupBy(group, value).agg(F.count("*").alias("ties"))
    ranked = running_counts(counts, [group], value)
    shares = ranked.select(group, value, ((F.col("below") + (F.col("ties") + 1) / 2) / F.col("total")).alias(out))
    return df.join(shares, [group, value])


def rank_quartile(share: Column) -> Column:
    """0 to 3 from a percentile rank."""
    return F.least(F.floor(share * 4), F.lit(3)).cast("int")


FEATURES = ("log_r", "log_f", "log_m", "rf_score", "rm_score", "fm_score")
