"""Country markets: commercial features, behavioural composition, frozen grouping and cross-classes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmentflow.functions.profiles import family, firmographic_label
from segmentflow.operators import clustering, sweep
from segmentflow.operators.calendar import in_windows
from segmentflow.operators.features import Scaling, fit_robust
from segmentflow.operators.summaries import AT_RISK

MARKET_FEATURES = (
    "log_customer_count", "log_revenue", "log_orders_per_customer", "log_revenue_per_customer",
    "log_product_diversity", "repeat_purchase_rate",
)
COMMERCIAL = ("active_customer_count", "revenue", "quantity", "orders", "product_diversity", "repeat_purchase_rate")
SHARES = {
    "champions_share": "Champions",
    "loyalists_share": "Loyalists",
    "mid_tier_share": "Mid-Tier Occasionals",
    "developing_share": "Developing",
    "lost_share": "Hibernating / Lost",
}


def commercial(ledger: DataFrame, cycles: DataFrame) -> DataFrame:
    """Window totals by the transaction's country.

    Invoices are counted per customer first, so a country with most rows is already reduced in parallel.
    """
    keys = ["cycle_number", "country"]
    rows = in_windows(ledger, cycles)
    per_customer = rows.groupBy(*keys, "customer_id").agg(
        F.sum("total_price").alias("revenue"), F.sum("quantity").alias("quantity"), F.count_distinct("purchase_invoice_no").alias("own_orders")
    )
    totals = per_customer.groupBy(*keys).agg(
        F.count("*").alias("active_customer_count"),
        F.sum("revenue").alias("revenue"),
        F.sum("quantity").alias("quantity"),
        F.avg((F.col("own_orders") >= 2).cast("double")).alias("repeat_purchase_rate"),
    )
    breadth = rows.groupBy(*keys).agg(
        F.count_distinct("purchase_invoice_no").alias("orders"), F.count_distinct("description").alias("product_diversity")
    )
    return totals.join(breadth, keys)


def composition(state: DataFrame, asof: DataFrame) -> DataFrame:
    """Customers, family shares and at-risk share by the customer's as-of country."""
    placed = state.join(asof.select("cycle_number", "customer_id", "country"), ["cycle_number", "customer_id"])
    placed = placed.withColumn("family", family(F.col("segment_name")))
    counted = placed.groupBy("cycle_number", "country").agg(
        F.count("*").alias("customer_count"),
        *[(F.count_if(F.col("family") == name) / F.count("*")).alias(c) for c, name in SHARES.items()],
        (F.count_if(F.col("risk_status").isin(*AT_RISK)) / F.count("*")).alias("at_risk_share"),
    )
    named = sum((F.col(c) for c in SHARES), F.lit(0.0))
    return counted.withColumn("other_share", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - named)))


def market_features(ledger: DataFrame, cycles: DataFrame, state: DataFrame, asof: DataFrame) -> DataFrame:
    """Every country seen before a cutoff with its commercial numbers, composition and six features."""
    seen = ledger.groupBy("country").agg(F.min("invoice_date").alias("first_seen"))
    c = F.broadcast(cycles.select("cycle_number", "snapshot_date"))
    countries = seen.join(c, F.col("first_seen") < F.col("snapshot_date")).select("cycle_number", "country")
    keys = ["cycle_number", "country"]
    joined = countries.join(commercial(ledger, cycles), keys, "left").join(composition(state, asof), keys, "left")
    filled = joined.na.fill(0).na.fill(0.0)

    def ratio(a: str, b: str):
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))

    with_ratios = filled.withColumns(
        {"orders_per_customer": ratio("orders", "active_customer_count"), "revenue_per_customer": ratio("revenue", "active_customer_count")}
    )
    return with_ratios.withColumns(
        {
            "log_customer_count": F.log1p(F.col("customer_count").cast("double")),
            "log_revenue": F.log1p(F.greatest("revenue", F.lit(0.0))),
            "log_orders_per_customer": F.log1p("orders_per_customer"),
            "log_revenue_per_customer": F.log1p("revenue_per_customer"),
            "log_product_diversity": F.log1p(F.col("product_diversity").cast("double")),
        }
    )


def cross_classes(state: DataFrame, asof: DataFrame, markets: DataFrame) -> DataFrame:
    """Customers with their as-of country, its market and the combined label; markets are one row per country."""
    placed = state.join(asof.select("cycle_number", "customer_id", "country"), ["cycle_number", "customer_id"], "left")
    # AQE broadcasts the markets: one row per cycle and country.
    return placed.join(markets.select("cycle_number", "country", "market"), ["cycle_number", "country"], "left").withColumn(
        "combined_label", firmographic_label(F.coalesce("market", F.lit("Unassigned")), F.col("segment_name"))
    )


# Grouping of countries, fitted on the baseline cycle and frozen

MARKET_NAMES = ("Largest Revenue Market", "Highest Revenue-per-Customer Market")


def fit_groups(features: DataFrame, most: int = 10, seeds: int = 50) -> tuple[Scaling, np.ndarray, list[dict]]:
    """Robust scaling, ordered centres and the K table from the baseline's countries (a few dozen rows)."""
    base = features.where("cycle_number = 0")
    rows = base.select("country", "revenue", "revenue_per_customer", "repeat_purchase_rate", *MARKET_FEATURES)
    n = rows.count()
    if n < 4:
        raise ValueError("grouping needs four countries")
    if rows.where(" or ".join(f"isnan({c}) or {c} is null" for c in MARKET_FEATURES)).limit(1).count():
        raise ValueError("a market feature is not finite")
    scaling = fit_robust(rows, MARKET_FEATURES)
    points = scaled_points(rows, scaling)
    found = sweep.kmeans(points, list(range(2, min(most, n - 1) + 1)), seeds)
    if len(found) < 3:
        raise ValueError("an elbow needs three numbers of groups without an empty one")
    table = sweep.k_table(points, found, "country", between_ends=True)
    centres = found[next(row["k"] for row in table if row["selected"])].centres
    groups = clustering.nearest(points, centres).groupBy("cluster_index").agg(
        F.sum("revenue").alias("total"), F.avg("revenue_per_customer").alias("spend"), F.avg("repeat_purchase_rate").alias("repeat")
    )
    left = {r["cluster_index"]: r for r in groups.collect()}  # K rows
    order = [max(left, key=lambda i: (left[i]["total"], -i))]
    others = [i for i in left if i not in order]
    if others:
        order.append(max(others, key=lambda i: (left[i]["spend"], -i)))
    order += sorted((i for i in left if i not in order), key=lambda i: (-left[i]["repeat"], -left[i]["total"], i))
    return scaling, centres[order], table


def scaled_points(features: DataFrame, scaling: Scaling) -> DataFrame:
    return scaling.apply(features).withColumn("point", F.array(*[f"scaled_{c}" for c in MARKET_FEATURES]))


def grouped(features: DataFrame, scaling: Scaling, centres: np.ndarray) -> DataFrame:
    """Every country and cycle with the market of its nearest frozen centre."""
    rows = clustering.nearest(scaled_points(features, scaling), centres)
    names = [MARKET_NAMES[i] if i < len(MARKET_NAMES) else f"Country-Market Group {i + 1}" for i in range(len(centres))]
    return rows.withColumn("market", F.get(F.array(*map(F.lit, names)), F.col("cluster_index")))


def group_fit(markets: DataFrame) -> DataFrame:
    """Within-group sum of squares and occupied groups per cycle."""
    return markets.groupBy("cycle_number").agg(
        F.count("*").alias("countries"), F.sum(F.array_min("d2")).alias("wcss"), F.count_distinct("cluster_index").alias("occupied")
    )
