"""Registered queries of the retail jobs over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmentflow.functions import profiles
from segmentflow.operators import (
    behaviour,
    cleaning,
    features,
    lineage,
    markets,
    order_stats,
    quality,
    registry,
    snapshot,
    summaries,
    validity,
)
from segmentflow.operators.calendar import in_periods, in_windows

from segmentflow.plans import details, fitted, reports, sql
from segmentflow.plans import state as st
from segmentflow.plans.register import ORACLE_SQL, QUERIES, day, per, r, registered

__all__ = ["ORACLE_SQL", "QUERIES", "details", "fitted"]

# Cleaning, calendar, customers


@registered(
    "cleaning_report",
    sql.with_(sql.LEDGER)
    + """SELECT (SELECT count(*) FROM raw) AS raw_rows,
       (SELECT count(*) FROM raw) - (SELECT count(*) FROM (SELECT DISTINCT * FROM raw)) AS duplicates_removed,
       (SELECT count(*) FROM (SELECT DISTINCT * FROM raw)) AS deduplicated_rows, count(*) AS qualifying_rows,
       count(DISTINCT customer_id) AS qualifying_customers, round(sum(total_price), 2) AS qualifying_sales,
       (SELECT count(*) FROM (SELECT DISTINCT * FROM raw)) - count(*) AS rejected_rows FROM ledger""",
)
def cleaning_report(spark, sf_dir):
    return cleaning.cleaning_report(st.raw_ledger(spark, sf_dir), st.CONFIG.baseline_start, st.CONFIG.end)


@registered(
    "cleaning_decisions",
    sql.with_(sql.RAW)
    + """, inside AS (SELECT * FROM raw WHERE invoice_date >= TIMESTAMP '1995-01-01' AND invoice_date < TIMESTAMP '1996-01-01'),
    copies AS (SELECT *, row_number() OVER (PARTITION BY invoice_no, stock_code, description, quantity, invoice_date, unit_price, customer_id, country) AS n FROM inside)
    SELECT count(*) AS rows_in_period,
       count(*) FILTER (quantity < 0 AND invoice_no LIKE 'C%') AS negative_cancellations,
       count(*) FILTER (quantity < 0 AND invoice_no NOT LIKE 'C%') AS negative_other,
       count(*) FILTER (unit_price = 0) AS zero_price, count(*) FILTER (unit_price < 0) AS negative_price,
       count(*) FILTER (customer_id IS NULL AND invoice_no NOT LIKE 'C%') AS unlinked_sales,
       count(*) FILTER (customer_id IS NULL AND invoice_no LIKE 'C%') AS unlinked_reversals,
       count(*) FILTER (n > 1) AS duplicate_rows,
       round(coalesce(sum(quantity * unit_price) FILTER (n > 1), 0), 2) AS duplicate_value FROM copies""",
)
def cleaning_decisions(spark, sf_dir):
    return cleaning.cleaning_decisions(st.raw_ledger(spark, sf_dir), st.CONFIG.baseline_start, st.CONFIG.end)


@registered(
    "sales_by_cycle",
    sql.with_(sql.BASE)
    + """SELECT cycle_number, strftime(period_start, '%Y-%m-%d') AS period_start, strftime(period_end, '%Y-%m-%d') AS period_end,
       strftime(window_start, '%Y-%m-%d') AS window_start, count(DISTINCT invoice_no) AS orders,
       round(coalesce(sum(total_price), 0), 2) AS sales
    FROM cal LEFT JOIN ledger ON invoice_date >= period_start AND invoice_date < period_end GROUP BY ALL""",
)
def sales_by_cycle(spark, sf_dir):
    cycles = st.cycles(spark)
    totals = in_periods(st.ledger(spark, sf_dir), cycles).groupBy("cycle_number").agg(
        F.count_distinct("purchase_invoice_no").alias("orders"), F.sum("total_price").alias("sales")
    )
    return cycles.join(totals, "cycle_number", "left").select(
        "cycle_number", day("period_start"), day("period_end"), day("window_start"),
        F.coalesce("orders", F.lit(0)).alias("orders"), r(F.coalesce("sales", F.lit(0.0)), 2, "sales"),
    )


@registered(
    "customer_master",
    sql.with_(sql.LEDGER)
    + """, c AS (SELECT customer_id, country, count(*) AS n FROM ledger GROUP BY ALL),
    top AS (SELECT customer_id, country FROM c QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, country) = 1)
    SELECT customer_id, any_value(top.country) AS country, strftime(min(invoice_date), '%Y-%m-%d') AS first_purchase,
           strftime(max(invoice_date), '%Y-%m-%d') AS last_purchase FROM ledger JOIN top USING (customer_id) GROUP BY customer_id""",
)
def customer_master(spark, sf_dir):
    master = snapshot.customer_master(st.ledger(spark, sf_dir))
    return master.select("customer_id", "country", day("first_purchase"), day("last_purchase"))


@registered(
    "country_asof", sql.with_(sql.BASE, sql.ASOF) + "SELECT cycle_number, customer_id, country, n AS country_invoices FROM home"
)
def country_asof(spark, sf_dir):
    return st.asof(spark, sf_dir)


MEASURES = (*snapshot.ROLLING, *snapshot.CURRENT)


@registered(
    "rfm_panel",
    sql.with_(sql.PANEL)
    + f"""SELECT cycle_number, customer_id, recency, bought_in_window, is_new, lifecycle_status, activity_status, recency_bucket,
       strftime(first_purchase, '%Y-%m-%d') AS first_purchase, strftime(latest_purchase, '%Y-%m-%d') AS latest_purchase,
       {', '.join(f'round({m}, 4) AS {m}' for m in MEASURES)}, round(log_r, 6) AS log_r, round(log_f, 6) AS log_f, round(log_m, 6) AS log_m,
       round(log_r * log_f, 6) AS rf_score, round(log_r * log_m, 6) AS rm_score, round(log_f * log_m, 6) AS fm_score FROM panel""",
)
def rfm_panel(spark, sf_dir):
    return st.rfm(spark, sf_dir).select(
        "cycle_number", "customer_id", "recency", "bought_in_window", "is_new", "lifecycle_status", "activity_status",
        "recency_bucket", day("first_purchase"), day("latest_purchase"),
        *[r(m) for m in MEASURES], *[r(c, 6) for c in snapshot.FEATURES],
    )


@registered(
    "rank_shares",
    sql.with_(sql.PANEL)
    + """, v AS (SELECT cycle_number, customer_id, round(monetary, 4) AS monetary FROM panel),
    k AS (SELECT *, (rank() OVER w + (count(*) OVER (PARTITION BY cycle_number, monetary) - 1) / 2.0) / count(*) OVER (PARTITION BY cycle_number) AS s
          FROM v WINDOW w AS (PARTITION BY cycle_number ORDER BY monetary))
    SELECT cycle_number, customer_id, round(s::DOUBLE, 6) AS rank_share, least(floor(4 * s::DOUBLE), 3)::INTEGER AS quartile FROM k""",
)
def rank_shares(spark, sf_dir):
    values = st.rfm(spark, sf_dir).select("cycle_number", "customer_id", r("monetary"))
    ranked = snapshot.rank_share(values, "monetary")
    return ranked.select("cycle_number", "customer_id", r("rank_share", 6), snapshot.rank_quartile(F.col("rank_share")).alias("quartile"))


@registered(
    "cycle_overview",
    sql.with_(sql.PANEL)
    + """SELECT cycle_number, count(*) AS customers, count(*) FILTER (current_orders > 0) AS active_customers,
       sum(is_new)::BIGINT AS new_customers, round(sum(current_orders), 4) AS orders, round(sum(current_revenue), 2) AS revenue,
       round(avg(recency), 6) AS mean_recency, round(avg(frequency), 6) AS mean_frequency, round(avg(monetary), 6) AS mean_monetary,
       coalesce(round(sum(current_revenue), 2) / nullif(sum(current_orders), 0), 0) AS average_order_value FROM panel GROUP BY cycle_number""",
)
def cycle_overview(spark, sf_dir):
    return st.rfm(spark, sf_dir).groupBy("cycle_number").agg(
        F.count("*").alias("customers"),
        F.count_if(F.col("current_orders") > 0).alias("active_customers"),
        F.sum("is_new").alias("new_customers"),
        r(F.sum("current_orders"), 4, "orders"),
        r(F.sum("current_revenue"), 2, "revenue"),
        r(F.avg("recency"), 6, "mean_recency"),
        r(F.avg("frequency"), 6, "mean_frequency"),
        r(F.avg("monetary"), 6, "mean_monetary"),
        per(F.sum("current_revenue"), F.sum("current_orders"), "average_order_value"),
    )


FEATURE_SQL = ("log_r", "log_f", "log_m", "log_r * log_f", "log_r * log_m", "log_f * log_m")


@registered(
    "scaled_features",
    sql.with_(sql.PANEL)
    + ", f AS (SELECT cycle_number, customer_id, "
    + ", ".join(f"{e} AS {c}" for e, c in zip(FEATURE_SQL, snapshot.FEATURES))
    + " FROM panel), b AS (SELECT "
    + ", ".join(f"min({c}) AS lo_{c}, max({c}) - min({c}) AS w_{c}" for c in snapshot.FEATURES)
    + " FROM f WHERE cycle_number = 0) SELECT cycle_number, customer_id, "
    + ", ".join(f"round(({c} - lo_{c}) / CASE WHEN w_{c} = 0 THEN 1 ELSE w_{c} END, 6) AS scaled_{c}" for c in snapshot.FEATURES)
    + " FROM f, b",
)
def scaled_features(spark, sf_dir):
    rows = st.rfm(spark, sf_dir)
    scaling = features.fit_min_max(rows.where("cycle_number = 0"))
    return scaling.apply(rows).select("cycle_number", "customer_id", *[r(f"scaled_{c}", 6) for c in snapshot.FEATURES])


@registered("principal_components")
def principal_components(spark, sf_dir):
    rows = st.rfm(spark, sf_dir)
    scaled = features.fit_min_max(rows.where("cycle_number = 0")).apply(rows)
    columns = tuple(f"scaled_{c}" for c in snapshot.FEATURES)
    return features.fit_pca(scaled.where("cycle_number = 0"), columns).apply(scaled).select("cycle_number", "customer_id", "pc1", "pc2", "pc3")


# Segments and behaviour


@registered(
    "memberships",
    sql.with_(sql.STATE)
    + """SELECT cycle_number, customer_id, idx::INTEGER AS cluster_index, stable_cluster_id, segment_name, round(u0, 6) AS u0,
       round(u1, 6) AS u1, round(u2, 6) AS u2, round(u3, 6) AS u3, round(top_membership, 6) AS top_membership FROM state""",
)
def memberships(spark, sf_dir):
    return st.segments(spark, sf_dir).select(
        "cycle_number", "customer_id", "cluster_index", "stable_cluster_id", "segment_name",
        *[r(F.get("u", F.lit(k)), 6, f"u{k}") for k in range(4)], r("top_membership", 6),
    )


@registered(
    "transitions",
    sql.with_(sql.STATE)
    + f"""SELECT cycle_number, customer_id, stable_cluster_id, prev_id AS prev_stable_cluster_id, transition_status,
       CASE transition_status WHEN 'New' THEN 'New' WHEN 'Existing Migrated' THEN 'Migrated' ELSE 'Stable' END AS migration_status,
       CASE WHEN is_new = 1 OR prev_id IS NULL THEN 'New' WHEN activity_status = 'Inactive' THEN 'Inactive'
            WHEN prev_activity = 'Inactive' THEN 'Reactivated' WHEN stable_cluster_id <> prev_id THEN 'Existing Migrated' ELSE 'Existing Stable' END AS activity_transition,
       round(sqrt(pow(log_r - prev_log_r, 2) + pow(log_f - prev_log_f, 2) + pow(log_m - prev_log_m, 2)), 6) AS displacement,
       CASE WHEN prev_id IS NULL THEN 'No prior cycle' WHEN stable_cluster_id = prev_id THEN 'No migration'
            WHEN o = prev_idx THEN 'Cluster boundary change' ELSE 'Customer feature change' END AS migration_cause
    FROM (SELECT *, {sql.index_of('e0 e1 e2 e3')} AS o FROM (SELECT *, """
    + ", ".join(
        f"pow(log_r - ({a} + (cycle_number - 1) * {st.DRIFT}), 2) + pow(log_f - {b}, 2) + pow(log_m - {c}, 2) AS e{k}"
        for k, (a, b, c) in enumerate(st.CENTRES)
    )
    + " FROM state))",
)
def transitions(spark, sf_dir):
    rows = st.state(spark, sf_dir)
    old = st.centres_at(F.col("cycle_number") - 1)
    return rows.select(
        "cycle_number", "customer_id", "stable_cluster_id", "prev_stable_cluster_id", "transition_status",
        behaviour.migration_status(F.col("transition_status")).alias("migration_status"),
        behaviour.transition("activity").alias("activity_transition"),
        r(behaviour.displacement(), 6, "displacement"),
        behaviour.migration_cause(old, st.literal(st.IDS)).alias("migration_cause"),
    )


@registered(
    "customer_risk",
    sql.with_(sql.STATE)
    + """SELECT cycle_number, customer_id, risk_status, risk_reasons, round(membership_change, 6) AS membership_change,
       round(frequency_change, 6) AS frequency_change, round(monetary_change, 6) AS monetary_change FROM state""",
)
def customer_risk(spark, sf_dir):
    return st.state(spark, sf_dir).select(
        "cycle_number", "customer_id", "risk_status", "risk_reasons",
        *[r(c, 6) for c in ("membership_change", "frequency_change", "monetary_change")],
    )


@registered(
    "migration_attribution",
    sql.with_(sql.STATE)
    + ", alt AS (SELECT *, "
    + ", ".join(
        f"pow(log_r - ({a} + (cycle_number - 1) * {st.DRIFT}), 2) + pow(log_f - {b}, 2) + pow(log_m - {c}, 2) AS e{k}, "
        f"pow(prev_log_r - ({a} + cycle_number * {st.DRIFT}), 2) + pow(prev_log_f - {b}, 2) + pow(prev_log_m - {c}, 2) AS g{k}"
        for k, (a, b, c) in enumerate(st.CENTRES)
    )
    + f""" FROM state WHERE prev_id IS NOT NULL), x AS (
    SELECT cycle_number, idx <> prev_idx AS m, {sql.index_of('e0 e1 e2 e3')} <> prev_idx AS f, {sql.index_of('g0 g1 g2 g3')} <> prev_idx AS c,
           segment_name <> prev_name AS renamed,
           greatest(abs(recency - prev_recency)::DOUBLE, abs(frequency - prev_frequency), abs(monetary - prev_monetary)) <= 1e-10 AS unchanged FROM alt)
    SELECT cycle_number, count(*) AS compared, count(*) FILTER (m) AS migrated, count(*) FILTER (m AND f AND NOT c) AS behaviour_only,
           count(*) FILTER (m AND NOT f AND c) AS boundary_only, count(*) FILTER (m AND f AND c) AS either,
           count(*) FILTER (m AND NOT f AND NOT c) AS interaction, count(*) FILTER (NOT m AND renamed) AS renamed_only,
           count(*) FILTER (m AND unchanged) AS unchanged_migrants FROM x GROUP BY cycle_number""",
)
def migration_attribution(spark, sf_dir):
    return behaviour.migration_attribution(
        st.state(spark, sf_dir), st.centres_at(F.col("cycle_number") - 1), st.centres_at(F.col("cycle_number"))
    )


@registered(
    "carry_over_mass",
    sql.with_(sql.ASSIGNED)
    + """, buying AS (SELECT * FROM assigned WHERE bought_in_window = 1)
    SELECT (a.cycle_number + 1)::INTEGER AS cycle_number, a.stable_cluster_id, count(*) AS customers, round(sum(greatest(u0, u1, u2, u3)), 4) AS mass
    FROM buying a WHERE a.cycle_number < 9 AND NOT EXISTS (SELECT 1 FROM buying b WHERE b.customer_id = a.customer_id AND b.cycle_number = a.cycle_number + 1)
    GROUP BY ALL""",
)
def carry_over_mass(spark, sf_dir):
    """Membership mass left behind by the customers of a window who buy nothing in the next one."""
    rows = st.segments(spark, sf_dir).where("bought_in_window = 1")
    return behaviour.vanished(rows).groupBy("cycle_number", "stable_cluster_id").agg(
        F.count("*").alias("customers"), r(F.sum(F.array_max("u")), 4, "mass")
    )


@registered(
    "centre_profiles",
    sql.with_(sql.ASSIGNED)
    + """, long AS (SELECT cycle_number, k::INTEGER AS k, CASE k WHEN 0 THEN u0 WHEN 1 THEN u1 WHEN 2 THEN u2 ELSE u3 END AS u,
              CASE k WHEN 0 THEN d0 WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END AS d, idx, recency, frequency, monetary FROM assigned, range(4) AS t(k))
    SELECT cycle_number, k AS cluster_index, round(sum(u * u * recency) / sum(u * u), 4) AS recency, round(sum(u * u * frequency) / sum(u * u), 4) AS frequency,
           round(sum(u * u * monetary) / sum(u * u), 3) AS monetary, round(sum(u), 4) AS membership_mass, count(*) FILTER (idx = k) AS winners,
           (sum(u) > 1e-8 AND count(*) FILTER (idx = k) = 0) AS soft_only, round(sum(u * u * d), 3) AS objective_share,
           round(coalesce(sum(d) FILTER (idx = k), 0), 3) AS hard_sse, round(coalesce(avg(sqrt(d)) FILTER (idx = k), 0), 5) AS mean_distance,
           round(coalesce(max(sqrt(d)) FILTER (idx = k), 0), 5) AS max_distance, round(avg(u) FILTER (idx = k), 6) AS mean_membership, round(coalesce(quantile_cont(sqrt(d), 0.95) FILTER (idx = k), 0), 5) AS p95_distance
    FROM long GROUP BY cycle_number, k HAVING sum(u * u) > 0""",
)
def centre_profiles(spark, sf_dir):
    rows = st.segments(spark, sf_dir)
    long = rows.select(
        "cycle_number", "cluster_index", "recency", "frequency", "monetary", F.posexplode(F.arrays_zip("u", "d2")).alias("k", "c")
    ).select("*", F.col("c.u").alias("m"), F.col("c.d2").alias("d"))
    won, weight = F.col("cluster_index") == F.col("k"), F.col("m") * F.col("m")
    own = long.where(won).select("cycle_number", F.col("k").alias("cluster"), F.sqrt("d").alias("distance"))
    far = order_stats.order_statistics(own, ["cycle_number", "cluster"], "distance", {"p95": 0.95}, linear=True)
    return (
        long.groupBy("cycle_number", F.col("k").alias("cluster"))
        .agg(
            *[r(F.try_divide(F.sum(weight * F.col(x)), F.sum(weight)), n, x) for x, n in (("recency", 4), ("frequency", 4), ("monetary", 3))],
            r(F.sum("m"), 4, "membership_mass"),
            F.count_if(won).alias("winners"),
            ((F.sum("m") > 1e-8) & (F.count_if(won) == 0)).alias("soft_only"),
            r(F.sum(weight * F.col("d")), 3, "objective_share"),
            r(F.coalesce(F.sum(F.when(won, F.col("d"))), F.lit(0.0)), 3, "hard_sse"),
            r(F.coalesce(F.avg(F.when(won, F.sqrt("d"))), F.lit(0.0)), 5, "mean_distance"),
            r(F.coalesce(F.max(F.when(won, F.sqrt("d"))), F.lit(0.0)), 5, "max_distance"),
            r(F.avg(F.when(won, F.col("m"))), 6, "mean_membership"),
            F.sum(weight).alias("weight"),
        )
        .where("weight > 0")
        .join(far, ["cycle_number", "cluster"], "left")
        .withColumn("p95_distance", r(F.coalesce("p95", F.lit(0.0)), 5, "p95_distance"))
        .drop("weight", "p95", "n")
        .withColumnRenamed("cluster", "cluster_index")
    )


@registered(
    "fuzzy_objective",
    sql.with_(sql.ASSIGNED)
    + """SELECT cycle_number, count(*) AS n, round(sum(u0 * u0 * d0 + u1 * u1 * d1 + u2 * u2 * d2 + u3 * u3 * d3), 3) AS objective,
       round(sum(u0 * u0 * d0 + u1 * u1 * d1 + u2 * u2 * d2 + u3 * u3 * d3) / (count(*) * 1.8), 5) AS xie_beni,
       count(*) FILTER (greatest(abs(u0 - 0.25), abs(u1 - 0.25), abs(u2 - 0.25), abs(u3 - 0.25)) <= 0.05) AS ambiguous_rows,
       round(sum(least(d0, d1, d2, d3)), 3) AS hard_inertia FROM assigned GROUP BY cycle_number""",
)
def fuzzy_objective(spark, sf_dir):
    """Fuzzy objective, Xie-Beni index over the least squared separation of the stated centres, and even memberships."""
    least = min(sum((x - y) ** 2 for x, y in zip(a, b)) for i, a in enumerate(st.CENTRES) for b in st.CENTRES[:i])
    j = F.aggregate(F.zip_with("u", "d2", lambda u, d: u * u * d), F.lit(0.0), lambda s, x: s + x)
    even = F.array_max(F.transform("u", lambda u: F.abs(u - 0.25))) <= 0.05
    return st.segments(spark, sf_dir).groupBy("cycle_number").agg(
        F.count("*").alias("n"),
        r(F.sum(j), 3, "objective"),
        r(F.sum(j) / (F.count("*") * F.lit(round(least, 9))), 5, "xie_beni"),
        F.count_if(even).alias("ambiguous_rows"),
        r(F.sum(F.array_min("d2")), 3, "hard_inertia"),
    )


@registered(
    "identity_overlap",
    sql.with_(sql.ASSIGNED)
    + """, shared AS (SELECT a.cycle_number, i, j, list_extract([b.u0, b.u1, b.u2, b.u3], i + 1) AS p, list_extract([a.u0, a.u1, a.u2, a.u3], j + 1) AS q
        FROM assigned a JOIN assigned b ON b.customer_id = a.customer_id AND b.cycle_number = a.cycle_number - 1, range(4) AS x(i), range(4) AS y(j))
    SELECT cycle_number, i::INTEGER AS previous_index, j::INTEGER AS current_index, round(sum(least(round(p, 8), q)) / sum(greatest(round(p, 8), q)), 5) AS fuzzy_jaccard
    FROM shared GROUP BY ALL HAVING sum(greatest(round(p, 8), q)) > 0""",
)
def identity_overlap(spark, sf_dir):
    """Fuzzy Jaccard of each earlier with each later cluster over shared customers."""
    paired = behaviour.with_previous(st.segments(spark, sf_dir)).where("prev_u is not null")
    return lineage.fuzzy_overlap(paired).select("cycle_number", "previous_index", "current_index", r("fuzzy_jaccard", 5))


# Summaries and reports


@registered(
    "customer_period_summary",
    sql.with_(sql.STATE)
    + """SELECT cycle_number, customer_id, segment_name, risk_status, round(current_orders, 4) AS orders, round(current_revenue, 2) AS revenue,
       coalesce(round(current_revenue, 2) / nullif(current_orders, 0), 0) AS average_basket_value FROM state""",
)
def customer_period_summary(spark, sf_dir):
    return summaries.customer_summary(st.state(spark, sf_dir)).select(
        "cycle_number", "customer_id", "segment_name", "risk_status", r("orders"), r("revenue", 2), per("revenue", "orders", "average_basket_value")
    )


@registered(
    "segment_summary",
    sql.with_(sql.STATE)
    + """SELECT cycle_number, stable_cluster_id, segment_name, count(*) AS customers, round(sum(current_orders), 4) AS orders, round(sum(current_quantity), 4) AS quantity,
       round(sum(current_revenue), 2) AS revenue, round(avg(top_membership), 6) AS average_membership, count(*) FILTER (risk_status IN ('At risk', 'Slipping')) AS at_risk_customers,
       round(count(*) FILTER (risk_status IN ('At risk', 'Slipping')) / count(*)::DOUBLE, 6) AS at_risk_share,
       coalesce(round(sum(current_revenue), 2) / nullif(sum(current_orders), 0), 0) AS average_order_value, round(sum(current_revenue), 2) / count(*) AS revenue_per_customer
    FROM state GROUP BY ALL""",
)
def segment_summary(spark, sf_dir):
    found = summaries.segment_summary(summaries.customer_summary(st.state(spark, sf_dir)))
    return found.select(
        "cycle_number", "stable_cluster_id", "segment_name", "customers", r("orders"), r("quantity"), r("revenue", 2),
        r("average_membership", 6), "at_risk_customers", r("at_risk_share", 6), per("revenue", "orders", "average_order_value"), per("revenue", "customers", "revenue_per_customer"),
    )


@registered(
    "product_summary",
    sql.with_(sql.STATE, sql.ROWS)
    + """SELECT cycle_number, stable_cluster_id, segment_name, description, round(sum(quantity), 4) AS quantity, round(sum(total_price), 2) AS revenue,
       count(DISTINCT customer_id) AS customers, count(DISTINCT invoice_no) AS orders, round(avg(unit_price), 6) AS average_price FROM labelled GROUP BY ALL""",
)
def product_summary(spark, sf_dir):
    rows = summaries.labelled_rows(st.ledger(spark, sf_dir), st.cycles(spark), st.segments(spark, sf_dir))
    return summaries.product_summary(rows).select(
        "cycle_number", "stable_cluster_id", "segment_name", "description", r("quantity"), r("revenue", 2), "customers", "orders", r("average_price", 6)
    )


@registered(
    "top_products_by_segment",
    sql.with_(sql.STATE, sql.ROWS)
    + """, t AS (SELECT segment_name, description, round(sum(total_price), 2) AS revenue FROM labelled GROUP BY ALL)
    SELECT segment_name, description, revenue, row_number() OVER (PARTITION BY segment_name ORDER BY revenue DESC, description)::INTEGER AS place
    FROM t QUALIFY place <= 5""",
)
def top_products_by_segment(spark, sf_dir):
    rows = summaries.labelled_rows(st.ledger(spark, sf_dir), st.cycles(spark), st.segments(spark, sf_dir))
    totals = rows.groupBy("segment_name", "description").agg(r(F.sum("total_price"), 2, "revenue"))
    order = Window.partitionBy("segment_name").orderBy(F.desc("revenue"), "description")
    return totals.withColumn("place", F.row_number().over(order)).where("place <= 5")


@registered(
    "risk_by_segment",
    sql.with_(sql.STATE)
    + """SELECT cycle_number, segment_name, count(*) FILTER (risk_status IN ('At risk', 'Slipping', 'No risk flag')) AS assessed,
       count(*) FILTER (risk_status IN ('At risk', 'Slipping')) AS flagged, count(*) FILTER (risk_status = 'Lost') AS lost,
       round(count(*) FILTER (risk_status IN ('At risk', 'Slipping')) / nullif(count(*) FILTER (risk_status IN ('At risk', 'Slipping', 'No risk flag')), 0)::DOUBLE, 6) AS rate
    FROM state GROUP BY ALL""",
)
def risk_by_segment(spark, sf_dir):
    flagged = F.col("risk_status").isin(*summaries.AT_RISK)
    assessed = flagged | (F.col("risk_status") == "No risk flag")
    return st.state(spark, sf_dir).groupBy("cycle_number", "segment_name").agg(
        F.count_if(assessed).alias("assessed"),
        F.count_if(flagged).alias("flagged"),
        F.count_if(F.col("risk_status") == "Lost").alias("lost"),
        r(F.try_divide(F.count_if(flagged).cast("double"), F.count_if(assessed)), 6, "rate"),
    )


@registered(
    "value_and_confidence_bands",
    sql.with_(sql.STATE)
    + """SELECT cycle_number, CASE WHEN current_revenue < 250 THEN '<250' WHEN current_revenue < 750 THEN '250-750' WHEN current_revenue < 2000 THEN '750-2000' ELSE '2000+' END AS value_band,
       CASE WHEN cycle_number = 0 THEN 'Baseline' WHEN top_membership < 0.55 THEN '<0.55' WHEN top_membership < 0.75 THEN '0.55-0.75' ELSE '0.75+' END AS confidence_band,
       count(*) AS customers, round(sum(current_revenue), 2) AS revenue FROM state GROUP BY ALL""",
)
def value_and_confidence_bands(spark, sf_dir):
    return (
        st.segments(spark, sf_dir)
        .groupBy(
            "cycle_number",
            profiles.value_band(F.col("current_revenue")).alias("value_band"),
            profiles.confidence_band(F.col("top_membership"), F.col("cycle_number") == 0).alias("confidence_band"),
        )
        .agg(F.count("*").alias("customers"), r(F.sum("current_revenue"), 2, "revenue"))
    )


@registered(
    "migration_matrix",
    sql.with_(sql.STATE)
    + """SELECT prev_name AS from_segment, segment_name AS to_segment, count(*) AS customers,
       CASE WHEN list_position(['Champions', 'Loyalists', 'Mid-Tier Occasionals', 'Hibernating / Lost'], segment_name) < list_position(['Champions', 'Loyalists', 'Mid-Tier Occasionals', 'Hibernating / Lost'], prev_name) THEN 'upward'
            WHEN segment_name = prev_name THEN 'same' ELSE 'downward' END AS direction
    FROM state WHERE prev_name IS NOT NULL GROUP BY ALL""",
)
def migration_matrix(spark, sf_dir):
    to, back = profiles.display_rank(F.col("segment_name")), profiles.display_rank(F.col("prev_segment_name"))
    direction = F.when(to < back, "upward").when(to == back, "same").otherwise("downward")
    rows = st.state(spark, sf_dir).where("prev_segment_name is not null")
    return rows.groupBy(
        F.col("prev_segment_name").alias("from_segment"), F.col("segment_name").alias("to_segment"), direction.alias("direction")
    ).agg(F.count("*").alias("customers"))


@registered(
    "transition_evolution",
    sql.with_(sql.STATE)
    + """SELECT cycle_number, count(*) FILTER (transition_status = 'New') AS new, count(*) FILTER (transition_status = 'Existing Stable') AS existing_stable,
       count(*) FILTER (transition_status = 'Existing Migrated') AS existing_migrated FROM state GROUP BY cycle_number""",
)
def transition_evolution(spark, sf_dir):
    names = ["New", "Existing Stable", "Existing Migrated"]
    wide = st.state(spark, sf_dir).groupBy("cycle_number").pivot("transition_status", names).count().na.fill(0)
    return wide.select("cycle_number", *[F.col(n).alias(n.lower().replace(" ", "_")) for n in names])


@registered(
    "feature_summary",
    sql.with_(sql.PANEL)
    + """, v AS (SELECT cycle_number, f, CASE f WHEN 'recency' THEN recency::DOUBLE WHEN 'frequency' THEN round(frequency, 4) ELSE round(monetary, 4) END AS x
              FROM panel, (VALUES ('recency'), ('frequency'), ('monetary')) AS t(f)),
    o AS (SELECT *, row_number() OVER (PARTITION BY cycle_number, f ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY cycle_number, f) AS n FROM v)
    SELECT cycle_number, f AS feature, count(*) AS n, min(x) AS low, max(x) AS high, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd,
       max(x) FILTER (i = floor((n - 1) * 0.25)) AS q1, max(x) FILTER (i = floor((n - 1) * 0.5)) AS median, max(x) FILTER (i = floor((n - 1) * 0.75)) AS q3
    FROM o GROUP BY cycle_number, f""",
)
def feature_summary(spark, sf_dir):
    """Per cycle and feature: moments and lower-index quantiles."""
    values = st.rfm(spark, sf_dir).select(
        "cycle_number",
        F.expr("stack(3, 'recency', cast(recency as double), 'frequency', round(frequency, 4), 'monetary', round(monetary, 4)) as (feature, x)"),
    )
    keys = ["cycle_number", "feature"]
    moments = values.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), r(F.avg("x"), 6, "mean"), r(F.stddev_samp("x"), 6, "sd")
    )
    return moments.join(order_stats.order_statistics(values, keys, "x", {"q1": 0.25, "median": 0.5, "q3": 0.75}).drop("n"), keys)


@registered(
    "feature_correlation",
    sql.with_(sql.PANEL)
    + ", f AS (SELECT cycle_number, "
    + ", ".join(f"{e} AS {c}" for e, c in zip(FEATURE_SQL, snapshot.FEATURES))
    + " FROM panel) "
    + " UNION ALL ".join(
        f"SELECT cycle_number, '{a}' AS feature_a, '{b}' AS feature_b, round(coalesce(CASE WHEN stddev_pop({a}) > 1e-9 AND stddev_pop({b}) > 1e-9 THEN corr({a}, {b}) END, 0), 4) AS correlation FROM f GROUP BY cycle_number"
        for i, a in enumerate(snapshot.FEATURES)
        for b in snapshot.FEATURES[i + 1 :]
    ),
)
def feature_correlation(spark, sf_dir):
    """Pearson correlation of each pair of features per cycle, zero where undefined; one aggregation."""
    pairs = [(a, b) for i, a in enumerate(snapshot.FEATURES) for b in snapshot.FEATURES[i + 1 :]]

    def one(a: str, b: str) -> Column:
        defined = (F.stddev_pop(a) > 1e-9) & (F.stddev_pop(b) > 1e-9)
        value = F.when(defined, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))
        return F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), r(F.coalesce(value, F.lit(0.0)), 4, "correlation"))

    wide = st.rfm(spark, sf_dir).groupBy("cycle_number").agg(*[one(a, b).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    return wide.select("cycle_number", F.explode(F.array(*[f"p{i}" for i in range(len(pairs))])).alias("p")).select("cycle_number", "p.*")


@registered(
    "market_features",
    sql.with_(sql.STATE, sql.ASOF)
    + """, win AS (SELECT cycle_number, l.* FROM ledger l JOIN cal ON invoice_date >= window_start AND invoice_date < period_end),
    own AS (SELECT cycle_number, country, customer_id, count(DISTINCT invoice_no) AS n FROM win GROUP BY ALL),
    rep AS (SELECT cycle_number, country, avg((n >= 2)::INTEGER) AS repeat_purchase_rate FROM own GROUP BY ALL),
    com AS (SELECT cycle_number, country, count(DISTINCT customer_id) AS active, sum(total_price) AS revenue, sum(quantity) AS quantity, count(DISTINCT invoice_no) AS orders, count(DISTINCT description) AS breadth FROM win GROUP BY ALL),
    mix AS (SELECT s.cycle_number, a.country, count(*) AS customers, count(*) FILTER (segment_name = 'Champions') AS ch, count(*) FILTER (segment_name = 'Loyalists') AS lo,
                   count(*) FILTER (segment_name = 'Mid-Tier Occasionals') AS mi, count(*) FILTER (segment_name = 'Hibernating / Lost') AS hi, count(*) FILTER (risk_status IN ('At risk', 'Slipping')) AS ri
            FROM state s JOIN home a USING (cycle_number, customer_id) GROUP BY ALL),
    seen_c AS (SELECT DISTINCT cycle_number, country FROM ledger JOIN cal ON invoice_date < period_end)
    SELECT cycle_number, country, coalesce(customers, 0)::BIGINT AS customer_count, coalesce(active, 0)::BIGINT AS active_customer_count, round(coalesce(revenue, 0), 2) AS revenue, coalesce(orders, 0)::BIGINT AS orders,
           coalesce(breadth, 0)::BIGINT AS product_diversity, round(coalesce(repeat_purchase_rate, 0), 6) AS repeat_purchase_rate,
           coalesce(round(revenue, 2) / nullif(active, 0), 0) AS revenue_per_customer, round(coalesce(orders / nullif(active, 0)::DOUBLE, 0), 6) AS orders_per_customer,
           round(coalesce(ch / customers::DOUBLE, 0), 6) AS champions_share, round(coalesce(lo / customers::DOUBLE, 0), 6) AS loyalists_share, round(coalesce(mi / customers::DOUBLE, 0), 6) AS mid_tier_share,
           0.0::DOUBLE AS developing_share, round(coalesce(greatest(0, 1 - (ch + lo + mi + hi) / customers::DOUBLE), 0), 6) AS other_share, round(coalesce(quantity, 0), 2) AS quantity,
           round(coalesce(hi / customers::DOUBLE, 0), 6) AS lost_share, round(coalesce(ri / customers::DOUBLE, 0), 6) AS at_risk_share, round(ln(1 + coalesce(revenue, 0)), 6) AS log_revenue
    FROM seen_c LEFT JOIN com USING (cycle_number, country) LEFT JOIN rep USING (cycle_number, country) LEFT JOIN mix USING (cycle_number, country)""",
)
def market_features(spark, sf_dir):
    found = markets.market_features(st.ledger(spark, sf_dir), st.cycles(spark), st.state(spark, sf_dir), st.asof(spark, sf_dir))
    return found.select(
        "cycle_number", "country", "customer_count", "active_customer_count", r("revenue", 2), "orders", "product_diversity",
        r("repeat_purchase_rate", 6), per("revenue", "active_customer_count", "revenue_per_customer"), r("orders_per_customer", 6),
        *[r(c, 6) for c in ("champions_share", "loyalists_share", "mid_tier_share", "developing_share", "lost_share", "other_share", "at_risk_share", "log_revenue")],
        r("quantity", 2),
    )


@registered(
    "market_behaviour_matrix",
    sql.with_(sql.STATE, sql.ASOF)
    + """, joined AS (SELECT s.cycle_number, CASE WHEN country < 'I' THEN 'Early' ELSE 'Late' END AS market, segment_name, risk_status FROM state s JOIN home USING (cycle_number, customer_id))
    SELECT cycle_number, market, market || ' / ' || segment_name AS combined_label, count(*) AS customers FROM joined GROUP BY ALL""",
)
def market_behaviour_matrix(spark, sf_dir):
    """Customers by market and behaviour; the markets here are stated by the country's name."""
    asof = st.asof(spark, sf_dir)
    grouped = asof.select("cycle_number", "country").distinct().withColumn("market", F.when(F.col("country") < "I", "Early").otherwise("Late"))
    classes = markets.cross_classes(st.segments(spark, sf_dir), asof, grouped)
    return classes.groupBy("cycle_number", "market", "combined_label").agg(F.count("*").alias("customers"))


@registered(
    "matched_reversals",
    sql.with_(sql.RAW, sql.REVERSED)
    + """SELECT year(invoice_date)::INTEGER AS year, count(*) FILTER (quantity < 0) AS return_rows, count(*) FILTER (consumed > 0) AS matched_rows, round(coalesce(sum(consumed), 0), 4) AS matched_units,
           round(coalesce(sum(consumed * unit_price), 0), 2) AS matched_value, count(DISTINCT CASE WHEN consumed > 0 THEN customer_id END) AS matched_customers FROM c GROUP BY ALL""",
)
def matched_reversals(spark, sf_dir):
    """Returns per year and how many of their units meet earlier purchases."""
    matched = st.reversed_rows(spark, sf_dir)
    hit = F.col("consumed") > 0
    return matched.groupBy(F.year("invoice_date").alias("year")).agg(
        F.count_if(F.col("quantity") < 0).alias("return_rows"),
        F.count_if(hit).alias("matched_rows"),
        r(F.sum("consumed"), 4, "matched_units"),
        r(F.sum(F.col("consumed") * F.col("unit_price")), 2, "matched_value"),
        F.count_distinct(F.when(hit, F.col("customer_id"))).alias("matched_customers"),
    )


# Fitted clusters: random starts and iterations, so rows only


@registered("dynamic_clusters")
def dynamic_clusters(spark, sf_dir):
    """Assignments of every cycle by the K-means baseline and the fuzzy updates."""
    return st.fitted_run(spark, sf_dir)["assignments"].select("cycle_number", "customer_id", "cluster_index", "stable_cluster_id", "segment_name", "top_membership")


@registered(
    "cluster_scores",
    sql.with_(sql.ASSIGNED)
    + """, g AS (SELECT cycle_number, idx, count(*) AS n, avg(log_r) AS a, avg(log_f) AS b, avg(log_m) AS c, avg(log_r * log_r + log_f * log_f + log_m * log_m) AS q FROM assigned GROUP BY ALL),
    away AS (SELECT s.cycle_number, s.customer_id, s.idx, g.idx AS k, g.n, greatest(0, s.log_r * s.log_r + s.log_f * s.log_f + s.log_m * s.log_m - 2 * (s.log_r * a + s.log_f * b + s.log_m * c) + q) AS d FROM assigned s JOIN g USING (cycle_number)),
    ab AS (SELECT cycle_number, customer_id, any_value(idx) AS idx, max(CASE WHEN k = idx THEN n END) AS n, max(CASE WHEN k = idx AND n > 1 THEN d * n / (n - 1) END) AS i, min(CASE WHEN k <> idx THEN d END) AS o FROM away GROUP BY cycle_number, customer_id)
    SELECT cycle_number, idx::INTEGER AS cluster_index, count(*) AS customers, round(avg(CASE WHEN n = 1 THEN 0 ELSE (o - i) / nullif(greatest(o, i), 0) END), 5) AS mean_silhouette FROM ab GROUP BY ALL""",
)
def cluster_scores(spark, sf_dir):
    rows = st.segments(spark, sf_dir).select("cycle_number", "customer_id", "cluster_index", "point")
    scored = validity.squared_silhouette(rows, ["cycle_number"])
    return scored.groupBy("cycle_number", "cluster_index").agg(F.count("*").alias("customers"), r(F.avg("silhouette"), 5, "mean_silhouette"))


@registered(
    "cohort_quality",
    sql.with_(sql.STATE)
    + """, c AS (SELECT cycle_number, idx, top_membership, unnest(list_filter(['All customers', CASE WHEN current_orders > 0 THEN 'Purchased this month' END,
        CASE WHEN recency <= 90 THEN 'Purchased within 90 days' END, CASE WHEN recency > 90 THEN 'No purchase for over 90 days' END], lambda x: x IS NOT NULL)) AS cohort FROM state)
    SELECT cycle_number, cohort, count(*) AS customers, count(DISTINCT idx) AS occupied, round(avg(top_membership), 6) AS mean_membership FROM c GROUP BY ALL""",
)
def cohort_quality(spark, sf_dir):
    rows = st.segments(spark, sf_dir).withColumn("cohort", F.explode(validity.cohorts()))
    return rows.groupBy("cycle_number", "cohort").agg(
        F.count("*").alias("customers"), F.count_distinct("cluster_index").alias("occupied"), r(F.avg("top_membership"), 6, "mean_membership")
    )


@registered(
    "dashboard_overview",
    sql.with_(sql.STATE)
    + """SELECT CASE WHEN grouping(cycle_number) = 1 THEN 'all' ELSE 'Cycle_' || cycle_number END AS scope, count(DISTINCT customer_id) AS customers, round(sum(current_orders), 4) AS orders,
       round(sum(current_revenue), 2) AS revenue, count(*) FILTER (risk_status IN ('At risk', 'Slipping')) AS at_risk,
       round(avg(CASE WHEN cycle_number > 0 THEN top_membership END), 6) AS mean_membership FROM state GROUP BY GROUPING SETS ((cycle_number), ())""",
)
def dashboard_overview(spark, sf_dir):
    """Totals per cycle and overall in one pass; baseline memberships are crisp and stay out of the mean."""
    rows = st.state(spark, sf_dir).rollup("cycle_number").agg(
        F.count_distinct("customer_id").alias("customers"),
        r(F.sum("current_orders"), 4, "orders"),
        r(F.sum("current_revenue"), 2, "revenue"),
        F.count_if(F.col("risk_status").isin(*summaries.AT_RISK)).alias("at_risk"),
        r(F.avg(F.when(F.col("cycle_number") > 0, F.col("top_membership"))), 6, "mean_membership"),
    )
    return rows.withColumn("scope", F.coalesce(F.concat(F.lit("Cycle_"), "cycle_number"), F.lit("all"))).drop("cycle_number")


@registered(
    "top_customers",
    sql.with_(sql.STATE)
    + """SELECT cycle_number, customer_id, segment_name, round(current_revenue, 2) AS revenue, row_number() OVER (PARTITION BY cycle_number ORDER BY round(current_revenue, 2) DESC, customer_id)::INTEGER AS place
    FROM state QUALIFY place <= 12""",
)
def top_customers(spark, sf_dir):
    rows = st.segments(spark, sf_dir).select("cycle_number", "customer_id", "segment_name", r("current_revenue", 2, "revenue"))
    order = Window.partitionBy("cycle_number").orderBy(F.desc("revenue"), "customer_id")
    return rows.withColumn("place", F.row_number().over(order)).where("place <= 12")


@registered(
    "customer_page",
    sql.with_(sql.STATE, sql.ASOF)
    + """, f AS (SELECT cycle_number, s.customer_id, h.country, segment_name, risk_status FROM state s JOIN home h USING (cycle_number, customer_id)
        WHERE (s.customer_id::VARCHAR ILIKE '%1%' OR h.country ILIKE '%an%') AND risk_status = 'At risk')
    SELECT *, (SELECT count(*) FROM f) AS total FROM f ORDER BY cycle_number, customer_id LIMIT 50 OFFSET 50""",
)
def customer_page(spark, sf_dir):
    """Second page of at-risk customers whose id or country matches, with the total."""
    rows = st.state(spark, sf_dir).join(st.asof(spark, sf_dir), ["cycle_number", "customer_id"])
    return reports.page(
        rows.select("cycle_number", "customer_id", "country", "segment_name", "risk_status"),
        reports.matches({"customer_id": "1", "country": "an"}, any_of=True) & (F.col("risk_status") == "At risk"),
        ["cycle_number", "customer_id"], page=2, size=50,
    )


@registered(
    "filter_options",
    sql.with_(sql.STATE)
    + """SELECT 'segment' AS kind, segment_name AS value, count(*) AS rows FROM state GROUP BY ALL UNION ALL
    SELECT 'cluster', stable_cluster_id, count(*) FROM state GROUP BY ALL UNION ALL
    SELECT 'cycle', 'Cycle_' || cycle_number, count(*) FROM state GROUP BY ALL""",
)
def filter_options(spark, sf_dir):
    """Values to filter by and their rows, counted in one pass."""
    rows = st.segments(spark, sf_dir).select(
        F.explode(
            F.array(
                F.struct(F.lit("segment").alias("kind"), F.col("segment_name").alias("value")),
                F.struct(F.lit("cluster").alias("kind"), F.col("stable_cluster_id").alias("value")),
                F.struct(F.lit("cycle").alias("kind"), F.concat(F.lit("Cycle_"), "cycle_number").alias("value")),
            )
        ).alias("o")
    )
    return rows.groupBy("o.kind", "o.value").agg(F.count("*").alias("rows"))


@registered(
    "last_fitted_cycles",
    sql.with_(sql.STATE)
    + """SELECT cycle_number, customer_id, last_value(CASE WHEN current_orders > 0 THEN cycle_number END IGNORE NULLS) OVER (PARTITION BY customer_id ORDER BY cycle_number
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::INTEGER AS last_fitted_cycle FROM state""",
)
def last_fitted_cycles(spark, sf_dir):
    """The last cycle in which a customer bought, as of each row."""
    rows = behaviour.last_fitted_cycle(st.rfm(spark, sf_dir), F.col("current_orders") > 0)
    return rows.select("cycle_number", "customer_id", "last_fitted_cycle")


@registered(
    "segment_identity_history",
    sql.with_(sql.STATE)
    + """, m AS (SELECT cycle_number, stable_cluster_id, avg(recency) AS r, avg(frequency) AS f, avg(monetary) AS m FROM state GROUP BY ALL)
    SELECT a.cycle_number, a.stable_cluster_id, round(a.r - b.r, 6) + 0.0 AS recency_change, round(a.f - b.f, 6) + 0.0 AS frequency_change, round(a.m - b.m, 6) + 0.0 AS monetary_change
    FROM m a JOIN m b ON a.stable_cluster_id = b.stable_cluster_id AND a.cycle_number = b.cycle_number + 1""",
)
def segment_identity_history(spark, sf_dir):
    means = st.segments(spark, sf_dir).groupBy("cycle_number", "stable_cluster_id").agg(
        F.avg("recency").alias("r"), F.avg("frequency").alias("f"), F.avg("monetary").alias("m")
    )
    before = means.select((F.col("cycle_number") + 1).alias("cycle_number"), "stable_cluster_id", *[F.col(c).alias(f"old_{c}") for c in "rfm"])
    return means.join(before, ["cycle_number", "stable_cluster_id"]).select(
        "cycle_number", "stable_cluster_id", r(F.col("r") - F.col("old_r"), 6, "recency_change"),
        r(F.col("f") - F.col("old_f"), 6, "frequency_change"), r(F.col("m") - F.col("old_m"), 6, "monetary_change"),
    )


# Quality jobs


@registered(
    "period_reconciliation",
    sql.with_(sql.PANEL)
    + """SELECT cal.cycle_number, round(coalesce(l.sales, 0), 2) AS ledger_sales, round(coalesce(p.sales, 0), 2) AS panel_sales, coalesce(l.orders, 0)::DOUBLE AS ledger_orders, round(coalesce(p.orders, 0), 4) AS panel_orders,
       abs(coalesce(l.sales, 0) - coalesce(p.sales, 0)) < 0.01 AND abs(coalesce(l.orders, 0) - coalesce(p.orders, 0)) < 1e-6 AS agrees
    FROM cal LEFT JOIN (SELECT cycle_number, sum(total_price) AS sales, count(DISTINCT (customer_id, invoice_no)) AS orders FROM ledger JOIN cal ON invoice_date >= period_start AND invoice_date < period_end GROUP BY ALL) l USING (cycle_number)
    LEFT JOIN (SELECT cycle_number, sum(current_revenue) AS sales, sum(current_orders) AS orders FROM panel GROUP BY ALL) p USING (cycle_number)""",
)
def period_reconciliation(spark, sf_dir):
    return quality.period_reconciliation(st.ledger(spark, sf_dir), st.cycles(spark), st.rfm(spark, sf_dir)).select(
        "cycle_number", r("ledger_sales", 2), r("panel_sales", 2), r("ledger_orders", 4), r("panel_orders", 4), "agrees"
    )


@registered(
    "panel_violations",
    sql.with_(sql.STATE)
    + """SELECT rule, violations FROM (
    SELECT 'repeated customer-cycle' AS rule, (SELECT count(*) FROM (SELECT 1 FROM state GROUP BY cycle_number, customer_id HAVING count(*) > 1)) AS violations
    UNION ALL SELECT 'negative recency', (SELECT count(*) FROM state WHERE recency < 0)
    UNION ALL SELECT 'memberships do not sum to one', (SELECT count(*) FROM state WHERE abs(u0 + u1 + u2 + u3 - 1) > 1e-9)
    UNION ALL SELECT 'baseline not crisp', (SELECT count(*) FROM state WHERE cycle_number = 0 AND top_membership <> 1)
    UNION ALL SELECT 'customer lost from one cycle to the next', (SELECT count(*) FROM state a WHERE cycle_number < 9 AND NOT EXISTS (SELECT 1 FROM state b WHERE b.customer_id = a.customer_id AND b.cycle_number = a.cycle_number + 1)))""",
)
def panel_violations(spark, sf_dir):
    return quality.panel_violations(st.segments(spark, sf_dir))


@registered(
    "duplicate_sensitivity",
    sql.with_(sql.RAW)
    + """, g AS (SELECT customer_id, quantity * unit_price AS v, count(*) AS n FROM raw WHERE customer_id IS NOT NULL AND quantity > 0 AND unit_price > 0 AND invoice_no NOT LIKE 'C%'
        AND invoice_date >= TIMESTAMP '1995-01-01' AND invoice_date < TIMESTAMP '1996-01-01'
        GROUP BY invoice_no, stock_code, description, quantity, invoice_date, unit_price, customer_id, country),
    j AS (SELECT customer_id, round(sum(v), 2) AS x, round(sum(v * n), 2) AS y FROM g GROUP BY customer_id),
    k AS (SELECT *, (rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0)::DOUBLE / count(*) OVER () AS rx, (rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0)::DOUBLE / count(*) OVER () AS ry FROM j)
    SELECT count(*) AS customers, round(corr(rx, ry), 6) AS spearman, count(*) FILTER (least(floor(rx * 4), 3) <> least(floor(ry * 4), 3)) AS quartile_changes, round(sum(y - x), 2) AS value_change FROM k""",
)
def duplicate_sensitivity(spark, sf_dir):
    """What keeping exact repeats would change in customers' value ranks."""
    raw = st.raw_ledger(spark, sf_dir)
    return quality.duplicate_sensitivity(raw, st.CONFIG.baseline_start, st.CONFIG.end).select(
        "customers", r("spearman", 6), "quartile_changes", r("value_change", 2)
    )


# Further reports


@registered("country_groups")
def country_groups(spark, sf_dir):
    """Countries of every cycle in the groups fitted on the baseline's countries."""
    found = st.country_features(spark, sf_dir)
    scaling, centres, _ = markets.fit_groups(found)
    return markets.grouped(found, scaling, centres).select("cycle_number", "country", "cluster_index", "market", r("revenue", 2))


@registered(
    "centre_registry",
    sql.with_(sql.ASSIGNED)
    + f""", mass AS (SELECT cycle_number, k::INTEGER AS k, sum(CASE k WHEN 0 THEN u0 WHEN 1 THEN u1 WHEN 2 THEN u2 ELSE u3 END) AS m, count(*) FILTER (idx = k) AS w FROM assigned, range(4) AS t(k) GROUP BY ALL)
    SELECT cycle_number, k AS cluster_index, {sql.pick(st.IDS, 'k')} AS stable_cluster_id, {sql.pick(st.NAMES, 'k')} AS segment_name, round(m, 4) AS membership_mass, w AS winners, (m > 1e-8 AND w = 0) AS soft_only FROM mass""",
)
def centre_registry(spark, sf_dir):
    rows = st.segments(spark, sf_dir)
    fitted = st.fitted(spark)
    return registry.registry(rows, fitted).select(
        "cycle_number", "cluster_index", "stable_cluster_id", "segment_name", r("membership_mass"), "winners", "soft_only"
    )


@registered(
    "public_names",
    sql.with_(sql.STATE)
    + """, old AS (SELECT cycle_number, CASE idx WHEN 0 THEN 'Champions · ' || lifecycle_status WHEN 1 THEN 'Loyalist at Risk' WHEN 2 THEN 'Mid-Tier Occasional · 3' ELSE segment_name END AS name FROM state)
    SELECT cycle_number, name AS old_name, CASE WHEN name LIKE 'Champions · %' THEN 'High-Value Regulars' WHEN name = 'Loyalist at Risk' THEN 'Valuable Customers at Risk'
        WHEN name = 'Mid-Tier Occasional · 3' THEN 'Mid-Tier Occasionals · 3' ELSE name END AS new_name,
        CASE WHEN name LIKE 'Champions · %' THEN 'Champions' WHEN name = 'Loyalist at Risk' THEN 'Loyalists' WHEN name = 'Mid-Tier Occasional · 3' THEN 'Mid-Tier Occasionals' ELSE name END AS family, count(*) AS customers
    FROM old GROUP BY ALL""",
)
def public_names(spark, sf_dir):
    """Legacy names of stored rows under their public names and families."""
    i = F.col("cluster_index")
    name = (
        F.when(i == 0, F.concat(F.lit("Champions · "), "lifecycle_status"))
        .when(i == 1, "Loyalist at Risk")
        .when(i == 2, "Mid-Tier Occasional · 3")
        .otherwise(F.col("segment_name"))
    )
    rows = st.segments(spark, sf_dir).select("cycle_number", name.alias("old_name"))
    counted = rows.groupBy("cycle_number", "old_name").agg(F.count("*").alias("customers"))
    new = registry.relabelled(counted.withColumn("new_name", F.col("old_name")), ["new_name"])
    return new.withColumn("family", profiles.family(F.col("old_name")))


@registered(
    "crisp_overlap",
    sql.with_(sql.STATE)
    + """, p AS (SELECT cycle_number, prev_idx, idx, count(*) AS n FROM state WHERE prev_idx IS NOT NULL GROUP BY ALL)
    SELECT cycle_number, prev_idx::INTEGER AS prev_cluster_index, idx::INTEGER AS cluster_index, n AS shared, round(n / (sum(n) OVER (PARTITION BY cycle_number, prev_idx) + sum(n) OVER (PARTITION BY cycle_number, idx) - n)::DOUBLE, 6) AS jaccard FROM p""",
)
def crisp_overlap(spark, sf_dir):
    paired = behaviour.with_previous(st.segments(spark, sf_dir)).where("prev_cluster_index is not null")
    return lineage.crisp_overlap(paired).select("cycle_number", "prev_cluster_index", "cluster_index", "shared", r("jaccard", 6))


@registered(
    "cycle_comparison",
    sql.with_(sql.STATE)
    + """SELECT cycle_number, segment_name, count(*) AS customers, round(avg(recency), 6) AS recency, round(avg(frequency), 6) AS frequency, round(avg(monetary), 6) AS monetary,
       round(avg(log_r), 6) AS centre_r, round(avg(log_f), 6) AS centre_f, round(avg(log_m), 6) AS centre_m,
       round(avg(CASE WHEN cycle_number > 0 THEN top_membership END), 6) AS membership FROM state GROUP BY ALL""",
)
def cycle_comparison(spark, sf_dir):
    """Segment profiles and observed centres per cycle; crisp baseline memberships show as null."""
    return st.segments(spark, sf_dir).groupBy("cycle_number", "segment_name").agg(
        F.count("*").alias("customers"), r(F.avg("recency"), 6, "recency"), r(F.avg("frequency"), 6, "frequency"), r(F.avg("monetary"), 6, "monetary"),
        *[r(F.avg(f"log_{c}"), 6, f"centre_{c}") for c in "rfm"],
        r(F.avg(F.when(F.col("cycle_number") > 0, F.col("top_membership"))), 6, "membership"),
    )


@registered(
    "segment_lifetime",
    sql.with_(sql.STATE)
    + """SELECT segment_name, count(DISTINCT customer_id) AS customers, count(DISTINCT cycle_number) AS cycles, round(sum(current_orders), 4) AS orders, round(sum(current_revenue), 2) AS revenue,
       round(sum(frequency * 1.0) / count(*), 6) AS weighted_frequency FROM state GROUP BY ALL""",
)
def segment_lifetime(spark, sf_dir):
    return st.segments(spark, sf_dir).groupBy("segment_name").agg(
        F.count_distinct("customer_id").alias("customers"), F.count_distinct("cycle_number").alias("cycles"),
        r(F.sum("current_orders"), 4, "orders"), r(F.sum("current_revenue"), 2, "revenue"), r(F.avg("frequency"), 6, "weighted_frequency"),
    )


@registered(
    "segment_countries",
    sql.with_(sql.STATE, sql.ASOF)
    + """, c AS (SELECT cycle_number, segment_name, country, count(*) AS customers FROM state JOIN home USING (cycle_number, customer_id) GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY cycle_number, segment_name ORDER BY customers DESC, country)::INTEGER AS place FROM c QUALIFY place <= 10""",
)
def segment_countries(spark, sf_dir):
    rows = st.segments(spark, sf_dir).join(st.asof(spark, sf_dir), ["cycle_number", "customer_id"])
    counted = rows.groupBy("cycle_number", "segment_name", "country").agg(F.count("*").alias("customers"))
    order = Window.partitionBy("cycle_number", "segment_name").orderBy(F.desc("customers"), "country")
    return counted.withColumn("place", F.row_number().over(order)).where("place <= 10")


@registered(
    "product_quadrant",
    sql.with_(sql.LEDGER)
    + """SELECT description, round(sum(total_price), 2) AS revenue, round(sum(quantity), 4) AS quantity, count(DISTINCT customer_id) AS customers, count(DISTINCT invoice_no) AS orders, round(avg(unit_price), 6) AS average_price
    FROM ledger GROUP BY description ORDER BY round(sum(total_price), 2) DESC, description LIMIT 40""",
)
def product_quadrant(spark, sf_dir):
    """The forty products with most revenue."""
    totals = st.ledger(spark, sf_dir).groupBy("description").agg(
        r(F.sum("total_price"), 2, "revenue"), r(F.sum("quantity"), 4, "quantity"), F.count_distinct("customer_id").alias("customers"),
        F.count_distinct("purchase_invoice_no").alias("orders"), r(F.avg("unit_price"), 6, "average_price"),
    )
    return reports.top(totals, "revenue", "description", 40)


@registered(
    "market_summary",
    sql.with_(sql.BASE)
    + """, win AS (SELECT cycle_number, l.*, CASE WHEN country < 'I' THEN 'Early' ELSE 'Late' END AS market FROM ledger l JOIN cal ON invoice_date >= window_start AND invoice_date < period_end)
    SELECT cycle_number, market, countries, customers, round(s, 2) AS revenue, round(s / sum(s) OVER (PARTITION BY cycle_number), 6) AS share
    FROM (SELECT cycle_number, market, count(DISTINCT country) AS countries, count(DISTINCT customer_id) AS customers, sum(total_price) AS s FROM win GROUP BY cycle_number, market)""",
)
def market_summary(spark, sf_dir):
    """Window revenue by market and its share of the cycle; the markets here are stated by the country's name."""
    rows = in_windows(st.ledger(spark, sf_dir), st.cycles(spark)).withColumn("market", F.when(F.col("country") < "I", "Early").otherwise("Late"))
    totals = rows.groupBy("cycle_number", "market").agg(
        F.count_distinct("country").alias("countries"), F.count_distinct("customer_id").alias("customers"), F.sum("total_price").alias("sales")
    )
    whole = F.sum("sales").over(Window.partitionBy("cycle_number"))
    return totals.select("cycle_number", "market", "countries", "customers", r("sales", 2, "revenue"), r(F.try_divide(F.col("sales"), whole), 6, "share"))


@registered(
    "build_residuals",
    sql.with_(sql.RAW)
    + """, f AS (SELECT customer_id, quantity * unit_price AS v, quantity AS q, count(*) AS n FROM raw WHERE customer_id IS NOT NULL AND quantity > 0 AND unit_price > 0 AND invoice_no NOT LIKE 'C%'
        AND invoice_date >= TIMESTAMP '1995-01-01' AND invoice_date < TIMESTAMP '1996-01-01' GROUP BY invoice_no, stock_code, description, quantity, invoice_date, unit_price, customer_id, country),
    j AS (SELECT customer_id, sum(v) AS a, sum(v * n) AS b, sum(q) AS c, sum(q * n) AS d FROM f GROUP BY customer_id)
    SELECT 'total_price' AS field, round(max(abs(a - b)), 2) AS largest, 0::BIGINT AS unpaired, max(abs(a - b)) <= 0.01 AS holds FROM j
    UNION ALL SELECT 'quantity', round(max(abs(c - d)), 2), 0::BIGINT, max(abs(c - d)) <= 0.01 FROM j""",
)
def build_residuals(spark, sf_dir):
    """Customer totals of two builds, with and without the exact dedup, field by field."""
    raw = st.raw_ledger(spark, sf_dir)

    def totals(deduplicate: bool) -> DataFrame:
        return cleaning.clean(raw, st.CONFIG.baseline_start, st.CONFIG.end, deduplicate).groupBy("customer_id").agg(
            F.sum("total_price").alias("total_price"), F.sum("quantity").alias("quantity")
        )

    found = quality.residuals(totals(True), totals(False), ["customer_id"], {"total_price": 0.01, "quantity": 0.01})
    return found.select("field", r("largest", 2), "unpaired", "holds")


@registered("ledger_signature")
def ledger_signature(spark, sf_dir):
    """Order-free content signature of the cleaned ledger; hashes are Spark's own, so rows only."""
    return quality.signature(st.ledger(spark, sf_dir))


# Summaries, evaluation and replays of the stored run


@registered(
    "cycle_summary",
    sql.with_(sql.STATE)
    + f"""SELECT cycle_number, count(*) AS customers, count(*) FILTER (activity_status = 'Active') AS active, count(*) FILTER (activity_status = 'Inactive') AS inactive,
       count(*) FILTER (transition_status = 'New') AS new, count(*) FILTER (is_new = 0 AND prev_id IS NOT NULL AND activity_status = 'Active' AND prev_activity = 'Inactive') AS reactivated,
       count(*) FILTER (transition_status = 'Existing Stable') AS stable, count(*) FILTER (transition_status = 'Existing Migrated') AS migrated, count(prev_id) AS comparable,
       round(coalesce(100.0 * count(*) FILTER (transition_status = 'Existing Migrated') / nullif(count(prev_id), 0), 0)::DOUBLE, 4) AS migration_rate,
       CASE WHEN cycle_number > 0 THEN {st.DRIFT}::DOUBLE END AS centroid_shift FROM state GROUP BY cycle_number""",
)
def cycle_summary(spark, sf_dir):
    """Counts of states and moves per cycle, the migration rate in per cent and the shift of the centres."""
    n = F.col("cycle_number")
    shift = behaviour.centroid_shift(st.centres_at(n - 1), st.centres_at(n))
    found = behaviour.cycle_summary(st.state(spark, sf_dir)).withColumn("centroid_shift", F.when(n > 0, F.round(shift, 6)))
    return found.withColumn("migration_rate", F.round("migration_rate", 4))


@registered(
    "risk_by_cluster",
    sql.with_(sql.STATE)
    + f"""SELECT cycle_number, i::INTEGER AS cluster_index, {sql.pick(st.IDS, 'i')} AS stable_cluster_id, {sql.pick(st.NAMES, 'i')} AS segment_name, count(customer_id) AS customers,
       count(*) FILTER (risk_status IN ('At risk', 'Slipping')) AS flagged, count(*) FILTER (risk_status = 'Lost') AS lost,
       count(*) FILTER (risk_status = 'No prior comparison') AS unassessed,
       round((count(*) FILTER (risk_status IN ('At risk', 'Slipping')))::DOUBLE / nullif(count(*) FILTER (risk_status IN ('At risk', 'Slipping', 'No risk flag')), 0), 6) AS rate
    FROM cal CROSS JOIN range(4) AS t(i) LEFT JOIN state USING (cycle_number) WHERE state.idx IS NULL OR state.idx = i GROUP BY cycle_number, i
    UNION ALL SELECT cycle_number, i::INTEGER, {sql.pick(st.IDS, 'i')}, {sql.pick(st.NAMES, 'i')}, 0, 0, 0, 0, NULL
    FROM cal CROSS JOIN range(4) AS t(i) WHERE EXISTS (SELECT 1 FROM state s WHERE s.cycle_number = cal.cycle_number) AND NOT EXISTS (SELECT 1 FROM state s WHERE s.cycle_number = cal.cycle_number AND s.idx = i)""",
)
def risk_by_cluster(spark, sf_dir):
    """Risk counts of every fitted centre, those that no customer is assigned to included."""
    fitted = st.fitted(spark)
    flagged = F.col("risk_status").isin(*summaries.AT_RISK)
    assessed = flagged | (F.col("risk_status") == "No risk flag")
    counts = st.state(spark, sf_dir).groupBy("cycle_number", "cluster_index").agg(
        F.count("*").alias("customers"), F.count_if(flagged).alias("flagged"), F.count_if(F.col("risk_status") == "Lost").alias("lost"),
        F.count_if(F.col("risk_status") == "No prior comparison").alias("unassessed"),
        r(F.try_divide(F.count_if(flagged).cast("double"), F.count_if(assessed)), 6, "rate"),
    )
    return fitted.join(counts, ["cycle_number", "cluster_index"], "left").na.fill(0, ["customers", "flagged", "lost", "unassessed"])


@registered(
    "observed_centres",
    sql.with_(sql.STATE)
    + """SELECT cycle_number, idx::INTEGER AS cluster_index, count(*) AS customers, round(avg(log_r), 6) AS observed_r, round(avg(log_f), 6) AS observed_f, round(avg(log_m), 6) AS observed_m,
       round(avg(CASE idx WHEN 0 THEN d0 WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END), 6) AS mean_square_distance FROM assigned GROUP BY cycle_number, idx""",
)
def observed_centres(spark, sf_dir):
    """Means of the customers of each group beside their mean squared distance to the fitted centre."""
    return st.segments(spark, sf_dir).groupBy("cycle_number", "cluster_index").agg(
        F.count("*").alias("customers"), *[r(F.avg(f"log_{c}"), 6, f"observed_{c}") for c in "rfm"],
        r(F.avg(F.get("d2", F.col("cluster_index"))), 6, "mean_square_distance"),
    )


@registered(
    "model_evaluation",
    sql.with_(sql.STATE)
    + """SELECT cycle_number, count(*) AS customers, count(DISTINCT idx) AS occupied, round(avg(top_membership), 6) AS mean_membership,
       round(min(top_membership), 6) AS least_membership, round(sum(least(d0, d1, d2, d3)), 3) AS hard_inertia,
       round(sum(u0 * u0 * d0 + u1 * u1 * d1 + u2 * u2 * d2 + u3 * u3 * d3), 3) AS objective,
       round(coalesce(100.0 * count(*) FILTER (transition_status = 'Existing Migrated') / nullif(count(prev_id), 0), 0)::DOUBLE, 4) AS migration_rate,
       count(*) FILTER (prev_name <> segment_name AND prev_id = stable_cluster_id) AS renamed FROM state GROUP BY cycle_number""",
)
def model_evaluation(spark, sf_dir):
    """Quality beside migration per cycle, one row each."""
    compared = F.count("prev_stable_cluster_id")
    moved = F.count_if(F.col("transition_status") == "Existing Migrated")
    j = F.aggregate(F.zip_with("u", "d2", lambda u, d: u * u * d), F.lit(0.0), lambda s, x: s + x)
    renamed = (F.col("prev_segment_name") != F.col("segment_name")) & (F.col("prev_stable_cluster_id") == F.col("stable_cluster_id"))
    return st.state(spark, sf_dir).groupBy("cycle_number").agg(
        F.count("*").alias("customers"), F.count_distinct("cluster_index").alias("occupied"),
        r(F.avg("top_membership"), 6, "mean_membership"), r(F.min("top_membership"), 6, "least_membership"),
        r(F.sum(F.array_min("d2")), 3, "hard_inertia"), r(F.sum(j), 3, "objective"),
        r(F.coalesce(F.try_divide(moved * 100.0, compared), F.lit(0.0)), 4, "migration_rate"), F.count_if(renamed).alias("renamed"),
    )


@registered(
    "population_scope",
    sql.with_(sql.STATE)
    + """, observed AS (SELECT DISTINCT cycle_number, customer_id FROM ledger JOIN cal ON invoice_date < period_end)
    SELECT cycle_number, count(o.customer_id) AS observed, count(s.customer_id) AS fitted, count(*) FILTER (s.customer_id IS NULL) AS observed_only, count(*) FILTER (o.customer_id IS NULL) AS fitted_only
    FROM observed o FULL JOIN state s USING (cycle_number, customer_id) GROUP BY cycle_number""",
)
def population_scope(spark, sf_dir):
    """Customers seen in the ledger before each cutoff against the customers of the stored run."""
    return quality.population_scope(st.ledger(spark, sf_dir), st.cycles(spark), st.segments(spark, sf_dir))


@registered(
    "membership_replay",
    sql.with_(sql.STATE)
    + """SELECT cycle_number, count(*) AS customers, 0::BIGINT AS membership_mismatches, 0::BIGINT AS assignment_mismatches,
       round(sum(u0 * u0 * d0 + u1 * u1 * d1 + u2 * u2 * d2 + u3 * u3 * d3), 3) AS objective FROM state WHERE cycle_number > 0 GROUP BY cycle_number""",
)
def membership_replay(spark, sf_dir):
    """Memberships, assignments and objective computed again from the stored centres and points."""
    rows = st.state(spark, sf_dir).where("cycle_number > 0")
    return quality.membership_replay(rows, st.centres_at(F.col("cycle_number"))).withColumn("objective", r("objective", 3))


@registered(
    "risk_replay",
    sql.with_(sql.STATE)
    + """SELECT cycle_number, risk_status, count(*) AS customers, 0::BIGINT AS mismatches FROM state GROUP BY cycle_number, risk_status""",
)
def risk_replay(spark, sf_dir):
    """Risk of every stored customer-cycle by the rules once more, against the stored status and reasons."""
    return behaviour.risk_replay(st.state(spark, sf_dir))


@registered(
    "exact_silhouettes",
    sql.with_(sql.ASSIGNED)
    + """, away AS (SELECT a.cycle_number, a.customer_id, a.idx, b.idx AS k, count(*) AS n, sum(sqrt(pow(a.log_r - b.log_r, 2) + pow(a.log_f - b.log_f, 2) + pow(a.log_m - b.log_m, 2))) AS s
        FROM assigned a JOIN assigned b USING (cycle_number) GROUP BY ALL),
    ab AS (SELECT cycle_number, customer_id, any_value(idx) AS idx, max(CASE WHEN k = idx THEN n END) AS n, max(CASE WHEN k = idx AND n > 1 THEN s / (n - 1) END) AS i, min(CASE WHEN k <> idx THEN s / n END) AS o FROM away GROUP BY cycle_number, customer_id),
    sil AS (SELECT cycle_number, idx, CASE WHEN o IS NULL THEN NULL WHEN n = 1 THEN 0 ELSE coalesce((o - i) / nullif(greatest(o, i), 0), 0) END AS v FROM ab)
    SELECT cycle_number, idx::INTEGER AS cluster_index, count(*) AS customers, round(avg(v), 5) AS mean_silhouette, round(avg((v < -1e-9)::INTEGER), 6) AS negative_share FROM sil GROUP BY ALL""",
)
def exact_silhouettes(spark, sf_dir):
    """Mean Euclidean silhouette and share of negative ones per cycle and group, all pairs of a cycle in blocks."""
    scored = validity.weighted_silhouettes(st.kinds(spark, sf_dir), F.array("cluster_index"), ["cycle_number"], weight="n")
    known = F.sum(F.when(F.col("silhouette").isNotNull(), F.col("rows")))
    return scored.groupBy("cycle_number", F.col("label").alias("cluster_index")).agg(
        F.sum("rows").alias("customers"), r(validity.mean_silhouette(), 5, "mean_silhouette"),
        r(F.try_divide(F.sum((F.col("silhouette") < -1e-9).cast("int") * F.col("rows")), known), 6, "negative_share"),
    )
