"""Reports over a fitted run: each takes the run's stored tables, and has SQL over the same tables for its test.

Random starts have no SQL over the source tables, so these are rows only for a check from outside; ``RUN_SQL``
states each report over the tables ``assignments``, ``panel``, ``state``, ``centres``, ``candidates`` and ``quality``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmentflow.operators import behaviour, markets, registry, summaries, validity
from segmentflow.plans import state as st
from segmentflow.plans.register import r, registered

Tables = dict[str, DataFrame]
REPORTS: dict[str, Callable[[Tables], DataFrame]] = {}
RUN_SQL: dict[str, str] = {}
RISKS = ("Lost", "Slipping", "At risk", "No prior comparison", "No risk flag")


def run_state(assignments: DataFrame, panel: DataFrame) -> DataFrame:
    """Assigned customers with their panel, the cycle before, transition and risk."""
    own = panel.select("cycle_number", "customer_id", *[c for c in panel.columns if c not in assignments.columns])
    paired = behaviour.with_previous(assignments.join(own, ["cycle_number", "customer_id"]))
    return behaviour.add_risk(paired).withColumn("transition_status", behaviour.transition())


def tables(spark, sf_dir: str) -> Tables:
    """The fitted run's tables with the panel and the state, each stored once."""
    run, panel = st.fitted_run(spark, sf_dir), st.rfm(spark, sf_dir)
    return run | {"panel": panel, "state": st.stored(spark, sf_dir, "fit_state", lambda: run_state(run["assignments"], panel))}


def report(name: str, sql: str):
    """Registers a report over a run as a query."""

    def keep(function: Callable[[Tables], DataFrame]):
        REPORTS[name], RUN_SQL[name] = function, sql

        @registered(name)
        def query(spark, sf_dir):
            return function(tables(spark, sf_dir))

        query.__doc__ = function.__doc__
        return function

    return keep


@report(
    "fitted_segments",
    """SELECT cycle_number, stable_cluster_id, segment_name, count(*) AS customers, round(sum(current_orders), 4) AS orders, round(sum(current_revenue), 2) AS revenue,
       round(avg(top_membership), 6) AS average_membership, count(*) FILTER (risk_status IN ('At risk', 'Slipping')) AS at_risk_customers,
       round(coalesce(round(sum(current_revenue), 2) / count(*), 0), 4) AS revenue_per_customer
    FROM state GROUP BY ALL""",
)
def fitted_segments(run: Tables) -> DataFrame:
    """Totals of every segment and cycle."""
    found = summaries.segment_summary(summaries.customer_summary(run["state"]))
    return found.select(
        "cycle_number", "stable_cluster_id", "segment_name", "customers", r("orders", 4), r("revenue", 2), r("average_membership", 6), "at_risk_customers",
        r(F.coalesce(F.try_divide(F.round("revenue", 2), F.col("customers")), F.lit(0.0)), 4, "revenue_per_customer"),
    )


@report(
    "fitted_transitions",
    """SELECT cycle_number, prev_segment_name AS from_segment, segment_name AS to_segment, transition_status, count(*) AS customers, round(avg(top_membership), 6) AS mean_membership
    FROM state WHERE cycle_number > 0 GROUP BY ALL""",
)
def fitted_transitions(run: Tables) -> DataFrame:
    """Customers by segment before and after, with their transition (Q7, Q8)."""
    rows = run["state"].where("cycle_number > 0")
    return rows.groupBy("cycle_number", F.col("prev_segment_name").alias("from_segment"), F.col("segment_name").alias("to_segment"), "transition_status").agg(
        F.count("*").alias("customers"), r(F.avg("top_membership"), 6, "mean_membership")
    )


@report(
    "fitted_risk",
    """SELECT c.cycle_number, c.stable_cluster_id, c.segment_name, k.risk_status, count(s.customer_id) AS customers
    FROM centres c CROSS JOIN (VALUES ('Lost'), ('Slipping'), ('At risk'), ('No prior comparison'), ('No risk flag')) AS k(risk_status)
    LEFT JOIN state s ON s.cycle_number = c.cycle_number AND s.stable_cluster_id = c.stable_cluster_id AND s.risk_status = k.risk_status GROUP BY ALL""",
)
def fitted_risk(run: Tables) -> DataFrame:
    """Customers by risk for every fitted centre, centres without customers too (Q9)."""
    each = run["centres"].select("cycle_number", "stable_cluster_id", "segment_name", F.explode(F.array(*map(F.lit, RISKS))).alias("risk_status"))
    counted = run["state"].groupBy("cycle_number", "stable_cluster_id", "risk_status").agg(F.count("*").alias("n"))
    return each.join(counted, ["cycle_number", "stable_cluster_id", "risk_status"], "left").select(
        "cycle_number", "stable_cluster_id", "segment_name", "risk_status", F.coalesce("n", F.lit(0)).alias("customers")
    )


@report(
    "fitted_centre_positions",
    """WITH o AS (SELECT cycle_number, stable_cluster_id, count(*) AS customers, avg(point[1]) AS a, avg(point[2]) AS b, avg(point[3]) AS c FROM assignments GROUP BY ALL)
    SELECT c.cycle_number, c.cluster_index, c.stable_cluster_id, c.segment_name, coalesce(customers, 0) AS customers, round(centre[1], 6) AS pc1, round(centre[2], 6) AS pc2, round(centre[3], 6) AS pc3,
       round(a, 6) AS observed_pc1, round(b, 6) AS observed_pc2, round(o.c, 6) AS observed_pc3, round(sqrt(pow(centre[1] - a, 2) + pow(centre[2] - b, 2) + pow(centre[3] - o.c, 2)), 6) AS shift
    FROM centres c LEFT JOIN o ON o.cycle_number = c.cycle_number AND o.stable_cluster_id = c.stable_cluster_id""",
)
def fitted_centre_positions(run: Tables) -> DataFrame:
    """Fitted centres beside the observed means of their customers, in projected space."""
    at = lambda c, i: F.get(c, F.lit(i))
    observed = run["assignments"].groupBy("cycle_number", "stable_cluster_id").agg(F.count("*").alias("n"), *[F.avg(at("point", i)).alias(f"o{i}") for i in range(3)])
    both = run["centres"].join(observed, ["cycle_number", "stable_cluster_id"], "left")
    gap = sum((F.pow(at("centre", i) - F.col(f"o{i}"), F.lit(2.0)) for i in range(1, 3)), F.pow(at("centre", 0) - F.col("o0"), F.lit(2.0)))
    return both.select(
        "cycle_number", "cluster_index", "stable_cluster_id", "segment_name", F.coalesce("n", F.lit(0)).alias("customers"),
        *[r(at("centre", i), 6, f"pc{i + 1}") for i in range(3)], *[r(f"o{i}", 6, f"observed_pc{i + 1}") for i in range(3)], r(F.sqrt(gap), 6, "shift"),
    )


@report(
    "fitted_families",
    """SELECT cycle_number, segment_name, count(*) AS customers, round(avg(point[1]), 6) AS pc1, round(avg(point[2]), 6) AS pc2, round(avg(point[3]), 6) AS pc3, round(avg(recency), 4) AS recency,
       round(avg(frequency), 4) AS frequency, round(avg(monetary), 2) AS monetary, round(avg(top_membership) FILTER (cycle_number > 0), 6) AS average_membership
    FROM assignments GROUP BY ALL""",
)
def fitted_families(run: Tables) -> DataFrame:
    """Observed means of every named group and cycle; a group without customers has no row (Q6)."""
    rows = run["assignments"]
    return rows.groupBy("cycle_number", "segment_name").agg(
        F.count("*").alias("customers"), *[r(F.avg(F.get("point", F.lit(i))), 6, f"pc{i + 1}") for i in range(3)],
        r(F.avg("recency"), 4, "recency"), r(F.avg("frequency"), 4, "frequency"), r(F.avg("monetary"), 2, "monetary"),
        r(F.avg(F.when(F.col("cycle_number") > 0, F.col("top_membership"))), 6, "average_membership"),
    )


@report(
    "fitted_baseline_profiles",
    """SELECT stable_cluster_id, segment_name, count(*) AS customers, round(count(*) / (SELECT count(*) FROM assignments WHERE cycle_number = 0), 6) AS share, round(avg(recency), 4) AS recency,
       round(avg(frequency), 4) AS frequency, round(avg(monetary), 2) AS monetary FROM assignments WHERE cycle_number = 0 GROUP BY ALL""",
)
def fitted_baseline_profiles(run: Tables) -> DataFrame:
    """Sizes and means of the baseline's groups (Q4)."""
    rows = run["assignments"].where("cycle_number = 0")
    found = rows.groupBy("stable_cluster_id", "segment_name").agg(
        F.count("*").alias("customers"), r(F.avg("recency"), 4, "recency"), r(F.avg("frequency"), 4, "frequency"), r(F.avg("monetary"), 2, "monetary")
    )
    return found.crossJoin(F.broadcast(rows.agg(F.count("*").alias("n")))).withColumn("share", F.round(F.col("customers") / F.col("n"), 6)).drop("n")  # one row


@report(
    "fitted_evaluation",
    """WITH m AS (SELECT cycle_number, round(avg((transition_status = 'Existing Migrated')::INTEGER) FILTER (transition_status <> 'New'), 6) AS migration_rate,
                  count(DISTINCT stable_cluster_id) AS occupied FROM state GROUP BY ALL),
    c AS (SELECT cycle_number, count(*) AS candidates, count(*) FILTER (converged) AS converged, min(xie_beni) FILTER (NOT selected) AS runner_up FROM candidates GROUP BY ALL)
    SELECT q.cycle_number, q.k, q.n, q.source, q.iterations, round(q.objective, 6) AS objective, round(q.xie_beni, 6) AS xie_beni, occupied, coalesce(candidates, 0) AS candidates,
       coalesce(converged, 0) AS converged, round(runner_up, 6) AS runner_up_xie_beni, CASE WHEN q.cycle_number > 0 THEN migration_rate END AS migration_rate
    FROM quality q LEFT JOIN m USING (cycle_number) LEFT JOIN c USING (cycle_number)""",
)
def fitted_evaluation(run: Tables) -> DataFrame:
    """Every cycle's fit beside its candidates, occupied centres and migration (Q4, Q20)."""
    known = F.col("transition_status") != "New"
    moved = run["state"].groupBy("cycle_number").agg(
        F.round(F.avg(F.when(known, (F.col("transition_status") == "Existing Migrated").cast("int"))), 6).alias("migration_rate"), F.count_distinct("stable_cluster_id").alias("occupied")
    )
    tried = run["candidates"].groupBy("cycle_number").agg(
        F.count("*").alias("candidates"), F.count_if("converged").alias("converged"), F.min(F.when(~F.col("selected"), F.col("xie_beni"))).alias("runner_up")
    )
    both = run["quality"].join(moved, "cycle_number", "left").join(tried, "cycle_number", "left")
    zero = F.lit(0).cast("long")
    return both.select(
        "cycle_number", "k", "n", "source", "iterations", r("objective", 6), r("xie_beni", 6), "occupied", F.coalesce("candidates", zero).alias("candidates"),
        F.coalesce("converged", zero).alias("converged"), r("runner_up", 6, "runner_up_xie_beni"), F.when(F.col("cycle_number") > 0, F.col("migration_rate")).alias("migration_rate"),
    )


@registered("fitted_separation")
def fitted_separation(spark, sf_dir):
    """Silhouette, Davies-Bouldin and Calinski-Harabasz of the fitted groups in projected space, per cycle."""
    rows = tables(spark, sf_dir)["assignments"].select("cycle_number", "customer_id", "cluster_index", "point")
    found = validity.weighted_silhouettes(rows, F.array("cluster_index"), ["cycle_number"])
    mean = found.groupBy("cycle_number").agg(r(validity.mean_silhouette(), 5, "silhouette"))
    scores = validity.scores_by_key(rows, "cycle_number").select("cycle_number", "n", "k", r("davies_bouldin", 5), r("calinski_harabasz", 4))
    return scores.join(mean, "cycle_number", "left")


@registered("country_residuals")
def country_residuals(spark, sf_dir):
    """Sum of squares and occupied groups of every cycle under the baseline's frozen country groups."""
    found = st.country_features(spark, sf_dir)
    scaling, centres, _ = markets.fit_groups(found)
    return markets.group_fit(markets.grouped(found, scaling, centres)).select("cycle_number", "countries", r("wcss", 6), "occupied")


@report(
    "fitted_identity_links",
    """WITH long AS (SELECT cycle_number, generate_subscripts(u, 1) - 1 AS k, unnest(u) AS m, recency, frequency, monetary FROM assignments),
    w AS (SELECT cycle_number, k, sum(m * m * recency) / sum(m * m) AS r, sum(m * m * frequency) / sum(m * m) AS f, sum(m * m * monetary) / sum(m * m) AS m FROM long GROUP BY ALL HAVING sum(m * m) > 0),
    n AS (SELECT w.*, stable_cluster_id AS id, segment_name AS name FROM w JOIN centres c ON c.cycle_number = w.cycle_number AND c.cluster_index = w.k)
    SELECT a.cycle_number, a.id AS stable_cluster_id, b.name AS old_name, a.name AS new_name, a.name = b.name AS kept_name, round(a.r - b.r, 4) + 0.0 AS recency_change,
           round(a.f - b.f, 4) + 0.0 AS frequency_change, round(a.m - b.m, 3) + 0.0 AS monetary_change
    FROM n a JOIN n b ON a.id = b.id AND a.cycle_number = b.cycle_number + 1""",
)
def fitted_identity_links(run: Tables) -> DataFrame:
    """Names and weighted measures of every fitted id that goes on."""
    found = registry.identity_links(run["assignments"], run["centres"])
    return found.select(
        "cycle_number", "stable_cluster_id", "old_name", "new_name", "kept_name", r("recency_change", 4), r("frequency_change", 4), r("monetary_change", 3)
    )
