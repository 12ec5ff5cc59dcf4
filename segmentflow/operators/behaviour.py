"""Rules across consecutive cycles: transitions, migration causes and attribution, customer risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmentflow.functions.membership import first_min, squared_distances

CARRIED = (
    "stable_cluster_id", "segment_name", "cluster_index", "u", "frequency", "monetary", "recency", "activity_status", "point",
)
SLACK = 1e-12


def with_previous(state: DataFrame, carried: tuple[str, ...] = CARRIED) -> DataFrame:
    """Each row with the same customer's row of the cycle before, as ``prev_*``; null where there is none."""
    before = state.select(
        (F.col("cycle_number") + 1).alias("cycle_number"), "customer_id", *[F.col(c).alias(f"prev_{c}") for c in carried]
    )
    return state.join(before, ["cycle_number", "customer_id"], "left")


def vanished(state: DataFrame) -> DataFrame:
    """Rows of a cycle whose customer is absent from the next one, with that next cycle's number."""
    last = state.agg(F.max("cycle_number").alias("last")).first()["last"]
    due = state.withColumn("cycle_number", F.col("cycle_number") + 1).where(F.col("cycle_number") <= F.lit(last))
    return due.join(state.select("cycle_number", "customer_id"), ["cycle_number", "customer_id"], "left_anti")


def transition(mode: str = "cumulative") -> Column:
    """New, stable or migrated; mode "activity" also tells inactive and reactivated customers."""
    new = (F.col("is_new") == 1) | F.col("prev_stable_cluster_id").isNull()
    moved = F.col("stable_cluster_id") != F.col("prev_stable_cluster_id")
    plain = F.when(moved, "Existing Migrated").otherwise("Existing Stable")
    if mode == "cumulative":
        return F.when(new, "New").otherwise(plain)
    inactive = F.col("activity_status") == "Inactive"
    return (
        F.when(new, "New")
        .when(inactive, "Inactive")
        .when(F.col("prev_activity_status") == "Inactive", "Reactivated")
        .otherwise(plain)
    )


def migration_status(status: Column) -> Column:
    """The short alias of a transition."""
    return F.when(status == "New", "New").when(status == "Existing Migrated", "Migrated").otherwise("Stable")


def displacement() -> Column:
    """Euclidean distance between a customer's consecutive feature points."""
    parts = F.zip_with("point", "prev_point", lambda a, b: (a - b) * (a - b))
    return F.when(F.col("prev_point").isNotNull(), F.sqrt(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)))


def migration_cause(old_centres: Column, old_ids: Column) -> Column:
    """Whether a move is explained by the customer's new features under the old centres, or by the centres."""
    under_old = F.get(old_ids, first_min(squared_distances(F.col("point"), old_centres)))
    moved = F.col("stable_cluster_id") != F.col("prev_stable_cluster_id")
    return (
        F.when(F.col("prev_stable_cluster_id").isNull(), "No prior cycle")
        .when(~moved, "No migration")
        .when(under_old == F.col("prev_stable_cluster_id"), "Cluster boundary change")
        .otherwise("Customer feature change")
    )


def migration_attribution(paired: DataFrame, old_centres: Column, new_centres: Column) -> DataFrame:
    """Moves by cycle under two counterfactuals: new features with old centres, old features with new ones."""
    old_here = first_min(squared_distances(F.col("point"), old_centres))
    new_there = first_min(squared_distances(F.col("prev_point"), new_centres))
    rows = paired.where("prev_stable_cluster_id is not null").select(
        "cycle_number",
        (F.col("cluster_index") != F.col("prev_cluster_index")).alias("moved"),
        (old_here != F.col("prev_cluster_index")).alias("by_features"),
        (new_there != F.col("prev_cluster_index")).alias("by_centres"),
        (F.col("segment_name") != F.col("prev_segment_name")).alias("renamed"),
        (
            F.greatest(
                F.abs(F.col("recency") - F.col("prev_recency")).cast("double"),
                F.abs(F.col("frequency") - F.col("prev_frequency")),
                F.abs(F.col("monetary") - F.col("prev_monetary")),
            )
            <= 1e-10
        ).alias("unchanged"),
    )
    m, f, c = F.col("moved"), F.col("by_features"), F.col("by_centres")
    return rows.groupBy("cycle_number").agg(
        F.count("*").alias("compared"),
        F.count_if(m).alias("migrated"),
        F.count_if(m & f & ~c).alias("behaviour_only"),
        F.count_if(m & ~f & c).alias("boundary_only"),
        F.count_if(m & f & c).alias("either"),
        F.count_if(m & ~f & ~c).alias("interaction"),
        F.count_if(~m & F.col("renamed")).alias("renamed_only"),
        F.count_if(m & F.col("unchanged")).alias("unchanged_migrants"),
    )


def _change(field: str) -> Column:
    old = F.col(f"prev_{field}")
    return F.when(old > 0, F.col(field) / old - 1.0)


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


# The reasons and thresholds of the risk rules.
REASON_MEMBERSHIP = "membership fell by 0.10 or more and frequency or spending by 25% or more"
REASON_BOTH = "frequency and spending both fell by 50% or more"
REASON_GAP = "more than 30 days since the last purchase"


def add_risk(paired: DataFrame) -> DataFrame:
    """risk_status, risk_reasons, membership_change, frequency_change and monetary_change."""
    f, m = F.col("frequency_change"), F.col("monetary_change")
    same = (F.col("cycle_number") >= 2) & (F.col("stable_cluster_id") == F.col("prev_stable_cluster_id"))
    change = F.when(same, F.get("u", F.col("cluster_index")) - F.get("prev_u", F.col("prev_cluster_index")))
    fell = (F.col("membership_change") <= -0.10 + SLACK) & (_yes(f <= -0.25 + SLACK) | _yes(m <= -0.25 + SLACK))
    both = (f <= -0.5 + SLACK) & (m <= -0.5 + SLACK)
    reasons = F.concat_ws(
        "; ",
        F.when(_yes(fell), REASON_MEMBERSHIP),
        F.when(_yes(both), REASON_BOTH),
        F.when(F.col("recency") > 30, REASON_GAP),
    )
    status = (
        F.when(F.col("recency") > 90, "Lost")
        .when(F.col("recency") > 60, "Slipping")
        .when(F.col("risk_reasons") != "", "At risk")
        .when(F.col("prev_stable_cluster_id").isNull(), "No prior comparison")
        .otherwise("No risk flag")
    )
    return (
        paired.withColumns({"frequency_change": _change("frequency"), "monetary_change": _change("monetary"), "membership_change": change})
        .withColumn("risk_reasons", reasons)
        .withColumn("risk_status", status)
    )


def keep_inactive_memberships(paired: DataFrame, surviving: Column) -> Column:
    """Variant: inactive customers keep their earlier memberships on surviving ids, renormalised.

    ``surviving`` holds, per current index, the earlier index with the same id or null.  Without any mass
    left, the fresh memberships stay.
    """
    kept = F.transform(surviving, lambda i: F.coalesce(F.get("prev_u", i.cast("int")), F.lit(0.0)))
    mass = F.aggregate(kept, F.lit(0.0), lambda s, x: s + x)
    old = (F.col("activity_status") == "Inactive") & F.col("prev_u").isNotNull() & (mass > 0)
    return F.when(old, F.transform(kept, lambda x: x / mass)).otherwise(F.col("u"))


def recency_label(name: Column, recency: Column) -> Column:
    """Variant: names overridden by a long purchase gap."""
    return F.when(recency > 90, "Hibernating / Lost").when(recency > 30, F.concat(name, F.lit(" At Risk"))).otherwise(name)


def last_fitted_cycle(state: DataFrame, fitted: Column) -> DataFrame:
    """Per row, the last cycle up to it in which the customer's row was fitted."""
    upto = Window.partitionBy("customer_id").orderBy("cycle_number").rowsBetween(Window.unboundedPreceding, 0)
    return state.withColumn("last_fitted_cycle", F.last(F.when(fitted, F.col("cycle_number")), ignorenulls=True).over(upto))


def cycle_summary(state: DataFrame) -> DataFrame:
    """Per cycle the customers by activity and transition, and the moves in per cent of comparable customers."""
    known = F.col("prev_stable_cluster_id").isNotNull()
    moved = F.count_if(F.col("transition_status") == "Existing Migrated")
    active = F.col("activity_status") == "Active"
    back = (F.col("is_new") == 0) & known & active & (F.col("prev_activity_status") == "Inactive")
    return state.groupBy("cycle_number").agg(
        F.count("*").alias("customers"),
        F.count_if(active).alias("active"),
        F.count_if(~active).alias("inactive"),
        F.count_if(F.col("transition_status") == "New").alias("new"),
        F.count_if(back).alias("reactivated"),
        F.count_if(F.col("transition_status") == "Existing Stable").alias("stable"),
        moved.alias("migrated"),
        F.count_if(known).alias("comparable"),
        F.coalesce(F.try_divide(moved * 100.0, F.count_if(known)), F.lit(0.0)).alias("migration_rate"),
    )


def centroid_shift(old: Column, new: Column) -> Column:
    """Mean distance to the nearest centre of the other set, averaged over both directions."""

    def one_way(a: Column, b: Column) -> Column:
        nearest = F.transform(a, lambda c: F.sqrt(F.array_min(squared_distances(c, b))))
        return F.aggregate(nearest, F.lit(0.0), lambda s, x: s + x) / F.size(a)

    return (one_way(old, new) + one_way(new, old)) / 2


def risk_replay(state: DataFrame) -> DataFrame:
    """Per cycle and stored status: customers, and how many the rules now give another status or other reasons."""
    results = ["risk_status", "risk_reasons", "membership_change", "frequency_change", "monetary_change"]
    stored = state.withColumns({f"stored_{c}": F.col(c) for c in results[:2]}).drop(*results)
    again = add_risk(stored)
    differs = ~(F.col("risk_status").eqNullSafe(F.col("stored_risk_status")) & F.col("risk_reasons").eqNullSafe(F.col("stored_risk_reasons")))
    return again.groupBy("cycle_number", F.col("stored_risk_status").alias("status")).agg(
        F.count("*").alias("customers"), F.count_if(differs).alias("mismatches")
    ).withColumnRenamed("status", "risk_status")
