"""Data-quality and reconciliation jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmentflow.functions.membership import first_min, memberships, squared_distances
from segmentflow.operators.calendar import cycles_from, in_periods, in_windows, with_first_cycle
from segmentflow.operators.cleaning import clean, finite, is_paid_sale, normalise
from segmentflow.operators.snapshot import rank_quartile, rank_share
from segmentflow.sources.ledger import LEDGER_COLUMNS


def panel_violations(state: DataFrame) -> DataFrame:
    """Rows that break each rule of the panel; counts of zero mean the rule holds."""
    total = F.aggregate("u", F.lit(0.0), lambda s, x: s + x)
    rules: dict[str, Column] = {
        "negative recency": F.col("recency") < 0,
        "memberships do not sum to one": F.abs(total - 1) > 1e-9,
        "baseline not crisp": (F.col("cycle_number") == 0) & (F.col("top_membership") != 1),
    }
    names = [f"v{i}" for i in range(len(rules))]
    counted = state.agg(*[F.count_if(c).alias(n) for n, c in zip(names, rules.values())])
    simple = counted.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(n).alias("violations")) for n, k in zip(names, rules)])).alias("r")).select("r.*")
    keys = state.select("cycle_number", "customer_id")
    repeated = keys.groupBy("cycle_number", "customer_id").count().where("count > 1").agg(F.count("*").alias("violations"))
    last = state.agg(F.max("cycle_number").alias("last_cycle"))  # one row
    due = keys.crossJoin(F.broadcast(last)).where("cycle_number < last_cycle").select((F.col("cycle_number") + 1).alias("cycle_number"), "customer_id")
    lost = due.join(keys, ["cycle_number", "customer_id"], "left_anti").agg(F.count("*").alias("violations"))
    return reduce(
        DataFrame.unionByName,
        [
            simple,
            repeated.select(F.lit("repeated customer-cycle").alias("rule"), "violations"),
            lost.select(F.lit("customer lost from one cycle to the next").alias("rule"), "violations"),
        ],
    )


def run_invariants(state: DataFrame, cycles: DataFrame, centres: int) -> DataFrame:
    """Rows, cycles or centres that break each rule of a stored run; counts of zero mean the rule holds."""
    ends = F.broadcast(cycles.select("cycle_number", "period_end"))  # one row per cycle
    rules: dict[str, Column] = {
        "recency differs from the last purchase": F.datediff("period_end", "latest_purchase") != F.col("recency"),
        "last purchase before the first": F.col("latest_purchase") < F.col("first_purchase"),
        "memberships of another number": F.size("u") != centres,
        "membership outside 0 to 1": F.exists("u", lambda u: (u < 0) | (u > 1 + 1e-12)),
        "assigned below the highest membership": F.get("u", F.col("cluster_index")) < F.array_max("u"),
    }
    rows = state.join(ends, "cycle_number").agg(*[F.count_if(c).alias(f"v{i}") for i, c in enumerate(rules.values())])
    simple = rows.select(
        F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(f"v{i}").alias("violations")) for i, k in enumerate(rules)])).alias("r")
    ).select("r.*")

    def counted(rule: str, broken: DataFrame) -> DataFrame:
        return broken.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")

    sizes = state.groupBy("cycle_number").agg(F.count("*").alias("n"))
    before = sizes.select((F.col("cycle_number") + 1).alias("cycle_number"), F.col("n").alias("n_before"))
    masses = state.select("cycle_number", F.posexplode("u").alias("k", "m")).groupBy("cycle_number", "k").agg(F.sum("m").alias("mass"))
    pairs = state.groupBy("cycle_number", "cluster_index", "stable_cluster_id").agg(F.count("*").alias("n"))
    return reduce(
        DataFrame.unionByName,
        [
            simple,
            counted("cycle without customers", cycles.select("cycle_number").join(sizes, "cycle_number", "left_anti")),
            counted("fewer customers than the cycle before", sizes.join(before, "cycle_number").where("n < n_before")),
            counted("centre without mass", masses.where("mass <= 1e-8")),
            counted("several ids for one centre", pairs.groupBy("cycle_number", "cluster_index").count().where("count > 1")),
            counted("several centres for one id", pairs.groupBy("cycle_number", "stable_cluster_id").count().where("count > 1")),
        ],
    )


def fit_violations(assignments: DataFrame, centres: DataFrame, lineage: DataFrame, candidates: DataFrame, least_overlap: float = 0.05, fuzziness: float = 2.0) -> DataFrame:
    """Counts per rule of a fitted run: choice of candidates, lineage, ids, and memberships replayed from the centres.

    Cycle 0 is crisp; the other tables hold a few rows a cycle.
    """

    def counted(rule: str, broken: DataFrame) -> DataFrame:
        return broken.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")

    usable = F.col("converged") & finite(F.col("xie_beni"))
    chosen = candidates.groupBy("cycle_number").agg(
        F.count_if("selected").alias("n"), F.min(F.when(usable, F.col("xie_beni"))).alias("least"), F.min(F.when(F.col("selected"), F.col("xie_beni"))).alias("taken")
    )
    born = lineage.where("event = 'created'").select(F.col("cycle_number").alias("at"), F.col("current_id").alias("stable_cluster_id"))
    ordered = F.sort_array(F.collect_list(F.struct("cluster_index", "centre")))  # the centres of one cycle
    sets = centres.groupBy("cycle_number").agg(F.transform(ordered, lambda c: c["centre"]).alias("centres"))
    distinct = assignments.groupBy("cycle_number", "point", "u", "cluster_index").agg(F.count("*").alias("n"))
    replayed = distinct.join(F.broadcast(sets), "cycle_number", "left").withColumn("again_d2", squared_distances(F.col("point"), F.col("centres")))
    own, least = F.get("again_d2", F.col("cluster_index")), F.array_min("again_d2")
    apart = F.array_max(F.zip_with("u", memberships(F.col("again_d2"), fuzziness), lambda a, b: F.abs(a - b)))
    rules = {
        "memberships of another number": ~F.coalesce(F.size("u") == F.size("centres"), F.lit(False)),
        "assigned to a farther centre": ~F.coalesce(own <= least * (1 + 1e-9) + 1e-12, F.lit(False)),
        "memberships differ from the centres": (F.col("cycle_number") > 0) & ~F.coalesce(apart <= 1e-9, F.lit(False)),
    }
    rows = replayed.agg(*[F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(f"v{i}") for i, c in enumerate(rules.values())])
    return reduce(
        DataFrame.unionByName,
        [
            rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(f"v{i}").alias("violations")) for i, k in enumerate(rules)])).alias("r")).select("r.*"),
            counted("not one candidate selected", chosen.where("n <> 1")),
            counted("selected candidate without the least index", chosen.where("not (taken <=> least)")),
            counted("link below the least overlap", lineage.where(F.col("overlap") < least_overlap)),
            counted("primary link between two ids", lineage.where("is_primary = 1 and not (previous_id <=> current_id)")),
            counted("two centres under one id", centres.groupBy("cycle_number", "stable_cluster_id").count().where("count > 1")),
            counted("created id used before", born.join(centres, "stable_cluster_id").where("cycle_number < at").select("at", "stable_cluster_id").distinct()),
        ],
    )


def require_none(violations: DataFrame) -> None:
    broken = violations.where("violations > 0").limit(20).collect()
    if broken:
        raise ValueError("; ".join(f"{r['rule']}: {r['violations']}" for r in broken))


def residuals(left: DataFrame, right: DataFrame, keys: list[str], tolerance: dict[str, float]) -> DataFrame:
    """Per field the largest absolute difference of two builds, rows on one side only, and whether it holds."""
    both = left.select(*keys, *[F.col(c).alias(f"a_{c}") for c in tolerance], F.lit(1).alias("in_a")).join(
        right.select(*keys, *[F.col(c).alias(f"b_{c}") for c in tolerance], F.lit(1).alias("in_b")), keys, "full"
    )
    alone = F.count_if(F.col("in_a").isNull() | F.col("in_b").isNull())
    wide = both.agg(
        *[
            F.struct(F.lit(c).alias("field"), F.max(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")).cast("double")).alias("largest"), alone.alias("unpaired"), F.lit(t).alias("tolerance")).alias(f"r{i}")
            for i, (c, t) in enumerate(tolerance.items())
        ]
    )
    rows = wide.select(F.explode(F.array(*[f"r{i}" for i in range(len(tolerance))])).alias("r")).select("r.*")
    return rows.withColumn("holds", (F.coalesce("largest", F.lit(0.0)) <= F.col("tolerance")) & (F.col("unpaired") == 0))


def period_reconciliation(ledger: DataFrame, cycles: DataFrame, panel: DataFrame) -> DataFrame:
    """Sales and orders of each period in the ledger and in the panel; an order is one customer's invoice."""
    order = F.struct("customer_id", "purchase_invoice_no")
    a = in_periods(ledger, cycles).groupBy("cycle_number").agg(F.sum("total_price").alias("ledger_sales"), F.count_distinct(order).cast("double").alias("ledger_orders"))
    b = panel.groupBy("cycle_number").agg(F.sum("current_revenue").alias("panel_sales"), F.sum("current_orders").alias("panel_orders"))
    joined = cycles.select("cycle_number").join(a, "cycle_number", "left").join(b, "cycle_number", "left").na.fill(0.0)
    return joined.withColumn(
        "agrees", (F.abs(F.col("ledger_sales") - F.col("panel_sales")) < 0.01) & (F.abs(F.col("ledger_orders") - F.col("panel_orders")) < 1e-6)
    )


def population_scope(ledger: DataFrame, cycles: DataFrame, state: DataFrame) -> DataFrame:
    """Per cycle the customers seen in the ledger before the cutoff, those fitted, and those on one side only."""
    first = with_first_cycle(ledger.groupBy("customer_id").agg(F.min("invoice_date").alias("first")), cycles, "first")
    last = cycles.agg(F.max("cycle_number")).first()[0]
    observed = first.select("customer_id", F.explode(cycles_from(F.col("first_cycle"), last)).alias("cycle_number"), F.lit(1).alias("seen"))
    fitted = state.select("cycle_number", "customer_id", F.lit(1).alias("fit"))
    return observed.join(fitted, ["cycle_number", "customer_id"], "full").groupBy("cycle_number").agg(
        F.count("seen").alias("observed"),
        F.count("fit").alias("fitted"),
        F.count_if(F.col("fit").isNull()).alias("observed_only"),
        F.count_if(F.col("seen").isNull()).alias("fitted_only"),
    )


def membership_replay(state: DataFrame, centres: Column, tolerance: float = 1e-9) -> DataFrame:
    """Per cycle: rows whose stored memberships or assignment differ from those of the centres, and the objective."""
    rows = state.withColumn("again_d2", squared_distances(F.col("point"), centres)).withColumn("again", memberships(F.col("again_d2")))
    apart = F.array_max(F.zip_with("u", "again", lambda a, b: F.abs(a - b)))
    j = F.aggregate(F.zip_with("again", "again_d2", lambda u, d: u * u * d), F.lit(0.0), lambda s, x: s + x)
    return rows.groupBy("cycle_number").agg(
        F.count("*").alias("customers"),
        F.count_if(~(apart <= tolerance)).alias("membership_mismatches"),
        F.count_if(first_min(F.col("again_d2")) != F.col("cluster_index")).alias("assignment_mismatches"),
        F.sum(j).alias("objective"),
    )


def signature(table: DataFrame) -> DataFrame:
    """An order-free content signature: rows, summed and xored row hashes."""
    h = F.xxhash64(*[f"`{c}`" for c in sorted(table.columns)])
    return table.agg(F.count("*").alias("rows"), F.sum(h.cast("decimal(38,0)")).alias("hash_sum"), F.bit_xor(h).alias("hash_xor"))


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Multiset equality: signatures first, row differences only where they agree."""
    columns = sorted(left.columns)
    if columns != sorted(right.columns) or signature(left).first() != signature(right).first():
        return False
    a, b = left.select(*columns), right.select(*columns)
    return a.exceptAll(b).limit(1).count() == 0 and b.exceptAll(a).limit(1).count() == 0


def require_unique(table: DataFrame, keys: list[str]) -> DataFrame:
    if table.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError(f"keys {keys} repeat")
    return table


def duplicate_sensitivity(raw: DataFrame, start: str, end: str) -> DataFrame:
    """Customers' value with and without exact repeats: rank correlation, quartile changes, added value."""
    once = clean(raw, start, end).groupBy("customer_id").agg(F.round(F.sum("total_price"), 2).alias("x"))
    kept = clean(raw, start, end, deduplicate=False).groupBy("customer_id").agg(F.round(F.sum("total_price"), 2).alias("y"))
    both = once.join(kept, "customer_id").withColumn("all", F.lit(1))
    ranked = rank_share(rank_share(both, "x", "all", "rx"), "y", "all", "ry")
    return ranked.agg(
        F.count("*").alias("customers"),
        F.when((F.stddev_pop("rx") > 0) & (F.stddev_pop("ry") > 0), F.try_divide(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry"))).alias("spearman"),
        F.count_if(rank_quartile(F.col("rx")) != rank_quartile(F.col("ry"))).alias("quartile_changes"),
        F.sum(F.col("y") - F.col("x")).alias("value_change"),
    )


def duplicate_values(raw: DataFrame, start: str, end: str) -> DataFrame:
    """(customer_id, invoice_date, added): what exact repeats of paid sales would add, one row per repeated row."""
    groups = raw.groupBy(*LEDGER_COLUMNS).agg((F.count("*") - 1).alias("more")).where("more > 0")
    sales = normalise(groups, "more").where(is_paid_sale(start, end))
    return sales.select("customer_id", "invoice_date", (F.col("more") * F.col("quantity") * F.col("unit_price")).alias("added"))


def duplicate_assignments(raw: DataFrame, panel: DataFrame, cycles: DataFrame, centres: Column, start: str, end: str, months: int = 3) -> DataFrame:
    """The panel with each customer's cluster without and with exact repeats, under the same frozen centres.

    Repeats change monetary values alone, so the second build is the first one plus what the few repeated rows add
    to each window.
    """
    added = in_windows(duplicate_values(raw, start, end), cycles).groupBy("cycle_number", "customer_id").agg((F.sum("added") / months).alias("added"))
    both = panel.join(added, ["cycle_number", "customer_id"], "left").withColumn("monetary_with", F.col("monetary") + F.coalesce("added", F.lit(0.0)))
    point = lambda money: F.array("log_r", "log_f", F.log1p(money))
    nearest = lambda money: first_min(squared_distances(point(money), centres))
    return both.select(
        "cycle_number", "customer_id", "monetary", "monetary_with", nearest("monetary").alias("cluster_without"), nearest("monetary_with").alias("cluster_with")
    )
