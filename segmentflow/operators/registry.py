"""Registry of fitted centres: labels, masses, winners, reconciliation; relabelling of stored results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmentflow.functions.profiles import public_name

SOFT_MASS = 1e-8


def registry(state: DataFrame, centres: DataFrame) -> DataFrame:
    """One row per fitted centre with its membership mass, winners and whether it is soft only.

    state: cycle_number, cluster_index, u.  centres: cycle_number, cluster_index, stable_cluster_id,
    segment_name.  Masses are summed map-side, so K rows per cycle and task are shuffled.
    """
    mass = (
        state.select("cycle_number", F.posexplode("u").alias("k", "m"))
        .groupBy("cycle_number", "k")
        .agg(F.sum("m").alias("membership_mass"))
        .withColumnRenamed("k", "cluster_index")
    )
    won = state.groupBy("cycle_number", "cluster_index").agg(F.count("*").alias("winners"))
    keys = ["cycle_number", "cluster_index"]
    joined = centres.join(mass, keys, "left").join(won, keys, "left").na.fill(0, ["winners"]).na.fill(0.0, ["membership_mass"])
    return joined.withColumn("soft_only", (F.col("membership_mass") > SOFT_MASS) & (F.col("winners") == 0))


def with_label_plan(registry_rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Labels overridden by a plan of (cycle_number, stable_cluster_id, display_label, label_order)."""
    if plan.groupBy("cycle_number", "stable_cluster_id").count().where("count > 1").limit(1).count():
        raise ValueError("the label plan names a centre twice")
    keys = ["cycle_number", "stable_cluster_id"]
    unknown = plan.join(registry_rows, keys, "left_anti").limit(1).count()
    if unknown:
        raise ValueError("the label plan names a centre that was not fitted")
    chosen = registry_rows.join(plan, keys, "left").withColumn("display_label", F.coalesce("display_label", "segment_name"))
    repeated = chosen.groupBy("cycle_number", "display_label").count().where("count > 1").limit(1).count()
    if repeated:
        raise ValueError("two centres of a cycle share a label")
    return chosen


def retired_assignments(state: DataFrame, current: DataFrame) -> DataFrame:
    """Per cycle: rows whose stable id is among the current ids, and rows whose id has retired."""
    marked = state.join(F.broadcast(current.select("stable_cluster_id").distinct().withColumn("is_current", F.lit(1))), "stable_cluster_id", "left")
    return marked.groupBy("cycle_number").agg(
        F.count("is_current").alias("current_rows"), (F.count("*") - F.count("is_current")).alias("retired_rows")
    )


def names_by_mass(state: DataFrame) -> DataFrame:
    """Name of each (cycle, stable id): the one with most membership mass in the customers' details."""
    parts = state.select("cycle_number", F.explode("details").alias("d")).select("cycle_number", "d.*")
    sums = parts.groupBy("cycle_number", "stable_cluster_id", "segment_name").agg(F.sum("membership").alias("mass"))
    return sums.groupBy("cycle_number", "stable_cluster_id").agg(F.max_by("segment_name", F.struct("mass", "segment_name")).alias("segment_name"))


def relabelled(state: DataFrame, columns: list[str], details: str | None = None) -> DataFrame:
    """Public names in the given columns and inside the membership details."""
    out = state.withColumns({c: F.when(F.col(c).isNotNull(), public_name(F.col(c))) for c in columns})
    if details:
        out = out.withColumn(details, F.transform(details, lambda d: d.withField("segment_name", public_name(d["segment_name"]))))
    return out


# Digests: which customers, whatever their order


def digest(*columns: str) -> list:
    """Rows, and the sum and the xor of their hashes; equal for equal multisets of rows, in any order and partition."""
    h = F.xxhash64(*columns)
    return [F.count("*").alias("members"), F.sum(h.cast("decimal(38,0)")).alias("hash_sum"), F.bit_xor(h).alias("hash_xor")]


DIGEST = ["members", "hash_sum", "hash_xor"]


def population_digests(rows: DataFrame) -> DataFrame:
    """(cycle_number, members, hash_sum, hash_xor) of the customers of each cycle."""
    return rows.groupBy("cycle_number").agg(*digest("customer_id"))


def digested(assignments: DataFrame, centres: DataFrame) -> DataFrame:
    """The registry with the digest of each centre's winners beside that of its cycle's population."""
    own = assignments.groupBy("cycle_number", "cluster_index", "stable_cluster_id").agg(*digest("customer_id"))
    keys = ["cycle_number", "cluster_index", "stable_cluster_id"]
    named = [F.coalesce("members", F.lit(0)).alias("members"), F.coalesce("hash_sum", F.lit(0)).cast("decimal(38,0)").alias("hash_sum"), F.coalesce("hash_xor", F.lit(0)).alias("hash_xor")]
    whole = population_digests(assignments).select("cycle_number", *[F.col(c).alias(f"population_{c}") for c in DIGEST])
    marked = registry(assignments, centres.select(*keys, "segment_name")).join(own, keys, "left")
    return marked.select(*keys, "segment_name", "membership_mass", "winners", "soft_only", *named).join(F.broadcast(whole), "cycle_number")


def registry_violations(stored: DataFrame, assignments: DataFrame, lineage: DataFrame, population: DataFrame) -> DataFrame:
    """Counts per rule of a stored registry against the assignments, the lineage and the population that was to be fitted.

    The registry and the lineage hold a few rows a cycle; customers are only summed.
    """
    keys = ["cycle_number", "cluster_index", "stable_cluster_id"]

    def counted(rule: str, broken: DataFrame) -> DataFrame:
        return broken.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")

    def differing(a: DataFrame, b: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
        """Rows that one side lacks, or whose columns differ."""
        left = a.select(*on, F.struct(*columns).alias("a"))
        return left.join(b.select(*on, F.struct(*columns).alias("b")), on, "full").where(~F.col("a").eqNullSafe(F.col("b")))

    own = assignments.groupBy(*keys).agg(*digest("customer_id"))
    told = stored.where("members > 0")
    sizes = stored.groupBy("cycle_number").agg(F.sum("winners").alias("winners"), F.max("population_members").alias("members"))
    whole = stored.select("cycle_number", *[F.col(f"population_{c}").alias(c) for c in DIGEST]).distinct()
    ids = stored.select("cycle_number", "stable_cluster_id")
    first = stored.agg(F.min("cycle_number")).first()[0]
    arrived = lineage.where("current_id is not null").select("cycle_number", F.col("current_id").alias("stable_cluster_id")).distinct()
    left = lineage.where("previous_id is not null").select((F.col("cycle_number") - 1).alias("cycle_number"), F.col("previous_id").alias("stable_cluster_id")).distinct()
    last = stored.agg(F.max("cycle_number")).first()[0]
    return reduce(
        DataFrame.unionByName,
        [
            counted("a centre's members differ from the assignments", differing(told, own, keys, ["members"])),
            counted("a centre's members are others", differing(told, own, keys, DIGEST)),
            counted("winners and members differ", stored.where("winners <> members")),
            counted("winners do not add up to the population", sizes.where("winners <> members")),
            counted("population differs from the panel", differing(whole, population_digests(population), ["cycle_number"], DIGEST)),
            counted("an id twice in a cycle", ids.groupBy("cycle_number", "stable_cluster_id").count().where("count > 1")),
            counted("a customer twice in a cycle", assignments.groupBy("cycle_number", "customer_id").count().where("count > 1")),
            counted("a centre that the lineage does not reach", ids.where(F.col("cycle_number") > first).join(arrived, ["cycle_number", "stable_cluster_id"], "left_anti")),
            counted("a lineage id without a centre", arrived.join(ids, ["cycle_number", "stable_cluster_id"], "left_anti")),
            counted("a centre that the lineage does not leave", ids.where(F.col("cycle_number") < last).join(left, ["cycle_number", "stable_cluster_id"], "left_anti")),
        ],
    )


def identity_links(state: DataFrame, centres: DataFrame) -> DataFrame:
    """Each id that goes on from a cycle to the next: both names, and the change of its membership-weighted measures.

    A centre's measure is the mean over all customers of the cycle by squared membership; one aggregation of
    customers x K cells, then a few rows a cycle.
    """
    measures = ("recency", "frequency", "monetary")
    cells = state.select("cycle_number", *measures, F.posexplode("u").alias("cluster_index", "m"))
    weight = F.col("m") * F.col("m")
    means = cells.groupBy("cycle_number", "cluster_index").agg(*[F.try_divide(F.sum(weight * F.col(c)), F.sum(weight)).alias(c) for c in measures])
    named = means.join(centres.select("cycle_number", "cluster_index", "stable_cluster_id", "segment_name"), ["cycle_number", "cluster_index"])
    before = named.select(
        (F.col("cycle_number") + 1).alias("cycle_number"), "stable_cluster_id", F.col("segment_name").alias("old_name"), *[F.col(c).alias(f"old_{c}") for c in measures]
    )
    return named.join(before, ["cycle_number", "stable_cluster_id"]).select(
        "cycle_number", "stable_cluster_id", "old_name", F.col("segment_name").alias("new_name"), (F.col("old_name") == F.col("segment_name")).alias("kept_name"),
        *[(F.col(c) - F.col(f"old_{c}")).alias(f"{c}_change") for c in measures],
    )
