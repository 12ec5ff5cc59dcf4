"""Exact order statistics of groups of any size: ranges are refined until the wanted rank lies in a small one.

A round cuts the range of every open rank at approximate quantiles of the rows in it and counts rows between and
at the cuts; the counts, some hundreds per rank, tell the next range.  Only ranges of ``SMALL_RANGE`` rows are
sorted, so no task ever holds a whole group.  Groups that are small from the start take no round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmentflow.session import ensure_checkpoint_dir

CUTS, SMALL_RANGE, MOST_ROUNDS = 200, 100_000, 12


def order_statistics(rows: DataFrame, keys: list[str], value: str | Column, shares: dict[str, float], linear: bool = False) -> DataFrame:
    """(keys, n, a column per share): the value at the share's place among the n values of a group.

    The place is (n - 1) x share: its floor by default; with ``linear``, values on both sides are interpolated.
    Null and NaN values have no part; a group without others has no row.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    held = rows.select(*keys, (F.col(value) if isinstance(value, str) else value).cast("double").alias("x")).where("x is not null and not isnan(x)")
    counted = held.groupBy(*keys).agg(F.count("*").alias("n"))
    places = F.array(*[F.struct(F.lit(name).alias("name"), ((F.col("n") - 1) * F.lit(float(p))).alias("place")) for name, p in shares.items()])
    wanted = counted.select(*keys, "n", F.explode(places).alias("w")).select(
        *keys, "n", "w.*", F.floor("w.place").alias("low"), (F.ceil if linear else F.floor)("w.place").alias("high")
    ).checkpoint()
    ranks = wanted.select(*keys, "n", F.explode(F.array_distinct(F.array("low", "high"))).alias("rank")).distinct()
    none = F.lit(None).cast("double")
    open_ = ranks.select(*keys, "n", "rank", none.alias("above"), none.alias("below"), F.lit(0).cast("long").alias("before"), F.col("n").alias("left")).checkpoint()
    found = None
    for _ in range(MOST_ROUNDS):
        if open_.where(F.col("left") > SMALL_RANGE).isEmpty():
            break
        large, small = open_.where(F.col("left") > SMALL_RANGE), open_.where(F.col("left") <= SMALL_RANGE)
        closer = _refined(held, large, keys).checkpoint()
        told = closer.where("value is not null").select(*keys, "rank", "value")
        found = told if found is None else found.unionByName(told)
        open_ = small.unionByName(closer.where("value is null").drop("value")).checkpoint()
    last = _sorted(held, open_, keys, wanted)
    found = last if found is None else found.unionByName(last)
    low = found.select(*keys, F.col("rank").alias("low"), F.col("value").alias("low_value"))
    high = found.select(*keys, F.col("rank").alias("high"), F.col("value").alias("high_value"))
    both = _joined(_joined(wanted, low, [*keys, "low"]), high, [*keys, "high"])
    at = F.col("low_value") + (F.col("high_value") - F.col("low_value")) * (F.col("place") - F.col("low"))
    exact = F.when(F.col("low") == F.col("high"), F.col("low_value")).otherwise(at)
    return both.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("name") == name, exact)).alias(name) for name in shares])


def _joined(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join in which null keys equal each other."""
    other = b.select(*[F.col(k).alias(f"{k}__b") if k in keys else F.col(k) for k in b.columns])
    same = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"{k}__b"))
        same = one if same is None else same & one
    return a.join(other, same, how).drop(*[f"{k}__b" for k in keys])


def _inside(held: DataFrame, open_: DataFrame, keys: list[str], grouped: DataFrame | None = None) -> DataFrame:
    """The rows of each open rank's range, between its bounds; without ``grouped``, the groups, of large groups only.

    Ranks of groups that began large are few, SMALL_RANGE rows stand behind each group, so they are broadcast and no
    task gets all rows of such a group; the other groups are joined by key.
    """
    between = (F.col("above").isNull() | (F.col("x") > F.col("above"))) & (F.col("below").isNull() | (F.col("x") < F.col("below")))
    if not keys:  # a rank or two per share
        return held.crossJoin(F.broadcast(open_)).where(between)
    large = F.col("n") > SMALL_RANGE
    few = _joined(held, F.broadcast(open_.where(large)), keys).where(between)
    if grouped is None:
        return few
    others = _joined(held, F.broadcast(grouped.where(large).select(*keys).distinct()), keys, "left_anti")
    return few.unionByName(_joined(others, open_.where(~large), keys).where(between))


def _refined(held: DataFrame, open_: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rank, n, above, below, before, left, value): a smaller range for each open rank, or its value at a cut."""
    rank = [*keys, "rank"]
    rows = _inside(held, open_, keys)
    shares = F.array(*[F.lit(i / CUTS) for i in range(1, CUTS)])
    cuts = rows.groupBy(*rank).agg(F.array_sort(F.array_distinct(F.percentile_approx("x", shares, 10 * CUTS))).alias("cuts"))
    placed = _joined(rows, F.broadcast(cuts), rank)  # open ranks of large groups
    part = 2 * F.size(F.filter("cuts", lambda c: c < F.col("x"))) + F.array_contains("cuts", F.col("x")).cast("int")
    counts = placed.withColumn("part", part).groupBy(*rank, "n", "above", "below", "before", "part").agg(F.count("*").alias("rows"), F.first("cuts").alias("cuts"))
    upto = Window.partitionBy(*rank).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # 2 x CUTS rows
    ends = counts.withColumn("before", F.col("before") + F.coalesce(F.sum("rows").over(upto), F.lit(0)))
    hit = ends.where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("rows")))
    cut = (F.col("part") / 2).cast("int")
    return hit.select(
        *rank, "n", F.coalesce(F.get("cuts", cut - 1), F.col("above")).alias("above"), F.coalesce(F.get("cuts", cut), F.col("below")).alias("below"),
        "before", F.col("rows").alias("left"), F.when(F.col("part") % 2 == 1, F.get("cuts", cut)).alias("value"),
    )


def _sorted(held: DataFrame, open_: DataFrame, keys: list[str], grouped: DataFrame) -> DataFrame:
    """(keys, rank, value) of ranks whose range is small."""
    rank = [*keys, "rank"]
    ties = _inside(held, open_, keys, grouped).groupBy(*rank, "before", "x").agg(F.count("*").alias("rows"))
    upto = Window.partitionBy(*rank).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)  # SMALL_RANGE rows
    ends = ties.withColumn("end", F.col("before") + F.sum("rows").over(upto))
    return ends.where((F.col("end") > F.col("rank")) & (F.col("end") - F.col("rows") <= F.col("rank"))).select(*rank, F.col("x").alias("value"))
