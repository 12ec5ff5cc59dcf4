"""Fuzzy membership and nearest-centre expressions over literal or column centres."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TOUCH = 1e-24


def centre_array(centres: Sequence[Sequence[float]]) -> Column:
    """A literal array of centres; K is small, so it is part of the plan."""
    return F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centres])


def squared_distances(point: Column, centres: Column) -> Column:
    """Squared Euclidean distance of an array column to each centre."""
    return F.transform(
        centres,
        lambda c: F.aggregate(F.zip_with(point, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x),
    )


def memberships(d2: Column, fuzziness: float = 2.0) -> Column:
    """Fuzzy c-means memberships from squared distances; a touched centre takes all, several share equally."""
    if fuzziness <= 1:
        raise ValueError("fuzziness must be above one")
    power = 1.0 / (fuzziness - 1.0)
    touched = F.transform(d2, lambda d: F.when(d <= TOUCH, 1.0).otherwise(0.0))
    total = F.aggregate(touched, F.lit(0.0), lambda s, x: s + x)
    least = F.array_min(d2)
    closeness = F.transform(d2, lambda d: F.pow(least / d, F.lit(power)))
    whole = F.aggregate(closeness, F.lit(0.0), lambda s, x: s + x)
    return F.when(total > 0, F.transform(touched, lambda t: t / total)).otherwise(F.transform(closeness, lambda c: c / whole))


def first_max(values: Column) -> Column:
    """0-based index of the largest value, the first of ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def first_min(values: Column) -> Column:
    return (F.array_position(values, F.array_min(values)) - 1).cast("int")


def membership_details(u: Column, ids: Column, names: Column, digits: int = 8) -> Column:
    """array<struct<cluster_index, stable_cluster_id, segment_name, membership>>, rounded as stored."""
    return F.transform(
        u,
        lambda m, i: F.struct(
            i.alias("cluster_index"),
            F.get(ids, i).alias("stable_cluster_id"),
            F.get(names, i).alias("segment_name"),
            F.round(m, digits).alias("membership"),
        ),
    )


DETAILS = "array<struct<cluster_index:int,stable_cluster_id:string,segment_name:string,membership:double>>"


def parse_details(text: Column) -> Column:
    """Details from JSON; bad or missing JSON is an empty list."""
    return F.coalesce(F.from_json(text, DETAILS), F.expr("array()").cast(DETAILS))


def membership_in(details: Column, stable_id: Column) -> Column:
    """Summed membership in one stable id."""
    own = F.filter(details, lambda d: d["stable_cluster_id"] == stable_id)
    return F.aggregate(own, F.lit(0.0), lambda s, d: s + d["membership"])
