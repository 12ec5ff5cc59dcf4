"""Cluster quality from sums per group: silhouettes, Davies-Bouldin, Calinski-Harabasz, cohorts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


COHORTS = (
    ("All customers", "true"),
    ("Purchased this month", "current_orders > 0"),
    ("Purchased within 90 days", "recency <= 90"),
    ("No purchase for over 90 days", "recency > 90"),
)


def _moments(rows: DataFrame, keys: list[str], label: str, size: int, column: str) -> DataFrame:
    x = [F.get(column, F.lit(i)) for i in range(size)]
    return rows.groupBy(*keys, label).agg(
        F.count("*").alias("n"), F.array(*[F.avg(c) for c in x]).alias("mean"), F.avg(sum((c * c for c in x[1:]), x[0] * x[0])).alias("square")
    )


def squared_silhouette(rows: DataFrame, keys: list[str], label: str = "cluster_index", size: int = 3, column: str = "point") -> DataFrame:
    """Rows with ``silhouette`` over squared distances, from the mean and mean square of every group.

    The mean squared distance from x to a group is |x|^2 - 2 x.mean + mean square, so no pair of rows is
    formed.  The groups of one key are K rows.
    """
    groups = _moments(rows, keys, label, size, column).groupBy(*keys).agg(
        F.collect_list(F.struct(F.col(label).alias("k"), "n", "mean", "square")).alias("groups")
    )
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    # One row per key, such as a cycle.
    joined = rows.join(F.broadcast(groups), keys) if keys else rows.crossJoin(F.broadcast(groups))
    joined = joined.withColumn("self_square", dot(F.col(column), F.col(column)))

    def away(g: Column) -> Column:
        return F.greatest(F.lit(0.0), F.col("self_square") - 2 * dot(F.col(column), g["mean"]) + g["square"])

    own = F.get(F.filter("groups", lambda g: g["k"] == F.col(label)), F.lit(0))
    others = F.transform(F.filter("groups", lambda g: g["k"] != F.col(label)), away)
    inside = F.when(own["n"] > 1, away(own) * own["n"] / (own["n"] - 1))
    b = F.array_min(others)
    value = F.when(F.size("groups") < 2, None).when(own["n"] == 1, 0.0).otherwise(F.try_divide(b - inside, F.greatest(inside, b)))
    return joined.withColumn("silhouette", value).drop("groups", "self_square")


STRIPS, STRIP_ROWS = 24, 131_072


def point_silhouettes(
    rows: DataFrame, labels: Column, keys: list[str] | None = None, column: str = "point", block_rows: int = 4096, weight: str | None = None
) -> DataFrame:
    """(keys, x, ks, rows, values): every distinct point with its labels, the rows that have them, and its silhouette per place.

    ``labels`` is an array; each place is one labelling, and a row whose label is null has no part in it, so
    overlapping cohorts are labellings as well.  Distances are Euclidean, between all rows with equal keys; equal rows
    are one point with a weight.  Points are packed in pieces of about ``block_rows``.  A strip of a key's pieces meets
    all pieces of the key one after the other and keeps sums per point and label, so pieces are shuffled once per strip,
    ``STRIPS`` times at most up to STRIPS x ``STRIP_ROWS`` points a key, and nothing else is.  The work is quadratic in
    the distinct points of a key, the memory is not.  ``weight`` names a column of the rows that each given one stands for.
    """
    keys = keys or []
    chosen = rows.select(*[F.col(k) for k in keys], labels.alias("ks"), F.col(column).alias("x"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("w"))
    points = chosen.where(F.exists("ks", lambda k: k.isNotNull())).groupBy(*keys, "ks", "x").agg(F.sum("w").alias("w"))
    n = F.count("*")
    most = F.greatest(F.lit(STRIPS), F.ceil(n / STRIP_ROWS))
    counted = points.groupBy(*keys).agg(F.ceil(n / block_rows).cast("int").alias("pieces"), F.least(F.ceil(n / block_rows), most).cast("int").alias("strips"))
    # One row per key.
    sized = points.join(F.broadcast(counted), keys) if keys else points.crossJoin(F.broadcast(counted))
    packed = sized.groupBy(*keys, "strips", F.pmod(F.xxhash64("x"), F.col("pieces")).cast("int").alias("piece")).agg(
        F.collect_list(F.struct("x", "ks", "w")).alias("points")  # block_rows points
    )
    own = F.struct((F.col("piece") % F.col("strips")).alias("strip"), F.lit(0).alias("side"))
    all_ = F.transform(F.sequence(F.lit(0), F.col("strips") - 1), lambda s: F.struct(s.alias("strip"), F.lit(1).alias("side")))
    dealt = packed.select(*keys, "points", F.explode(F.concat(F.array(own), all_)).alias("to")).select(*keys, "to.strip", "to.side", "points")
    tasks = 8 * rows.sparkSession.sparkContext.defaultParallelism  # strips take long, so free cores find another one
    ordered = dealt.repartition(tasks, *keys, "strip").sortWithinPartitions(*keys, "strip", "side")

    kinds = chosen.schema
    head = [f"`{k}` {kinds[k].dataType.simpleString()}" for k in keys]
    schema = ", ".join([*head, "x array<double>", f"ks {kinds['ks'].dataType.simpleString()}", "rows bigint", "values array<double>"])
    names_out = [*keys, "x", "ks", "rows", "values"]
    types_out = [*[to_arrow_type(kinds[k].dataType) for k in keys], pa.list_(pa.float64()), to_arrow_type(kinds["ks"].dataType), pa.int64(), pa.list_(pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strip = None
        for batch in batches:
            places = list(zip(*[batch.column(i).to_pylist() for i in range(len(keys) + 1)]))
            side = batch.column(len(keys) + 1).to_pylist()
            for i, place in enumerate(places):
                if strip is None or strip.place != place:
                    if strip is not None:
                        yield from strip.told(types_out, names_out)
                    strip = _Strip(place)
                held = batch.column(len(keys) + 2)[i].values
                strip.meet(held) if side[i] else strip.take(held)
        if strip is not None:
            yield from strip.told(types_out, names_out)

    return ordered.mapInArrow(run, schema)


class _Strip:
    """Points of one strip with their sums of distances to every label; pieces come one at a time."""

    def __init__(self, place: tuple):
        self.place, self.held = place, []
        self.x = self.sums = None
        self.columns: dict[tuple, int] = {}  # (place, label) -> column of the sums
        self.sizes = np.zeros(0)

    def take(self, points: pa.StructArray) -> None:
        self.held.append(points)

    def meet(self, points: pa.StructArray) -> None:
        if self.x is None:
            self.x = np.concatenate([_coordinates(p) for p in self.held])
            self.sums = np.zeros((len(self.x), 0))
        y, w = _coordinates(points), points.field("w").to_numpy(zero_copy_only=False).astype(float)
        codes, names = _label_codes(points)
        found = [(p, j) for p in range(codes.shape[1]) for j in np.unique(codes[:, p]) if j >= 0]
        for p, j in found:
            self.columns.setdefault((p, names[j]), len(self.columns))
        more = len(self.columns) - len(self.sizes)
        if more:
            self.sizes = np.concatenate([self.sizes, np.zeros(more)])
            self.sums = np.concatenate([self.sums, np.zeros((len(self.x), more))], axis=1)
        at = [self.columns[p, names[j]] for p, j in found]
        shares = np.stack([(codes[:, p] == j) * w for p, j in found], axis=1)
        self.sizes[at] += shares.sum(axis=0)
        y = np.ascontiguousarray(y.T)
        held, gaps = np.empty((2, min(64, len(self.x)), y.shape[1]))  # filled anew for each part, as fresh memory costs more than the sums
        for s in range(0, len(self.x), 64):
            part = self.x[s : s + 64]
            d, gap = held[: len(part)], gaps[: len(part)]
            d[:] = 0.0
            for j in range(len(y)):
                np.subtract(part[:, j, None], y[j], out=gap)
                np.multiply(gap, gap, out=gap)
                d += gap
            self.sums[s : s + 64, at] += np.sqrt(d, out=d) @ shares

    def told(self, types: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
        start = 0
        for points in self.held:
            codes, labels = _label_codes(points)
            sums = self.sums[start : start + len(points)]
            start += len(points)
            values = np.full(codes.shape, np.nan)
            for p in range(codes.shape[1]):
                cols = [c for (q, _), c in self.columns.items() if q == p]
                for j in np.unique(codes[:, p]):
                    others = [c for c in cols if j >= 0 and c != self.columns[p, labels[j]]]
                    if not others:  # no label, or the only one
                        continue
                    own, at = self.columns[p, labels[j]], codes[:, p] == j
                    if self.sizes[own] == 1:
                        values[at, p] = 0.0
                        continue
                    inside = sums[at, own] / (self.sizes[own] - 1)
                    outside = (sums[at][:, others] / self.sizes[others]).min(axis=1)
                    largest = np.maximum(inside, outside)
                    values[at, p] = np.divide(outside - inside, largest, out=np.zeros(len(inside)), where=largest != 0)
            offsets = pa.array(np.arange(0, values.size + 1, values.shape[1]), pa.int32())
            silhouettes = pa.ListArray.from_arrays(offsets, pa.array(values.ravel(), from_pandas=True))
            head = [pa.array([v] * len(points), t) for v, t in zip(self.place[:-1], types)]
            body = [points.field("x").cast(types[-4]), points.field("ks").cast(types[-3]), points.field("w"), silhouettes]
            yield pa.RecordBatch.from_arrays([*head, *body], names)


def _coordinates(points: pa.StructArray) -> np.ndarray:
    return points.field("x").flatten().to_numpy(zero_copy_only=False).reshape(len(points), -1)


def _label_codes(points: pa.StructArray) -> tuple[np.ndarray, list]:
    """Codes of the labels, a column per place and -1 for null, and the labels they stand for."""
    coded = points.field("ks").flatten().dictionary_encode()
    return coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).reshape(len(points), -1), coded.dictionary.to_pylist()


def weighted_silhouettes(
    rows: DataFrame, labels: Column, keys: list[str] | None = None, column: str = "point", block_rows: int = 4096, weight: str | None = None
) -> DataFrame:
    """(keys, place, label, rows, silhouette): one row per distinct point and place, standing for ``rows`` rows."""
    found = point_silhouettes(rows, labels, keys, column, block_rows, weight)
    each = found.select(*(keys or []), "rows", F.posexplode(F.arrays_zip("ks", F.col("values").alias("v"))).alias("place", "s"))
    return each.select(*(keys or []), "place", F.col("s.ks").alias("label"), "rows", F.col("s.v").alias("silhouette")).where("label is not null")


def mean_silhouette() -> Column:
    """The mean over the rows that weighted silhouettes stand for."""
    return F.try_divide(F.sum(F.col("silhouette") * F.col("rows")), F.sum(F.when(F.col("silhouette").isNotNull(), F.col("rows"))))


def exact_silhouettes(rows: DataFrame, labels: Column, keys: list[str] | None = None, column: str = "point", id_col: str = "customer_id", block_rows: int = 4096) -> DataFrame:
    """(keys, id, place, label, silhouette) of every row; means need ``weighted_silhouettes`` only."""
    keys = keys or []
    found = point_silhouettes(rows, labels, keys, column, block_rows).drop("rows")
    chosen = rows.select(*[F.col(k) for k in keys], F.col(id_col).alias("id"), labels.alias("ks"), F.col(column).alias("x"))
    each = chosen.join(found, [*keys, "ks", "x"]).select(*keys, "id", F.posexplode(F.arrays_zip("ks", F.col("values").alias("v"))).alias("place", "s")).where("s.ks is not null")
    return each.select(*keys, F.col("id").alias(id_col), "place", F.col("s.ks").alias("label"), F.col("s.v").alias("silhouette"))


def exact_silhouette(
    rows: DataFrame, keys: list[str] | None = None, label: str = "cluster_index", column: str = "point", id_col: str = "customer_id", block_rows: int = 4096
) -> DataFrame:
    """(keys, id, label, silhouette) over Euclidean distances of all rows with equal keys, in blocks."""
    found = exact_silhouettes(rows, F.array(label), keys, column, id_col, block_rows)
    return found.select(*[F.col(k) for k in keys or []], id_col, F.col("label").alias(label), "silhouette")


def cohort_silhouettes(rows: DataFrame, keys: list[str], label: str = "cluster_index", column: str = "point", weight: str | None = None) -> DataFrame:
    """(keys, cohort, customers, occupied, mean_membership, mean_silhouette) of the overlapping cohorts, distances taken once.

    A cohort of one label has no silhouette.  ``weight`` names a column of the customers that each row stands for.
    """
    names = [c for c, _ in COHORTS]
    inside = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.col(label)) for _, c in _cohort_conditions()])
    found = weighted_silhouettes(rows, inside, keys, column, weight=weight).groupBy(*keys, "place").agg(mean_silhouette().alias("mean_silhouette"))
    by_name = found.withColumn("cohort", F.get(F.array(*map(F.lit, names)), F.col("place"))).drop("place")
    n = F.col(weight) if weight else F.lit(1).cast("long")
    sizes = rows.withColumn("cohort", F.explode(cohorts())).groupBy(*keys, "cohort").agg(
        F.sum(n).alias("customers"), F.count_distinct(label).alias("occupied"), (F.sum(F.col("top_membership") * n) / F.sum(n)).alias("mean_membership")
    )
    return sizes.join(by_name, [*keys, "cohort"], "left")


def scores_by_key(rows: DataFrame, key: str, label: str = "cluster_index", size: int = 3, column: str = "point") -> DataFrame:
    """(key, n, k, davies_bouldin, calinski_harabasz) per key over group means; null below two or at n groups.

    Two passes of sums: moments of every group, then mean distances to the group means, which are K rows a key.
    """
    groups = _moments(rows, [key], label, size, column)
    held = rows.join(F.broadcast(groups.select(key, label, "mean")), [key, label])
    gap = F.aggregate(F.zip_with(column, "mean", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    spread = held.groupBy(key, label).agg(F.avg(F.sqrt(gap)).alias("s"), F.sum(gap).alias("w"))
    both = groups.join(spread, [key, label]).groupBy(key).agg(F.collect_list(F.struct("n", "mean", "s", "w")).alias("g"))
    total = F.aggregate("g", F.lit(0).cast("long"), lambda t, x: t + x["n"])
    centre = F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.aggregate("g", F.lit(0.0), lambda t, x: t + x["n"] * F.get(x["mean"], i)) / F.col("n")
    )
    square = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda t, v: t + v)
    ratio = F.transform(
        "g", lambda a, i: F.array_max(F.transform("g", lambda b, j: F.when(i != j, F.try_divide(a["s"] + b["s"], F.sqrt(square(a["mean"], b["mean"]))))))
    )
    between = F.aggregate("g", F.lit(0.0), lambda t, x: t + x["n"] * square(x["mean"], F.col("centre")))
    within = F.aggregate("g", F.lit(0.0), lambda t, x: t + x["w"])
    told = both.withColumn("n", total).withColumn("k", F.size("g")).withColumn("centre", centre)
    usable = (F.col("k") >= 2) & (F.col("k") < F.col("n"))
    return told.select(
        key, "n", "k",
        F.when(usable, F.aggregate(ratio, F.lit(0.0), lambda t, v: t + v) / F.col("k")).alias("davies_bouldin"),
        F.when(usable, F.try_divide(between / (F.col("k") - 1), within / (F.col("n") - F.col("k")))).alias("calinski_harabasz"),
    )


def scores(rows: DataFrame, label: str = "cluster_index", size: int = 3, column: str = "point") -> dict[str, float | None]:
    """Davies-Bouldin and Calinski-Harabasz over group means; None below two or at n labels."""
    groups = _moments(rows, [], label, size, column).collect()  # K rows
    n, k = sum(g["n"] for g in groups), len(groups)
    if k < 2 or k >= n:
        return {"davies_bouldin": None, "calinski_harabasz": None}
    means, sizes = np.array([g["mean"] for g in groups]), np.array([g["n"] for g in groups], dtype=float)
    within = sizes * (np.array([g["square"] for g in groups]) - (means**2).sum(axis=1))
    centre = (sizes[:, None] * means).sum(axis=0) / n
    between = float((sizes * ((means - centre) ** 2).sum(axis=1)).sum())
    middle = F.array(*[F.array(*[F.lit(float(v)) for v in m]) for m in means])
    place = F.array_position(F.array(*[F.lit(g[label]) for g in groups]), F.col(label)) - 1
    gap = F.aggregate(F.zip_with(column, F.get(middle, place.cast("int")), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    spread = {r[label]: r["s"] for r in rows.groupBy(label).agg(F.avg(F.sqrt(gap)).alias("s")).collect()}
    s = np.array([spread[g[label]] for g in groups])
    apart = np.sqrt(((means[:, None] - means[None]) ** 2).sum(axis=2))
    with np.errstate(divide="ignore"):
        ratio = np.where(np.eye(k, dtype=bool), -math.inf, (s[:, None] + s[None]) / apart)
    return {"davies_bouldin": float(ratio.max(axis=1).mean()), "calinski_harabasz": between / (k - 1) / (max(within.sum(), 1e-300) / (n - k))}


def _cohort_conditions() -> list[tuple[str, Column]]:
    return [(name, F.expr(condition)) for name, condition in COHORTS]


def cohorts() -> Column:
    """Names of the overlapping cohorts that a panel row belongs to."""
    return F.array_compact(F.array(*[F.when(c, name) for name, c in _cohort_conditions()]))
