"""The cycle loop: K-means baseline, fuzzy updates, identities and names, cycle after cycle.

Only centres, ids and carried masses pass from cycle to cycle on the driver.  The panel is stored by cycle.  Its
customers are counted once by kind, the distinct measures of a cycle, and once by the kinds they have in one cycle and
the next; fits, names and overlaps read these counts, so the loop's passes do not meet customers.  Assignments are
expressions over the stored panel and literal centres, so the plan does not grow with the number of cycles.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmentflow.functions.membership import centre_array, first_max, first_min, memberships, squared_distances
from segmentflow.operators import clustering, features, lineage, naming, sweep
from segmentflow.operators.snapshot import FEATURES
from segmentflow.session import ensure_checkpoint_dir
from segmentflow.sources import runs


@dataclass
class Run:
    """What the loop leaves: assignments as a DataFrame, the rest as small row lists."""

    assignments: DataFrame
    centres: list[dict] = field(default_factory=list)
    lineage: list[dict] = field(default_factory=list)
    candidates: list[dict] = field(default_factory=list)
    quality: list[dict] = field(default_factory=list)
    overlaps: list[dict] = field(default_factory=list)
    k_table: list[dict] = field(default_factory=list)

    def tables(self) -> dict[str, DataFrame]:
        """The run as tables: assignments, and a few rows a cycle for each of the rest."""
        spark = self.assignments.sparkSession
        small = {n: spark.createDataFrame([_plain(r, schema) for r in getattr(self, n)], schema) for n, schema in RUN_TABLES.items()}
        return {"assignments": self.assignments, **small}


#: What names and assignments tell of a customer beside the point.
MEASURES = ("recency", "frequency", "monetary")
RUN_TABLES = {
    "centres": "cycle_number int, cluster_index int, stable_cluster_id string, segment_name string, centre array<double>",
    "lineage": "cycle_number int, previous_id string, current_id string, distance double, overlap double, cost double, event string, is_primary int, "
    "previous_index int, current_index int",
    "candidates": "cycle_number int, k int, source string, objective double, xie_beni double, iterations int, converged boolean, selected boolean, "
    "start array<array<double>>, carried array<double>, fitted array<array<double>>",
    "quality": "cycle_number int, k int, n long, objective double, xie_beni double, iterations int, source string, condition_one long, condition_two long, left_out long",
    "k_table": sweep.K_TABLE,
    "overlaps": "cycle_number int, previous_index int, current_index int, overlap double",
}


def _plain(row: dict, schema: str) -> tuple:
    """A row's values in the schema's order, NumPy scalars as Python's."""
    values = (row.get(column.split()[0]) for column in schema.split(", "))
    return tuple(v.item() if isinstance(v, np.generic) else v for v in values)


def project(panel: DataFrame, components: int = 3) -> DataFrame:
    """The panel with ``point``: scaled features projected with the baseline's parameters."""
    scaled = features.fit_min_max(panel.where("cycle_number = 0")).apply(panel)
    columns = tuple(f"scaled_{c}" for c in FEATURES)
    done = features.fit_pca(scaled.where("cycle_number = 0"), columns, components).apply(scaled)
    return done.withColumn("point", F.array(*[f"pc{i + 1}" for i in range(components)]))


def baseline(kinds: DataFrame, n: int, most: int, seeds: int) -> tuple[np.ndarray, list[dict]]:
    """Centres of the elbow's K, and the table of all K, of the n customers that the kinds stand for."""
    found = sweep.kmeans(kinds, list(range(2, max(3, min(most, n - 1) + 1))), seeds, 42, "point", "n")
    if not found:
        raise ValueError("the baseline cycle is too small to cluster")
    table = sweep.k_table(kinds, found, "customer_id", weight="n")
    return found[next(row["k"] for row in table if row["selected"])].centres, table


def _shares(x: np.ndarray, centres: np.ndarray, crisp: bool, fuzziness: float) -> np.ndarray:
    """Memberships of points, a row per centre; crisp ones belong to the nearest, first of ties."""
    d2 = clustering.gaps(x, centres)
    return np.eye(len(centres))[:, d2.argmin(axis=0)] if crisp else clustering.numpy_memberships(d2, fuzziness)


def _profile_sums(blocks: DataFrame, centres: np.ndarray, crisp: bool, fuzziness: float) -> np.ndarray:
    """The sums of ``naming.profile_parts`` over packed kinds."""
    return clustering.block_sums(blocks, centres.shape[1], lambda x, *values: naming.profile_parts(_shares(x, centres, crisp, fuzziness), *values))


def _moves(points: DataFrame, cycles: list[int]) -> DataFrame:
    """(cycle_number, previous, point, n): customers by their points in the cycle before and in this one; null where they are gone."""
    after = F.create_map(*[F.lit(c) for pair in zip(cycles, cycles[1:]) for c in pair])
    before = points.where(F.col("cycle_number") < cycles[-1]).select(F.element_at(after, F.col("cycle_number")).alias("cycle_number"), "customer_id", F.col("point").alias("previous"))
    met = before.join(points.select("cycle_number", "customer_id", "point"), ["cycle_number", "customer_id"], "left")
    return met.groupBy("cycle_number", "previous", "point").agg(F.count("*").alias("n"))


def _carried(moves: DataFrame, centres: np.ndarray, crisp: bool, fuzziness: float) -> np.ndarray:
    """Membership mass of customers that the new cycle no longer has, by their cluster in the cycle before."""

    def mass(x: np.ndarray, n: np.ndarray) -> np.ndarray:
        u = _shares(x, centres, crisp, fuzziness)
        return np.bincount(u.argmax(axis=0), weights=u.max(axis=0) * n, minlength=len(centres))

    flat = clustering.block_sums(clustering.packed(moves.where("point is null"), "previous", weight="n"), centres.shape[1], mass)
    return np.zeros(len(centres)) if flat is None else flat


def _overlap(moves: DataFrame, before: np.ndarray, crisp: bool, centres: np.ndarray, fuzziness: float) -> np.ndarray:
    """Fuzzy overlap of each earlier and later cluster over the customers of both cycles."""
    size = centres.shape[1]
    pairs = moves.where("point is not null").select(F.concat("previous", "point").alias("pair"), "n")

    def parts(x: np.ndarray, n: np.ndarray) -> np.ndarray:
        return lineage.overlap_parts(_shares(x[:size], before, crisp, fuzziness), _shares(x[size:], centres, False, fuzziness), n)

    flat = clustering.block_sums(clustering.packed(pairs, "pair", weight="n"), 2 * size, parts)
    low, high = np.zeros((2, len(before), len(centres))) if flat is None else flat.reshape(2, len(before), len(centres))
    return np.divide(low, high, out=np.zeros_like(low), where=high > 0)


def _assigned(points: DataFrame, centres: np.ndarray, ids: list[str], names: list[str], crisp: bool, fuzziness: float) -> DataFrame:
    d2 = squared_distances(F.col("point"), centre_array(centres))
    rows = points.withColumn("d2", d2)
    hard = F.transform("d2", lambda d, i: (i == first_min(F.col("d2"))).cast("double"))
    rows = rows.withColumn("u", hard if crisp else memberships(F.col("d2"), fuzziness)).withColumn("cluster_index", first_max(F.col("u")))
    return (
        rows.withColumn("top_membership", F.array_max("u"))
        .withColumn("stable_cluster_id", F.get(F.array(*map(F.lit, ids)), F.col("cluster_index")))
        .withColumn("segment_name", F.get(F.array(*map(F.lit, names)), F.col("cluster_index")))
    )


def run(panel: DataFrame, config: clustering.FuzzyConfig = clustering.FuzzyConfig(), most_clusters: int = 10, seeds: int = 50) -> Run:
    """Cluster every cycle of a panel with ``cycle_number``, ``customer_id``, measures and features."""
    spark = panel.sparkSession
    ensure_checkpoint_dir(spark)
    held = runs.Run(spark, f"{spark.sparkContext.getCheckpointDir()}/fit-{uuid.uuid4().hex}")

    def kept(name: str, df: DataFrame) -> DataFrame:
        """The table stored by cycle, so a cycle reads its own rows only."""
        held.commit({name: df})
        own = F.col("cycle_number").cast(df.schema["cycle_number"].dataType)
        return held.read(name).select(own.alias("cycle_number"), *[c for c in df.columns if c != "cycle_number"])

    points = kept("points", project(panel).select("cycle_number", "customer_id", *MEASURES, "point"))
    kinds = kept("kinds", points.groupBy("cycle_number", *MEASURES, "point").agg(F.count("*").alias("n")))
    cycles = [r[0] for r in kinds.select("cycle_number").distinct().orderBy("cycle_number").collect()]
    moves = kept("moves", _moves(points, cycles)) if len(cycles) > 1 else None
    out, parts = Run(points), []
    centres = ids = None
    crisp, next_number = True, 1
    for cycle in cycles:
        own = kinds.where(F.col("cycle_number") == cycle)
        blocks = clustering.packed(own, "point", {m: F.col(m) for m in MEASURES}, "n").persist()
        if centres is None:
            n = own.agg(F.sum("n")).first()[0]
            centres, out.k_table = baseline(own, n, most_clusters, seeds)
            weight, recency, frequency, monetary = _profile_sums(blocks, centres, crisp, config.fuzziness).reshape(-1, 4).T
            centres = centres[np.lexsort((recency / weight, -frequency / weight, -monetary / weight))]  # by value, see ``canonical_order``
            ids = [f"CL-{i + 1:03d}" for i in range(len(centres))]
            next_number = len(ids) + 1
            cost = float(clustering.block_sums(blocks.select("x", "n"), centres.shape[1], lambda x, n: sweep.hard_parts(centres, x, n))[0])
            out.quality.append({"cycle_number": cycle, "k": len(ids), "n": n, "objective": cost, "source": "k-means"})
        else:
            moved = moves.where(F.col("cycle_number") == cycle)
            before, was_crisp, crisp = centres, crisp, False
            fit, fits, met, n = clustering.packed_update(blocks, centres, _carried(moved, before, was_crisp, config.fuzziness), config)
            out.candidates += [
                {
                    "cycle_number": cycle, "k": len(f.centres), "source": f.source, "objective": f.objective, "xie_beni": f.xie_beni,
                    "iterations": f.iterations, "converged": f.converged, "selected": f is fit, "start": f.start.tolist(),
                    "carried": None if f.carried is None else f.carried.tolist(), "fitted": f.centres.tolist(),
                }
                for f in fits
            ]
            overlap = _overlap(moved, before, was_crisp, fit.centres, config.fuzziness)
            out.overlaps += [
                {"cycle_number": cycle, "previous_index": a, "current_index": b, "overlap": float(v)} for (a, b), v in np.ndenumerate(overlap)
            ]
            ids, events, next_number = lineage.match_identities(centres, fit.centres, overlap, ids, next_number)
            out.lineage += [{"cycle_number": cycle, **e} for e in events]
            centres = fit.centres
            out.quality.append(
                {
                    "cycle_number": cycle, "k": len(ids), "n": n, "objective": fit.objective, "xie_beni": fit.xie_beni, "iterations": fit.iterations,
                    "source": fit.source, **dict(zip(("condition_one", "condition_two", "left_out"), met)),
                }
            )
        names = naming.names_of(naming.centre_profiles(_profile_sums(blocks, centres, crisp, config.fuzziness)))
        blocks.unpersist()
        parts.append(_assigned(points.where(F.col("cycle_number") == cycle), centres, ids, names, crisp, config.fuzziness))
        out.centres += [
            {"cycle_number": cycle, "cluster_index": i, "stable_cluster_id": ids[i], "segment_name": names[i], "centre": centres[i].tolist()}
            for i in range(len(ids))
        ]
    out.assignments = reduce(DataFrame.unionByName, parts) if parts else points
    return out
