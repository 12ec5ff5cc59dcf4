"""Many starts at once: K-means for all numbers of clusters and seeds, fuzzy c-means from random memberships.

All starts advance together, see ``clustering.iterate``; the driver holds starts x K centres.
First centres of K-means are drawn, by distance, from a sample of ``SAMPLE_ROWS`` distinct points chosen by hash;
every iteration and cost is over all rows.  Random memberships are drawn from a hash of id, seed and cluster inside
the first pass, so a start needs no state and repeats exactly.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmentflow.functions.membership import centre_array, first_min, squared_distances
from segmentflow.operators import clustering, validity
from segmentflow.operators.clustering import Fit, FuzzyConfig, Start

SAMPLE_ROWS, MOST_ITERATIONS, SETTLED = 4_096, 100, 1e-9


@dataclass
class Partition:
    """The best K-means partition found for one number of clusters."""

    k: int
    cost: float
    centres: np.ndarray
    sizes: list[int]
    iterations: int


def _draw(sample: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """First centres: each next one with a chance by its squared distance to those before."""
    picked = [int(rng.integers(len(sample)))]
    apart = ((sample - sample[picked[0]]) ** 2).sum(axis=1)
    while len(picked) < k:
        total = apart.sum()
        nxt = int(rng.choice(len(sample), p=apart / total)) if total > 0 else int(rng.integers(len(sample)))
        picked.append(nxt)
        apart = np.minimum(apart, ((sample - sample[nxt]) ** 2).sum(axis=1))
    return sample[picked].astype(float)


def hard_parts(centres: np.ndarray, x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Cost, rows and sums of the points of each centre, flat; a row counts with its nearest, first of ties."""
    d2 = clustering.gaps(x, centres)
    own, k = d2.argmin(axis=0), len(centres)
    moment = np.stack([np.bincount(own, weights=w, minlength=k) for w in x * n], axis=1)
    return np.concatenate([np.array([(d2.min(axis=0) * n).sum()]), np.bincount(own, weights=n, minlength=k), moment.ravel()])


def kmeans(points: DataFrame, ks: list[int], starts: int = 30, seed: int = 42, column: str = "point", weight: str | None = None) -> dict[int, Partition]:
    """For each K the partition of least cost over the starts; partitions with an empty cluster do not count.

    ``weight`` names a column of the rows that each given one stands for.
    """
    chosen = points.select(F.col(column).alias("x")).distinct().orderBy(F.xxhash64("x"), "x").limit(SAMPLE_ROWS)
    sample = np.array([r["x"] for r in chosen.collect()], dtype=float)  # SAMPLE_ROWS at most
    rngs = np.random.default_rng(seed)
    plans = [k for k in ks if k <= len(sample) for _ in range(starts)]
    first = [_draw(sample, k, rngs) for k in plans]

    def step(state: tuple, flat: np.ndarray) -> tuple[tuple, bool]:
        now, iteration, cost, _ = state
        k = len(now)
        loss, rows, moment = float(flat[0]), flat[1 : 1 + k], flat[1 + k :].reshape(now.shape)
        if cost - loss <= SETTLED * max(loss, 1e-300) or iteration == MOST_ITERATIONS:
            return (now, iteration, loss, rows), False
        return (np.divide(moment, rows[:, None], out=now.copy(), where=rows[:, None] > 0), iteration + 1, loss, rows), True

    blocks = clustering.packed(points, column, weight=weight).persist()
    try:
        ended = clustering.iterate(blocks, len(sample[0]) if plans else 0, [(c, 0, math.inf, None) for c in first], lambda state, *chunk: hard_parts(state[0], *chunk), step)
    finally:
        blocks.unpersist()
    best: dict[int, Partition] = {}
    for k, (centres, iteration, loss, rows) in zip(plans, ended):
        if rows.min() > 0 and (k not in best or loss < best[k].cost):
            best[k] = Partition(k, loss, centres, sorted(rows.astype(int).tolist(), reverse=True), iteration)
    return best


def labelled(points: DataFrame, found: dict[int, Partition], column: str = "point") -> Column:
    """An array with a row's label in each partition, by rising K."""
    return F.array(*[first_min(squared_distances(F.col(column), centre_array(found[k].centres))) for k in sorted(found)])


def mean_silhouettes(points: DataFrame, found: dict[int, Partition], column: str = "point", weight: str | None = None) -> dict[int, float]:
    """The mean Euclidean silhouette of each partition, all from one pass over pairs of blocks."""
    each = validity.weighted_silhouettes(points, labelled(points, found, column), None, column, weight=weight)
    rows = each.groupBy("place").agg(validity.mean_silhouette().alias("s")).collect()  # one row per K
    ks = sorted(found)
    return {ks[r["place"]]: r["s"] for r in rows}


def k_table(points: DataFrame, found: dict[int, Partition], id_col: str, between_ends: bool = False, column: str = "point", weight: str | None = None) -> list[dict]:
    """One row per K: inertia, Euclidean silhouette, distance from the chord, sizes, singletons, and the choices.

    ``elbow_k`` is farthest below the chord; ``shallow_bend`` tells that the second is within a twentieth of it.
    """
    ks = sorted(found)
    silhouettes = mean_silhouettes(points, found, column, weight)
    bends = clustering.elbow_distances({k: found[k].cost for k in ks}, between_ends)
    chosen = clustering.elbow({k: found[k].cost for k in ks}, between_ends)
    deep = sorted(bends.values(), reverse=True)
    shallow = len(deep) > 1 and deep[0] - deep[1] < 0.05 * max(deep[0], np.finfo(float).eps)
    fit = max(ks, key=lambda k: (-math.inf if silhouettes.get(k) is None else silhouettes[k], -k))
    return [
        {
            "k": k, "inertia": found[k].cost, "silhouette": silhouettes.get(k), "elbow_distance": bends[k], "sizes": found[k].sizes,
            "smallest": found[k].sizes[-1], "singletons": sum(n == 1 for n in found[k].sizes), "selected": k == chosen, "best_silhouette": k == fit, "shallow_bend": shallow,
        }
        for k in ks
    ]


K_TABLE = (
    "k int, inertia double, silhouette double, elbow_distance double, sizes array<int>, smallest int, singletons int, "
    "selected boolean, best_silhouette boolean, shallow_bend boolean"
)


# Fuzzy c-means from random memberships


def random_memberships(id_: Column, k: int, seed: Column) -> Column:
    """k memberships that sum to one, drawn from a hash of id, seed and cluster."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda c: (F.pmod(F.xxhash64(id_, seed, c), F.lit(1 << 53)) + 1).cast("double"))
    total = F.aggregate(raw, F.lit(0.0), lambda s, v: s + v)
    return F.transform(raw, lambda v: v / total)


def random_starts(points: DataFrame, k: int, seeds: list[int], id_col: str = "customer_id", fuzziness: float = 2.0, column: str = "point") -> list[Start]:
    """The centres that random memberships give, for every seed in one aggregation."""
    if not 2 <= k <= points.count():
        raise ValueError("the number of clusters lies between two and the number of rows")
    size = points.select(F.size(column)).first()[0]
    drawn = points.select(column, F.col(id_col).alias("id"), F.explode(F.array(*map(F.lit, seeds))).alias("seed"))
    cells = drawn.select(column, "seed", F.posexplode(random_memberships(F.col("id"), k, F.col("seed"))).alias("cluster", "u"))
    weight = F.pow("u", F.lit(fuzziness))
    sums = cells.groupBy("seed", "cluster").agg(F.sum(weight).alias("w"), *[F.sum(weight * F.get(column, F.lit(i))).alias(f"x{i}") for i in range(size)])
    found = {(r["seed"], r["cluster"]): r for r in sums.collect()}  # seeds x K rows
    return [
        Start(f"random {seed}", np.array([[found[seed, c][f"x{i}"] / max(found[seed, c]["w"], 1e-12) for i in range(size)] for c in range(k)])) for seed in seeds
    ]


def fit_random(
    points: DataFrame, k: int, seeds: list[int], config: FuzzyConfig = FuzzyConfig(), id_col: str = "customer_id", column: str = "point"
) -> list[Fit]:
    """Plain fuzzy c-means from random memberships; all seeds per pass.  The first update is the drawn one."""
    return clustering.fit_starts(points, random_starts(points, k, seeds, id_col, config.fuzziness, column), config, column=column, made=1)

