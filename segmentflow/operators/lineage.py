"""Identity of clusters across cycles: overlaps on Spark, the small assignment on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fuzzy_overlap(paired: DataFrame, digits: int = 8) -> DataFrame:
    """Sum of minima over sum of maxima of each pair of earlier and later membership.

    Earlier memberships are compared as stored, rounded.  Pairs of cells are summed in the map-side
    aggregation, so K times K' rows per cycle and task are shuffled.
    """
    cells = F.flatten(
        F.transform(
            "prev_u",
            lambda p, i: F.transform(
                "u", lambda q, j: F.struct(i.alias("previous_index"), j.alias("current_index"), F.round(p, digits).alias("p"), q.alias("q"))
            ),
        )
    )
    both = paired.select("cycle_number", F.explode(cells).alias("c")).select("cycle_number", "c.*")
    return (
        both.groupBy("cycle_number", "previous_index", "current_index")
        .agg(F.sum(F.least("p", "q")).alias("low"), F.sum(F.greatest("p", "q")).alias("high"))
        .where("high > 0")
        .select("cycle_number", "previous_index", "current_index", (F.col("low") / F.col("high")).alias("fuzzy_jaccard"))
    )


def overlap_parts(previous: np.ndarray, current: np.ndarray, n: np.ndarray, digits: int = 8) -> np.ndarray:
    """Sums of minima and of maxima of each pair of earlier and later membership, flat; a row per centre, earlier ones rounded as stored."""
    p, q = np.round(previous, digits)[:, None], current[None]
    return np.concatenate([(np.minimum(p, q) @ n).ravel(), (np.maximum(p, q) @ n).ravel()])


def crisp_overlap(paired: DataFrame) -> DataFrame:
    """Jaccard of earlier and later hard groups over shared customers."""
    pairs = paired.groupBy("cycle_number", "prev_cluster_index", "cluster_index").agg(F.count("*").alias("shared"))
    earlier = pairs.groupBy("cycle_number", "prev_cluster_index").agg(F.sum("shared").alias("a"))
    later = pairs.groupBy("cycle_number", "cluster_index").agg(F.sum("shared").alias("b"))
    return (
        pairs.join(earlier, ["cycle_number", "prev_cluster_index"])
        .join(later, ["cycle_number", "cluster_index"])
        .withColumn("jaccard", F.col("shared") / (F.col("a") + F.col("b") - F.col("shared")))
    )


def assign_least_cost(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows and columns of least total cost (shortest augmenting paths with potentials)."""
    flipped = cost.shape[0] > cost.shape[1]
    c = cost.T if flipped else cost
    n, m = c.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for row in range(1, n + 1):
        match[0], at = row, 0
        best, seen, back = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=bool), np.zeros(m + 1, dtype=int)
        while match[at]:
            seen[at] = True
            i = match[at]
            open_ = np.flatnonzero(~seen[1:]) + 1
            reduced = c[i - 1, open_ - 1] - u[i] - v[open_]
            better = reduced < best[open_]
            best[open_[better]], back[open_[better]] = reduced[better], at
            nxt = open_[np.argmin(best[open_])]
            step = best[nxt]
            u[match[seen]] += step
            v[seen] -= step
            best[~seen] -= step
            at = nxt
        while at:
            match[at] = match[back[at]]
            at = back[at]
    pairs = [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((b, a) if flipped else (a, b) for a, b in pairs)


def match_identities(
    old_centres: np.ndarray,
    new_centres: np.ndarray,
    overlap: np.ndarray,
    old_ids: list[str],
    next_number: int,
    least_overlap: float = 0.05,
    unmatched: float = 0.5,
) -> tuple[list[str], list[dict], int]:
    """Stable ids of the new centres, lineage rows and the next free number.

    A pair costs half its distance in median distances plus half of one minus its overlap; pairs below
    the least overlap are barred; staying unmatched costs ``unmatched`` a side.
    """
    k, j = len(old_centres), len(new_centres)
    distance = np.sqrt(((old_centres[:, None] - new_centres[None]) ** 2).sum(axis=2))
    positive = distance[distance > 1e-12]
    scaled = distance / (np.median(positive) if len(positive) else 1.0)
    cost = 0.5 * scaled + 0.5 * (1 - overlap)
    allowed = overlap >= least_overlap
    wide = np.full((k + j, k + j), 0.0)
    wide[:k, :j] = np.where(allowed, cost, 1e6)
    wide[:k, j:] = unmatched
    wide[k:, :j] = unmatched
    matched = {b: a for a, b in assign_least_cost(wide) if a < k and b < j and allowed[a, b] and cost[a, b] < 1.0}
    ids, rows = [], []
    for b in range(j):
        if b in matched:
            ids.append(old_ids[matched[b]])
        else:
            ids.append(f"CL-{next_number:03d}")
            next_number += 1
    kept = set(matched.values())
    out_degree, in_degree = allowed.sum(axis=1), allowed.sum(axis=0)
    for a in range(k):
        for b in range(j):
            if not allowed[a, b]:
                continue
            primary = matched.get(b) == a
            split, merged = out_degree[a] > 1, in_degree[b] > 1
            event = (
                "continued" if primary
                else "split/merge contribution" if split and merged
                else "split contribution" if split
                else "merge contribution" if merged
                else "secondary overlap"
            )
            rows.append({"previous_id": old_ids[a], "current_id": ids[b], "distance": float(distance[a, b]), "overlap": float(overlap[a, b]), "cost": float(cost[a, b]), "event": event, "is_primary": int(primary), "previous_index": a, "current_index": b})
        if a not in kept:
            rows.append({"previous_id": old_ids[a], "current_id": None, "distance": None, "overlap": None, "cost": None, "event": "retired", "is_primary": 0, "previous_index": a, "current_index": None})
    rows += [
        {"previous_id": None, "current_id": ids[b], "distance": None, "overlap": None, "cost": None, "event": "created", "is_primary": 0, "previous_index": None, "current_index": b}
        for b in range(j)
        if b not in matched
    ]
    return ids, rows, next_number
