"""Replay of a fitted run: candidates, centres, conditions and identities computed again from what the run stored.

Written apart from the fit, so that a fault in its code shows: distances, memberships and sums have code of their
own, the candidates of all cycles advance together in one pass over packed points per iteration, and identities come
from a dynamic programme over sets of clusters instead of augmenting paths.  What reaches the driver is bounded
by cycles x candidates x centres, whatever the number of customers.

Each function returns stored and replayed figures with a residual; ``holds`` tells whether it is within tolerance.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmentflow.operators.clustering import iterate, packed

CLOSE = 1e-9
EVENTS = {(False, False): "secondary overlap", (True, False): "split contribution", (False, True): "merge contribution", (True, True): "split/merge contribution"}


@dataclass(frozen=True)
class Rules:
    """The settings of the fit."""

    fuzziness: float = 2.0
    even_margin: float = 0.05
    tolerance: float = 0.01
    max_iterations: int = 300
    least_overlap: float = 0.05
    unmatched: float = 0.5
    digits: int = 8


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _gaps(centres: Column, point: Column) -> Column:
    """Squared distances of a point to an array of centres."""
    return F.transform(centres, lambda c: _sum(F.zip_with(c, point, lambda a, b: F.pow(a - b, F.lit(2.0)))))


def _shares(gaps: Column, fuzziness: float) -> Column:
    """Memberships 1 / sum of (d_k / d_j)^(1 / (m - 1)); rows at a centre belong to it, at several in equal parts."""
    hits = F.size(F.filter(gaps, lambda d: d <= 1e-24))
    spread = F.transform(gaps, lambda d: 1.0 / _sum(F.transform(gaps, lambda e: F.pow(d / e, F.lit(1.0 / (fuzziness - 1))))))
    return F.when(hits > 0, F.transform(gaps, lambda d: F.when(d <= 1e-24, 1.0 / hits).otherwise(0.0))).otherwise(spread)


def _distinct(rows: DataFrame, *columns: str) -> DataFrame:
    """The distinct values of a cycle with ``n``, the rows that have them."""
    return rows.groupBy("cycle_number", *columns).agg(F.count("*").alias("n"))


def _sets(centres: DataFrame, shift: int = 0) -> DataFrame:
    """(cycle_number, centres): the stored centres of each cycle in order; one row per cycle."""
    ordered = F.array_sort(F.collect_list(F.struct("cluster_index", "centre")))
    return centres.groupBy((F.col("cycle_number") + shift).alias("cycle_number")).agg(F.transform(ordered, lambda c: c["centre"]).alias("centres"))


def _with_conditions(points: DataFrame, centres: DataFrame, rules: Rules) -> DataFrame:
    """Points of all cycles but the first with both conditions under the cycle before's centres."""
    rows = points.join(F.broadcast(_sets(centres, 1)), "cycle_number").withColumn("gaps", _gaps(F.col("centres"), F.col("point")))
    rows = rows.withColumn("u", _shares(F.col("gaps"), rules.fuzziness))
    level = 1.0 / F.size("centres")
    close = F.forall("u", lambda m: F.abs(m - level) <= rules.even_margin)
    bounds = F.transform("centres", lambda c: F.sqrt(F.array_max(_gaps(F.col("centres"), c))) / 2)
    distant = (F.size("centres") > 1) & F.forall(F.arrays_zip(F.col("gaps").alias("d"), bounds.alias("b")), lambda x: F.sqrt(x["d"]) > x["b"])
    return rows.select(*points.columns, close.alias("one"), distant.alias("two"))


def _apart(a: np.ndarray) -> float:
    """Least squared distance between two rows."""
    return min((float(((a[i] - a[j]) ** 2).sum()) for i in range(len(a)) for j in range(i)), default=math.nan)


def candidates_again(assignments: DataFrame, centres: DataFrame, candidates: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Every candidate of every cycle fitted again from its stored start and masses, with the residuals."""
    spark = assignments.sparkSession
    stored = candidates.orderBy("cycle_number", "k", "source").collect()  # some K rows a cycle
    points = _with_conditions(_distinct(assignments, "point"), centres, rules)
    flag = F.coalesce(F.col("one") & F.col("two"), F.lit(False))
    blocks = packed(points, "point", {"cycle": F.col("cycle_number"), "out": flag}, "n").persist()
    size = len(stored[0]["start"][0]) if stored else 0
    tried = [c.asDict() for c in stored]

    def sums(state: tuple, *chunk: np.ndarray) -> np.ndarray:
        at, now, *_ = state
        return _candidate_parts(tried[at]["cycle_number"], tried[at]["carried"] is not None, now, rules.fuzziness, *chunk)

    def step(state: tuple, flat: np.ndarray) -> tuple[tuple, bool]:
        at, now, updates, before = state
        k = len(now)
        own = {"n": int(flat[0]), "loss": float(flat[1]), "weight": flat[2 : 2 + k], "won": flat[2 + k : 2 + 2 * k], "moment": flat[2 + 2 * k :].reshape(k, size)}
        settled = updates >= 2 and abs(before - own["loss"]) <= rules.tolerance
        if settled or updates == rules.max_iterations:
            return (now, own["loss"], own["n"], updates, settled), False
        return (at, _next(tried[at], own), updates + 1, own["loss"] if updates else math.inf), True

    try:
        ended = iterate(blocks, size, [(i, np.array(c["start"], dtype=float), 0, math.inf) for i, c in enumerate(tried)], sums, step)
    finally:
        blocks.unpersist()
    out = []
    for i, c in enumerate(stored):
        fitted, loss, n, updates, settled = ended[i]
        gap = _apart(fitted)
        index = loss / (n * gap) if n and gap > 1e-12 else math.nan
        shift = float(np.abs(fitted - np.array(c["fitted"])).max())
        index_gap = abs(index - c["xie_beni"]) if math.isfinite(index) and math.isfinite(c["xie_beni"]) else 0.0 if math.isnan(index) == math.isnan(c["xie_beni"]) else math.inf
        holds = max(shift, abs(loss - c["objective"]), index_gap) <= CLOSE * max(1.0, abs(loss)) and updates == c["iterations"] and settled == c["converged"]
        out.append((c["cycle_number"], c["k"], c["source"], c["iterations"], updates, shift, abs(loss - c["objective"]), index_gap, holds))
    return spark.createDataFrame(
        out, "cycle_number int, k int, source string, iterations int, iterations_again int, centre_residual double, objective_residual double, xie_beni_residual double, holds boolean"
    )


def _candidate_parts(
    own_cycle: int, moving: bool, centres: np.ndarray, fuzziness: float, x: np.ndarray, cycle: np.ndarray, out: np.ndarray, n: np.ndarray
) -> np.ndarray:
    """Of the rows of a candidate's cycle: their number, loss, and weight, won and moment of every centre, flat."""
    rows = np.flatnonzero(cycle == own_cycle)
    p, times = x[:, rows], n[rows]
    counted = np.where(out[rows] > 0, 0.0, times) if moving else times
    d = ((p[None] - centres[:, :, None]) ** 2).sum(axis=1)  # centres x rows
    hit = d <= 1e-24
    with np.errstate(divide="ignore", invalid="ignore"):
        closeness = d ** (-1.0 / (fuzziness - 1.0))
        u = np.where(hit.any(axis=0), hit / np.maximum(hit.sum(axis=0), 1), closeness / closeness.sum(axis=0))
    w = u**fuzziness
    won = (np.arange(len(centres))[:, None] == u.argmax(axis=0)) * u
    return np.concatenate([[times.sum(), (w * d * times).sum()], (w * counted).sum(axis=1), (won * counted).sum(axis=1), ((w * counted)[:, None] * p).sum(axis=2).ravel()])


def _next(candidate, own: dict) -> np.ndarray:
    """The next centres of a candidate from its sums."""
    start = np.array(candidate["start"], dtype=float)
    out = np.zeros_like(start)
    for k in range(len(start)):
        weight, won = own["weight"][k], own["won"][k]
        if candidate["carried"] is None:
            out[k] = own["moment"][k] / max(weight, 1e-12)
            continue
        mass = candidate["carried"][k] + won
        share = won / mass if weight > 1e-12 and mass > 1e-12 else 0.0
        out[k] = start[k] if share == 0.0 else (1 - share) * start[k] + share * own["moment"][k] / weight
    return out


def cycles_again(assignments: DataFrame, centres: DataFrame, quality: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Per fitted cycle: memberships, assignment, objective, Xie-Beni index and condition counts from the stored centres."""
    met = _with_conditions(_distinct(assignments, "point"), centres, rules)
    counted = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    counts = met.groupBy("cycle_number").agg(counted(F.col("one")).alias("one"), counted(F.col("two")).alias("two"), counted(F.col("one") & F.col("two")).alias("out"))
    rows = _distinct(assignments.where("cycle_number > 0"), "point", "u", "cluster_index").join(F.broadcast(_sets(centres)), "cycle_number")
    rows = rows.withColumn("gaps", _gaps(F.col("centres"), F.col("point"))).withColumn("again", _shares(F.col("gaps"), rules.fuzziness))
    off = F.array_max(F.zip_with("u", "again", lambda a, b: F.abs(a - b)))
    pairs = F.flatten(F.transform("centres", lambda a, i: F.transform(F.slice("centres", 1, i), lambda b: _sum(F.zip_with(a, b, lambda p, q: F.pow(p - q, F.lit(2.0)))))))
    loss = _sum(F.zip_with("again", "gaps", lambda u, d: F.pow(u, F.lit(rules.fuzziness)) * d))
    seen = rows.groupBy("cycle_number").agg(
        F.sum("n").alias("customers"),
        counted(~F.coalesce(off <= CLOSE, F.lit(False))).alias("membership_mismatches"),
        counted(F.array_position("again", F.array_max("again")) - 1 != F.col("cluster_index")).alias("assignment_mismatches"),
        F.sum(loss * F.col("n")).alias("loss"), F.min(F.array_min(pairs)).alias("gap"),
    )
    both = quality.where("cycle_number > 0").join(seen, "cycle_number", "left").join(counts, "cycle_number", "left")
    index = F.when(F.col("gap") > 1e-12, F.col("loss") / (F.col("customers") * F.col("gap")))
    shown = both.select(
        "cycle_number", "customers", "membership_mismatches", "assignment_mismatches",
        F.abs(F.col("objective") - F.col("loss")).alias("objective_residual"), F.abs(F.col("xie_beni") - index).alias("xie_beni_residual"),
        *[c for pair in (("condition_one", "one"), ("condition_two", "two"), ("left_out", "out")) for c in (F.col(pair[0]), F.col(pair[1]).alias(f"{pair[0]}_again"))],
        (F.col("n") == F.col("customers")).alias("same_rows"),
    )
    good = (
        (F.col("membership_mismatches") + F.col("assignment_mismatches") == 0) & (F.col("objective_residual") <= CLOSE * 1e3) & (F.col("xie_beni_residual") <= CLOSE)
        & (F.col("condition_one") == F.col("condition_one_again")) & (F.col("condition_two") == F.col("condition_two_again"))
        & (F.col("left_out") == F.col("left_out_again")) & F.col("same_rows")
    )
    return shown.withColumn("holds", F.coalesce(good, F.lit(False))).drop("same_rows")


def overlaps_again(assignments: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(cycle_number, previous_index, current_index, overlap) from the memberships, by |a - b|: low and high halves of a sum."""
    earlier = assignments.select((F.col("cycle_number") + 1).alias("cycle_number"), "customer_id", F.transform("u", lambda v: F.round(v, rules.digits)).alias("w"))
    shared = _distinct(assignments.select("cycle_number", "customer_id", "u").join(earlier, ["cycle_number", "customer_id"]), "u", "w")
    cells = shared.select("cycle_number", "u", "n", F.posexplode("w").alias("previous_index", "a")).select(
        "cycle_number", "n", "previous_index", "a", F.posexplode("u").alias("current_index", "b")
    )
    total, gap = F.sum((F.col("a") + F.col("b")) * F.col("n")), F.sum(F.abs(F.col("a") - F.col("b")) * F.col("n"))
    return cells.groupBy("cycle_number", "previous_index", "current_index").agg(F.coalesce(F.try_divide(total - gap, total + gap), F.lit(0.0)).alias("overlap"))


def least_pairs(cost: np.ndarray, allowed: np.ndarray, unmatched: float) -> tuple[float, list[tuple[int, int]]]:
    """The cheapest set of allowed pairs, others paying on both sides, by the best cost of every set of columns used."""
    k, j = cost.shape
    masks = np.arange(1 << j)
    best = np.where(masks == 0, 0.0, np.inf)
    taken = []
    for a in range(k):
        after, how = best + unmatched, np.full(1 << j, -1, dtype=np.int8)
        for b in np.flatnonzero(allowed[a]).tolist():
            free = masks[(masks >> b) & 1 == 0]
            to, price = free | (1 << b), best[free] + cost[a, b]
            less = price < after[to]
            after[to[less]], how[to[less]] = price[less], b
        best = after
        taken.append(how)
    total = best + unmatched * (j - np.bitwise_count(masks.astype(np.uint32)))
    mask = int(total.argmin())
    pairs, price = [], float(total[mask])
    for a in range(k - 1, -1, -1):
        b = int(taken[a][mask])
        if b >= 0:
            pairs.append((a, b))
            mask ^= 1 << b
    return price, sorted(pairs)


def identities_again(assignments: DataFrame, centres: DataFrame, lineage: DataFrame, overlaps: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Per cycle: overlaps, distances and costs of the links, ids and events computed again."""
    spark = assignments.sparkSession
    sets: dict[int, list] = {}
    for r in centres.orderBy("cycle_number", "cluster_index").collect():  # K rows a cycle
        sets.setdefault(r["cycle_number"], []).append((r["stable_cluster_id"], np.array(r["centre"])))
    again = {(r["cycle_number"], r["previous_index"], r["current_index"]): r["overlap"] for r in overlaps_again(assignments, rules).collect()}  # K x K' a cycle
    kept = {(r["cycle_number"], r["previous_index"], r["current_index"]): r["overlap"] for r in overlaps.collect()}
    links: dict[int, dict] = {}
    for r in lineage.collect():
        links.setdefault(r["cycle_number"], {})[r["previous_id"], r["current_id"]] = r
    cycles_, out = sorted(sets), []
    number = len(sets[cycles_[0]]) + 1 if cycles_ else 1
    for c in cycles_[1:]:
        (old_ids, old), (ids, new) = (zip(*sets[at]) for at in (c - 1, c))
        apart = np.array([[np.linalg.norm(a - b) for b in new] for a in old])
        overlap = np.array([[again.get((c, i, j), 0.0) for j in range(len(new))] for i in range(len(old))])
        middle = np.median(apart[apart > 1e-12]) if (apart > 1e-12).any() else 1.0
        cost, allowed = (apart / max(middle, 1e-12) + 1 - overlap) / 2, overlap >= rules.least_overlap
        price, pairs = least_pairs(cost, allowed, rules.unmatched)
        home, expected = {b: a for a, b in pairs}, []
        for b in range(len(new)):
            expected.append(old_ids[home[b]] if b in home else f"CL-{number:03d}")
            number += b not in home
        events = {}
        for a, b in zip(*(x.tolist() for x in np.nonzero(allowed))):
            primary = home.get(b) == a
            events[old_ids[a], expected[b]] = "continued" if primary else EVENTS[bool(allowed[a].sum() > 1), bool(allowed[:, b].sum() > 1)]
        events |= {(old_ids[a], None): "retired" for a in range(len(old)) if a not in set(home.values())}
        events |= {(None, expected[b]): "created" for b in range(len(new)) if b not in home}
        own = links.get(c, {})
        overlap_gap = max((abs(kept.get((c, i, j), math.inf) - overlap[i, j]) for i in range(len(old)) for j in range(len(new))), default=0.0)
        drift = [0.0]
        for a, b in zip(*(x.tolist() for x in np.nonzero(allowed))):
            row = own.get((old_ids[a], expected[b]))
            drift += [math.inf] if row is None else [abs(row["distance"] - apart[a, b]), abs(row["cost"] - cost[a, b])]
        paid = sum(cost[old_ids.index(p), ids.index(q)] for (p, q), r in own.items() if r["is_primary"] and p in old_ids and q in ids)
        n_links = sum(r["is_primary"] for r in own.values())
        paid += rules.unmatched * (len(old) + len(new) - 2 * n_links)
        wrong_ids = sum(a != b for a, b in zip(ids, expected))
        wrong_events = len({(k, e) for k, e in events.items()} ^ {(k, r["event"]) for k, r in own.items()})
        holds = max(overlap_gap, max(drift), abs(paid - price)) <= CLOSE and not wrong_ids and not wrong_events
        out.append((c, len(old), len(new), float(overlap_gap), float(max(drift)), float(abs(paid - price)), wrong_ids, wrong_events, bool(holds)))
    return spark.createDataFrame(
        out,
        "cycle_number int, previous_clusters int, current_clusters int, overlap_residual double, link_residual double, cost_above_least double, wrong_ids int, wrong_events int, holds boolean",
    )
