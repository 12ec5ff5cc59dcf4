"""K-means baseline and the fuzzy update of one cycle: distributed sums, K-sized algebra on the driver.

Feature points are an array column; iterations run over packed distinct points.  All starts of a fit advance
together, see ``iterate``: in one job over a bounded number of distinct points, else in one job a pass; what returns to
the driver is bounded by tasks x starts x K, whatever the number of customers.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmentflow.functions.membership import TOUCH, centre_array, first_min, memberships, squared_distances


@dataclass(frozen=True)
class FuzzyConfig:
    fuzziness: float = 2.0
    even_margin: float = 0.05
    tolerance: float = 0.01
    max_iterations: int = 300


@dataclass
class Fit:
    """One fitted set of centres."""

    centres: np.ndarray
    objective: float
    xie_beni: float
    iterations: int
    converged: bool
    source: str = ""
    start: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    carried: np.ndarray | None = None


@dataclass(frozen=True)
class Start:
    """Centres to fit from.  With carried masses they are moved from where they stand; without, plain fuzzy c-means."""

    source: str
    centres: np.ndarray
    carried: np.ndarray | None = None


# Choice of K


def elbow_distances(costs: dict[int, float], between_ends: bool = False) -> dict[int, float]:
    """How far each K lies below the chord of the cost curve; ``between_ends`` scales by first and last cost."""
    ks = sorted(costs)
    x = np.array(ks, dtype=float)
    y = np.array([costs[k] for k in ks], dtype=float)
    low, high = (y[-1], y[0]) if between_ends else (y.min(), y.max())
    x = (x - x[0]) / max(x[-1] - x[0], 1.0)
    y = (y - low) / (high - low) if high > low else np.zeros_like(y)
    return dict(zip(ks, ((1 - x) - y).tolist()))


def elbow(costs: dict[int, float], between_ends: bool = False) -> int:
    """The K farthest below the chord, the first of ties; the least K of fewer than three."""
    ks = sorted(costs)
    if len(ks) < 3:
        return ks[0]
    bends = elbow_distances(costs, between_ends)
    return max(ks, key=lambda k: (bends[k], -k))


def canonical_order(labelled: DataFrame, label: str = "cluster_index") -> list[int]:
    """Old labels in order of mean monetary down, frequency down, recency up."""
    means = labelled.groupBy(label).agg(F.avg("monetary").alias("m"), F.avg("frequency").alias("f"), F.avg("recency").alias("r"))
    return [row[label] for row in means.orderBy(F.desc("m"), F.desc("f"), "r", label).collect()]  # K rows


def nearest(points: DataFrame, centres: np.ndarray, column: str = "point") -> DataFrame:
    """The rows with ``cluster_index``, the nearest centre (first of ties), and ``d2``."""
    return points.withColumn("d2", squared_distances(F.col(column), centre_array(centres))).withColumn("cluster_index", first_min(F.col("d2")))


# Validity


def separation(centres: np.ndarray) -> float:
    """Least squared distance between two centres."""
    d = ((centres[:, None] - centres[None]) ** 2).sum(axis=2)
    return float(d[~np.eye(len(centres), dtype=bool)].min()) if len(centres) > 1 else math.nan


def xie_beni(objective: float, rows: int, centres: np.ndarray) -> float:
    apart = separation(centres)
    return objective / (rows * apart) if rows and apart > 1e-12 else math.nan


# One pass over the rows


CHUNK = 4_096


def packed(points: DataFrame, column: str = "point", others: dict[str, Column] | None = None, weight: str | None = None) -> DataFrame:
    """Distinct points with their other values and ``n``, the rows that have them, packed in blocks of doubles.

    ``weight`` names a column of the rows that each given one stands for.

    Passes of an iteration read bytes instead of rows, in as many tasks as there are cores, and equal rows once.
    Columns are x, the others' names and n.
    """
    others = others or {}
    distinct = points.groupBy(F.col(column).alias("x"), *[c.alias(name) for name, c in others.items()]).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    names = ["x", *others, "n"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = [batch.column(0).flatten(), *batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy(zero_copy_only=False).astype(float).tobytes()], pa.binary()) for c in columns], names)

    tasks = points.sparkSession.sparkContext.defaultParallelism
    return distinct.select(*names).repartition(tasks, "x").mapInArrow(pack, ", ".join(f"{n} binary" for n in names))


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[np.ndarray]]:
    """The packed points of a task: coordinates by row of ``size``, then the other values."""
    for batch in batches:
        for block in zip(*[c.to_pylist() for c in batch.columns]):
            x, *values = (np.frombuffer(b, dtype=float) for b in block)
            x = np.ascontiguousarray(x.reshape(-1, size).T)
            for a in range(0, x.shape[1], CHUNK):
                yield [np.ascontiguousarray(x[:, a : a + CHUNK]), *[v[a : a + CHUNK] for v in values]]


def _added(chunks: Iterable[list[np.ndarray]], sums: Callable[..., np.ndarray]) -> np.ndarray | None:
    total = None
    for chunk in chunks:
        part = sums(*chunk)
        total = part if total is None else total + part
    return total


def block_sums(blocks: DataFrame, size: int, sums: Callable[..., np.ndarray]) -> np.ndarray | None:
    """The sum over all blocks of what ``sums`` makes of one: coordinates by row of ``size``, then the other values.

    Each task adds up its own blocks, so the driver gets one array per task; without blocks there is none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _added(_chunks(batches, size), sums)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    found = [np.frombuffer(row["total"], dtype=float) for row in blocks.mapInArrow(run, "total binary").collect()]  # one row per task
    return np.sum(found, axis=0) if found else None


#: Distinct points that every task may hold, some megabytes; results do not depend on it.
MOST_HELD = 100_000


def iterate(blocks: DataFrame, size: int, begins: list, sums: Callable[..., np.ndarray], step: Callable[[object, np.ndarray], tuple[object, bool]]) -> list:
    """The last state of every start, none of which needs another; blocks are persisted.

    A pass makes ``step(state, total)``, which also tells whether to go on; total adds up ``sums(state, x, *values)``
    over all packed points.  Up to ``MOST_HELD`` distinct points are broadcast and the starts dealt to tasks, which
    do all passes of their own in one job.  More points stay where they are, and each pass is a job for all live starts.
    """
    if not begins:
        return []
    values = blocks.columns[1:]
    held = blocks.agg(F.sum(F.octet_length(values[-1])) / 8).first()[0] or 0
    if not 0 < held <= MOST_HELD:
        return _passes(blocks, size, begins, sums, step)
    tasks = min(len(begins), blocks.sparkSession.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, own = None, []
        for batch in batches:
            if batch.num_rows:
                task = batch.column(0)[0].as_py()
                own += _chunks(iter([batch.select(range(1, batch.num_columns))]), size)
        for i in range(len(begins))[task::tasks] if own else ():
            now, going = begins[i], True
            while going:
                now, going = step(now, _added(own, lambda *chunk: sums(now, *chunk)))
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([pickle.dumps(now)], pa.binary())], ["start", "state"])

    dealt = blocks.sparkSession.range(0, tasks, 1, tasks).crossJoin(F.broadcast(blocks))
    ended = {r["start"]: pickle.loads(r["state"]) for r in dealt.mapInArrow(run, "start long, state binary").collect()}  # one row per start
    return [ended[i] for i in range(len(begins))]


def _passes(blocks: DataFrame, size: int, begins: list, sums: Callable[..., np.ndarray], step: Callable[[object, np.ndarray], tuple[object, bool]]) -> list:
    """``iterate`` with a job per pass."""
    nothing = [np.zeros((size, 0)), *[np.zeros(0) for _ in blocks.columns[1:]]]
    now, live = list(begins), list(range(len(begins)))
    while live:
        asked = [now[i] for i in live]
        zero = [sums(s, *nothing) for s in asked]
        flat = block_sums(blocks, size, lambda *chunk: np.concatenate([sums(s, *chunk) for s in asked]))
        totals = zero if flat is None else np.split(flat, np.cumsum([len(z) for z in zero])[:-1])
        stepped = [step(s, total) for s, total in zip(asked, totals)]
        for i, (state, _) in zip(live, stepped):
            now[i] = state
        live = [i for i, (_, going) in zip(live, stepped) if going]
    return now


def gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, a row per centre; x has a row per coordinate."""
    out = np.zeros((len(centres), x.shape[1]))
    for own, c in zip(x, centres.T):
        one = own - c[:, None]
        one *= one
        out += one
    return out


def numpy_memberships(d2: np.ndarray, fuzziness: float) -> np.ndarray:
    """Memberships, a row per centre."""
    touched = d2 <= TOUCH
    with np.errstate(divide="ignore", invalid="ignore"):
        u = d2.min(axis=0) / d2
        if fuzziness != 2.0:
            u **= 1.0 / (fuzziness - 1.0)
        u /= u.sum(axis=0)
    some = touched.any(axis=0)
    if some.any():
        u[:, some] = touched[:, some] / touched[:, some].sum(axis=0)
    return u


def fuzzy_sums(points: DataFrame, sets: list[np.ndarray], fuzziness: float, left_out: str | None = None, column: str = "point") -> list[dict]:
    """Per set of centres: rows, objective, and per centre the sums of u^m, u^m x and hard-winner membership.

    ``left_out`` names a boolean column; for its rows there are sums of their own, so a caller can take them away
    (``out_weight`` and so on).
    """
    return packed_fuzzy_sums(fuzzy_blocks(points, left_out, column), sets, fuzziness)


def fuzzy_blocks(points: DataFrame, left_out: str | None = None, column: str = "point") -> DataFrame:
    """The points packed for fuzzy sums."""
    return packed(points, column, {"out": F.coalesce(F.col(left_out), F.lit(False)) if left_out else F.lit(False)})


def packed_fuzzy_sums(blocks: DataFrame, sets: list[np.ndarray], fuzziness: float) -> list[dict]:
    """``fuzzy_sums`` over packed points."""
    return _fuzzy_told(block_sums(blocks, len(sets[0][0]), lambda *chunk: _fuzzy_parts(sets, fuzziness, *chunk)), sets)


def _fuzzy_parts(sets: list[np.ndarray], fuzziness: float, x: np.ndarray, out: np.ndarray, n: np.ndarray) -> np.ndarray:
    parts = []
    for centres in sets:
        d2 = gaps(x, centres)
        u = numpy_memberships(d2, fuzziness)
        weight, winner = u**fuzziness * n, u.argmax(axis=0)
        parts.append(np.array([n.sum(), (weight * d2).sum()]))
        top = u.max(axis=0) * n
        for share in (1.0 - out, out):
            w = weight * share
            parts += [w.sum(axis=1), (w @ x.T).ravel(), np.bincount(winner, weights=top * share, minlength=len(centres))]
    return np.concatenate(parts)


def _fuzzy_told(flat: np.ndarray | None, sets: list[np.ndarray]) -> list[dict]:
    """The sums of each set by name."""
    at, found = 0, []
    for centres in sets:
        k, size = centres.shape
        length = 2 + 2 * k * (size + 2)
        v = np.zeros(length) if flat is None else flat[at : at + length]
        at += length
        one = {"rows": int(v[0]), "objective": float(v[1])}
        for prefix, w in (("", v[2 : 2 + k * (size + 2)]), ("out_", v[2 + k * (size + 2) :])):
            one |= {f"{prefix}weight": w[:k], f"{prefix}moment": w[k : k + k * size].reshape(k, size), f"{prefix}won": w[k + k * size :]}
        found.append(one)
    return found


def conditions(points: DataFrame, centres: np.ndarray, config: FuzzyConfig = FuzzyConfig(), column: str = "point") -> tuple[bool, bool]:
    """Whether any row meets condition one (memberships all close to 1/K), and whether any meets condition two
    (farther from every centre than half that centre's farthest separation)."""
    row = points.agg(*[F.coalesce(F.bool_or(c), F.lit(False)) for c in condition_columns(F.col(column), centre_array(centres), config)]).first()
    return bool(row[0]), bool(row[1])


def candidate_sizes(k: int, condition_one: bool, condition_two: bool, rows: int) -> list[int]:
    """Numbers of clusters to try; below two or above the number of rows is dropped."""
    sizes = {(False, False): [k], (True, False): [k - 1, k + 1], (False, True): [k, k + 1], (True, True): [k - 1, k, k + 1]}
    return [n for n in sizes[condition_one, condition_two] if 2 <= n <= rows]


def unclassifiable(point: Column, centres: np.ndarray, config: FuzzyConfig = FuzzyConfig()) -> Column:
    """Whether a row meets both conditions under the given centres; null points are null."""
    first, second = condition_columns(point, centre_array(centres), config)
    return first & second


def condition_columns(point: Column, centres: Column, config: FuzzyConfig = FuzzyConfig()) -> tuple[Column, Column]:
    """Condition one and condition two of a row, as expressions over a column of centres."""
    d2 = squared_distances(point, centres)
    u = memberships(d2, config.fuzziness)
    is_even = F.array_max(F.transform(u, lambda m: F.abs(m - 1.0 / F.size(centres)))) <= config.even_margin
    reach = F.transform(centres, lambda a: F.array_max(squared_distances(a, centres)))  # squared farthest separation
    outside = F.forall(F.zip_with(d2, reach, lambda d, f: F.sqrt(d) > F.sqrt(f) / 2), lambda far: far) & (F.size(centres) > 1)
    return is_even, outside


def starts(points: DataFrame, centres: np.ndarray, sizes: list[int], masses: np.ndarray, column: str = "point") -> list[Start]:
    """The starts for each size, see ``starts_from``."""
    flat = block_sums(packed(points, column), centres.shape[1], lambda x, n: _own_parts(centres, gaps(x, centres), x, n)) if len(centres) + 1 in sizes else None
    return starts_from(centres, sizes, masses, flat)


def _own_parts(centres: np.ndarray, d2: np.ndarray, x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Rows, loss, sums and sums of products of the points of each centre, flat; a point counts with its nearest, first of ties."""
    own, pairs = d2.argmin(axis=0), np.triu_indices(len(x))
    values = [n, d2.min(axis=0) * n, *(x * n), *(x[pairs[0]] * x[pairs[1]] * n)]
    return np.stack([np.bincount(own, weights=v, minlength=len(centres)) for v in values], axis=1).ravel()


def starts_from(centres: np.ndarray, sizes: list[int], masses: np.ndarray, own: np.ndarray | None) -> list[Start]:
    """The starts for each size, in order of size: one centre less, all kept and moved, or one centre split.

    A split moves a centre by half the root of its mean loss along the first axis of its members' covariance, to
    both sides: back in its own place, forward behind all others.  ``own`` are the sums of ``_own_parts``.
    """
    k, size = centres.shape
    out = [Start(f"drop {i}", np.delete(centres, i, axis=0)) for i in range(k)] if k - 1 in sizes else []
    if k in sizes:
        out.append(Start("keep", centres, masses))
    if k + 1 in sizes:
        at = np.triu_indices(size)
        found = np.zeros((k, 2 + size + len(at[0]))) if own is None else own.reshape(k, -1)
        for c, (n, lost, *sums) in enumerate(found.tolist()):
            axis, loss = np.eye(size)[0], 0.0  # a centre with fewer than two members splits along the first axis
            if n >= 2:
                mean = np.array(sums[:size]) / n
                cov = np.zeros((size, size))
                for i, j, p in zip(*at, sums[size:]):
                    cov[i, j] = cov[j, i] = (p - n * mean[i] * mean[j]) / (n - 1)
                axis, loss = np.linalg.eigh(cov)[1][:, -1], max(lost, 0.0) / n
            axis = axis * (np.sign(axis[np.abs(axis).argmax()]) or 1.0)
            step = max(math.sqrt(loss) / 2, 1e-3)
            split = np.vstack([centres, centres[c] + step * axis])
            split[c] = centres[c] - step * axis
            out.append(Start(f"split {c}", split))
    return out


def moved(start: Start, sums: dict) -> np.ndarray:
    """The centres after one update.

    Plain fuzzy c-means takes weighted means of all rows.  A moving start blends where it stood with the means of
    the rows that are not left out, by the share of new mass, (hard-winner membership) / (carried + new); a centre
    without new mass stays.
    """
    fixed = start.centres
    if start.carried is None:
        weight = np.maximum(sums["weight"] + sums["out_weight"], 1e-12)
        return (sums["moment"] + sums["out_moment"]) / weight[:, None]
    some = sums["weight"] > 1e-12
    mean = np.divide(sums["moment"], sums["weight"][:, None], out=fixed.astype(float).copy(), where=some[:, None])
    total = start.carried + sums["won"]
    share = np.divide(sums["won"], total, out=np.zeros(len(fixed)), where=some & (total > 1e-12))[:, None]
    return (1 - share) * fixed + share * mean


def fit_starts(points: DataFrame, tried: list[Start], config: FuzzyConfig = FuzzyConfig(), left_out: str | None = None, column: str = "point", made: int = 0) -> list[Fit]:
    """Update every start until its objective changes by no more than the tolerance; all live starts per pass.

    A pass gives the objective of the centres it was asked for and the sums for their next update.  ``made`` is
    the number of updates that the given centres come from.
    """
    return fit_packed(fuzzy_blocks(points, left_out, column), tried, config, made)


def fit_packed(blocks: DataFrame, tried: list[Start], config: FuzzyConfig = FuzzyConfig(), made: int = 0) -> list[Fit]:
    """``fit_starts`` over packed points x, out, n."""

    def sums(state: tuple, *chunk: np.ndarray) -> np.ndarray:
        return _fuzzy_parts([state[1]], config.fuzziness, *chunk)

    def step(state: tuple, flat: np.ndarray) -> tuple[object, bool]:
        start, now, done, last = state  # updates made so far
        s = _fuzzy_told(flat, [now])[0]
        settled = done >= 2 and abs(last - s["objective"]) <= config.tolerance
        if settled or done == config.max_iterations:
            return Fit(now, s["objective"], xie_beni(s["objective"], s["rows"], now), done, settled, start.source, start.centres, start.carried), False
        return (start, moved(start, s), done + 1, s["objective"] if done else math.inf), True

    if not tried or made > config.max_iterations:
        return []
    blocks = blocks.persist()
    try:
        return iterate(blocks, tried[0].centres.shape[1], [(s, s.centres.astype(float), made, math.inf) for s in tried], sums, step)
    finally:
        blocks.unpersist()


def fit_fuzzy(points: DataFrame, first: np.ndarray, config: FuzzyConfig = FuzzyConfig(), column: str = "point") -> Fit:
    """Plain fuzzy c-means from given centres."""
    return fit_starts(points, [Start("fuzzy", first)], config, column=column)[0]


def best_fit(fits: list[Fit]) -> Fit:
    """Lowest finite Xie-Beni index among converged fits, the first of ties; every number of clusters tried must have one."""
    usable = [f for f in fits if f.converged and math.isfinite(f.xie_beni) and math.isfinite(f.objective)]
    without = sorted({len(f.centres) for f in fits} - {len(f.centres) for f in usable})
    if without or not usable:
        raise ValueError(f"no converged candidate with a finite index for {without} clusters")
    return min(usable, key=lambda f: f.xie_beni)


def update(points: DataFrame, centres: np.ndarray, masses: np.ndarray, config: FuzzyConfig = FuzzyConfig(), column: str = "point") -> tuple[Fit, list[Fit], tuple[int, int, int]]:
    """One cycle's step: the choice, all fits, and how many rows meet condition one, two and both."""
    blocks = packed(points, column).persist()
    try:
        return packed_update(blocks, centres, masses, config)[:3]
    finally:
        blocks.unpersist()


def packed_update(blocks: DataFrame, centres: np.ndarray, masses: np.ndarray, config: FuzzyConfig = FuzzyConfig()) -> tuple[Fit, list[Fit], tuple[int, int, int], int]:
    """``update`` over packed points, and the number of rows; one pass of sums tells conditions and starts."""
    blocks = blocks.select("x", "n")
    flat = block_sums(blocks, centres.shape[1], lambda x, n: _update_parts(centres, config, x, n))
    n, *met = (int(v) for v in (np.zeros(4) if flat is None else flat[:4]))
    sizes = candidate_sizes(len(centres), met[0] > 0, met[1] > 0, n)
    tried = starts_from(centres, sizes, masses, None if flat is None else flat[4:])
    fits = fit_packed(_flagged(blocks, centres, config), tried, config)
    return best_fit(fits), fits, tuple(met), n


def _conditions(d2: np.ndarray, centres: np.ndarray, config: FuzzyConfig) -> tuple[np.ndarray, np.ndarray]:
    """``condition_columns`` of points with these squared distances, a row per centre."""
    even = np.abs(numpy_memberships(d2, config.fuzziness) - 1.0 / len(centres)).max(axis=0) <= config.even_margin
    reach = ((centres[:, None] - centres[None]) ** 2).sum(axis=2).max(axis=1)
    outside = (np.sqrt(d2) > np.sqrt(reach)[:, None] / 2).all(axis=0) & (len(centres) > 1)
    return even, outside


def _update_parts(centres: np.ndarray, config: FuzzyConfig, x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Rows in all and of condition one, two and both, then ``_own_parts``."""
    d2 = gaps(x, centres)
    first, second = _conditions(d2, centres, config)
    return np.concatenate([[n.sum(), n[first].sum(), n[second].sum(), n[first & second].sum()], _own_parts(centres, d2, x, n)])


def _flagged(blocks: DataFrame, centres: np.ndarray, config: FuzzyConfig) -> DataFrame:
    """Packed points (x, n) as x, out, n: out tells those that meet both conditions."""

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outs = []
            for held in batch.column(0).to_pylist():
                x = np.frombuffer(held, dtype=float).reshape(-1, centres.shape[1]).T
                first, second = _conditions(gaps(x, centres), centres, config)
                outs.append((first & second).astype(float).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(outs, pa.binary()), batch.column(1)], ["x", "out", "n"])

    return blocks.mapInArrow(flag, "x binary, out binary, n binary")
