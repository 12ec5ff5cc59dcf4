"""Profile names of fitted centres from weighted recency, frequency and spending."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from segmentflow.functions.profiles import LEGACY_NAMES, SEPARATOR
from segmentflow.operators.lineage import assign_least_cost

# Frequency rank, spending rank and days of recency of each prototype, and the days of recency
# above and up to which it may be used; weights of the three parts; days that a part is measured in and
# capped at; what a second use of a prototype costs.
PROTOTYPES = {
    "Champions": (1.0, 1.0, 7.0, -1, 30),
    "Champions at Risk": (1.0, 1.0, 60.0, 30, 90),
    "Loyalists": (0.80, 0.65, 12.0, -1, 30),
    "Loyalist at Risk": (0.80, 0.65, 60.0, 30, 90),
    "Mid-Tier Occasional": (0.50, 0.50, 30.0, -1, 60),
    "Occasional at Risk": (0.50, 0.50, 60.0, 30, 90),
    "Developing": (0.15, 0.15, 15.0, -1, 30),
    "Developing at Risk": (0.15, 0.15, 70.0, 30, 90),
    "Hibernating / Lost": (0.0, 0.0, 120.0, 90, np.inf),
}
SHARES = (0.45, 0.40, 0.15)
RECENCY_UNIT, RECENCY_CAP, SECOND_USE = 90.0, 180.0, 10.0
BARRED = 1e9


@dataclass(frozen=True)
class CentreProfile:
    recency: float
    frequency: float
    monetary: float
    frequency_rank: float = 0.0
    monetary_rank: float = 0.0


def profile_parts(u: np.ndarray, recency: np.ndarray, frequency: np.ndarray, monetary: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Squared membership, and recency, frequency and spending by it, summed for each centre, flat; u has a row per centre."""
    w = u * u * n
    return np.stack([w.sum(axis=1), w @ recency, w @ frequency, w @ monetary], axis=1).ravel()


def centre_profiles(sums: np.ndarray) -> list[CentreProfile]:
    """Means of recency, frequency and spending per centre, weighted by squared membership, from the sums of ``profile_parts``."""
    sums = sums.reshape(-1, 4)
    if not (sums[:, 0] > 0).all():
        raise ValueError("a centre has no membership to name it by")
    means = sums[:, 1:] / sums[:, :1]
    recent = means[:, 0] <= 90
    ranks = [_average_rank(means[:, i], recent) for i in (1, 2)]
    return [CentreProfile(*map(float, m), float(f), float(s)) for m, f, s in zip(means, *ranks)]


def _average_rank(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Average-tie percentile ranks within the chosen entries, zero elsewhere."""
    out = np.zeros(len(values))
    chosen = values[among]
    for i in np.flatnonzero(among):
        out[i] = ((chosen < values[i]).sum() + ((chosen == values[i]).sum() + 1) / 2) / len(chosen)
    return out


def prototype_costs(profiles: list[CentreProfile]) -> np.ndarray:
    """Weighted squared distance of each centre to each prototype; barred where the recency does not fit."""
    table = np.array(list(PROTOTYPES.values()), dtype=float)
    recency = np.array([p.recency for p in profiles], dtype=float)[:, None]
    ranks = np.array([(p.frequency_rank, p.monetary_rank) for p in profiles], dtype=float).reshape(-1, 2)
    days = (np.minimum(recency, RECENCY_CAP) - table[:, 2]) / RECENCY_UNIT
    apart = np.dstack([ranks[:, [0]] - table[:, 0], ranks[:, [1]] - table[:, 1], days])
    fits = (recency > table[:, 3]) & (recency <= table[:, 4])
    return np.where(fits, apart**2 @ np.array(SHARES), BARRED)


def settled(found: list[str]) -> list[str]:
    """Public names of prototype names, where ``name · suffix`` is a second use; no name comes twice."""
    used: dict[str, int] = {}
    for i, name in enumerate(found):
        head, apart, suffix = name.partition(SEPARATOR)
        public = LEGACY_NAMES.get(head, head) + apart + suffix
        if head == "Champions" and suffix:
            public = "High-Value Regulars"
        used.setdefault(public if public not in used else f"{public}{SEPARATOR}centre {i + 1}", i)
    return sorted(used, key=used.get)


def names_of(profiles: list[CentreProfile]) -> list[str]:
    """One-to-one assignment to prototypes; a centre left over takes its closest prototype with a suffix."""
    cost = prototype_costs(profiles)
    unfit = np.flatnonzero(cost.min(axis=1) >= BARRED)
    if len(unfit):
        raise ValueError(f"no profile suits centre {unfit[0]}")
    order, k = list(PROTOTYPES), len(profiles)
    second = np.where(np.eye(k, dtype=bool), SECOND_USE, BARRED)
    chosen = dict(assign_least_cost(np.hstack([cost, second])))
    closest = cost.argmin(axis=1)
    return settled([order[chosen[i]] if chosen[i] < len(order) else f"{order[closest[i]]}{SEPARATOR}centre {i + 1}" for i in range(k)])


def rank_sum_names(profiles: list[CentreProfile]) -> list[str]:
    """Variant: centres in order of summed ranks take the four classic names, further ones a number."""
    classic = ("Champions", "Loyalists", "Mid-Tier Occasionals", "Developing")
    table = np.array([[p.frequency, p.monetary, -p.recency] for p in profiles])
    score = sum((table[:, [i]] > table[:, i]).sum(axis=1) for i in range(3))
    order = np.argsort(-score, kind="stable")
    out = [""] * len(profiles)
    for place, i in enumerate(order):
        out[i] = classic[place] if place < len(classic) else f"Segment {place + 1}"
    return out
