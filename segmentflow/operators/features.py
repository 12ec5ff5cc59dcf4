"""Scaling and projection with parameters frozen on the baseline cycle."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmentflow.operators.snapshot import FEATURES


@dataclass(frozen=True)
class Scaling:
    """(value - shift) / width per column; a width of zero maps to width one."""

    columns: tuple[str, ...]
    shift: tuple[float, ...]
    width: tuple[float, ...]

    def apply(self, df: DataFrame, prefix: str = "scaled_") -> DataFrame:
        return df.withColumns(
            {
                f"{prefix}{c}": (F.col(c) - F.lit(s)) / F.lit(w if w else 1.0)
                for c, s, w in zip(self.columns, self.shift, self.width)
            }
        )


def fit_min_max(baseline: DataFrame, columns: tuple[str, ...] = FEATURES) -> Scaling:
    """Minimum and range by one aggregation; later values may leave [0, 1]."""
    row = baseline.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]).first()
    low = [row[f"lo_{c}"] for c in columns]
    return Scaling(columns, tuple(low), tuple(row[f"hi_{c}"] - lo for c, lo in zip(columns, low)))


def fit_robust(baseline: DataFrame, columns: tuple[str, ...]) -> Scaling:
    """Median and interquartile range with linear quantiles."""
    row = baseline.agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(c) for c in columns]).first()
    return Scaling(columns, tuple(row[c][1] for c in columns), tuple(row[c][2] - row[c][0] for c in columns))


@dataclass(frozen=True)
class Projection:
    """Centred linear projection onto the leading eigenvectors of a covariance matrix."""

    columns: tuple[str, ...]
    mean: np.ndarray
    loadings: np.ndarray  # components x columns
    explained: np.ndarray

    def apply(self, df: DataFrame, prefix: str = "pc") -> DataFrame:
        def component(weights: np.ndarray) -> Column:
            terms = [(F.col(c) - F.lit(float(m))) * F.lit(float(w)) for c, m, w in zip(self.columns, self.mean, weights)]
            return sum(terms[1:], terms[0])

        return df.withColumns({f"{prefix}{i + 1}": component(w) for i, w in enumerate(self.loadings)})


def fit_pca(baseline: DataFrame, columns: tuple[str, ...], components: int = 3) -> Projection:
    """Covariance by one aggregation, eigenvectors of the small matrix on the driver.

    The largest loading of each component is positive, which fixes its sign.
    """
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    means = baseline.agg(*[F.avg(c) for c in columns], *[F.covar_samp(columns[i], columns[j]) for i, j in pairs]).first()
    mean = np.array(means[: len(columns)], dtype=float)
    cov = np.zeros((len(columns),) * 2)
    for (i, j), v in zip(pairs, means[len(columns) :]):
        cov[i, j] = cov[j, i] = v or 0.0
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:components]
    loadings = vectors[:, order].T
    signs = np.sign(loadings[np.arange(len(order)), np.abs(loadings).argmax(axis=1)])
    return Projection(columns, mean, loadings * signs[:, None], values[order] / max(values.sum(), 1e-300))
