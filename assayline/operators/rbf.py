"""Kernel regression with a radial basis kernel, approximated by random Fourier features.

The features follow Rahimi and Recht (2007); the estimator is ridge regression
on them (``1 / C`` is the ridge), optionally reweighted towards the epsilon-insensitive
loss.  It is an approximation by design, not an exact support vector solver:
its cost grows with the rows once per pass, not with their square.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from assayline.plans.moments import Moments, covariance, fit_moments, moment_rows
from assayline.plans.scans import collect_sums, pack_rows, sum_over_rows

SMALLEST_GAP = 1e-3  # keeps the weight of a row just outside the insensitive zone finite


@dataclass(frozen=True)
class RbfPoint:
    """One candidate: feature positions and the three hyperparameters."""

    positions: tuple[int, ...]
    c: float
    epsilon: float
    gamma: float


def _projection(point: RbfPoint, dimension: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, *point.positions])
    directions = rng.standard_normal((len(point.positions), dimension)) * np.sqrt(2.0 * point.gamma)
    return directions, rng.uniform(0.0, 2.0 * np.pi, dimension)


def _design(x: np.ndarray, point: RbfPoint, dimension: int, seed: int) -> np.ndarray:
    directions, phase = _projection(point, dimension, seed)
    waves = np.cos(x[:, list(point.positions)] @ directions + phase) * np.sqrt(2.0 / dimension)
    return np.column_stack([np.ones(len(x)), waves])


def _ridge(matrix: np.ndarray, c: float) -> np.ndarray:
    """Coefficients from ``[Z, y]' [Z, y]``; the constant is not penalised."""
    left = matrix[:-1, :-1] + np.diag([0.0, *[1.0 / c] * (len(matrix) - 2)])
    return np.linalg.lstsq(left, matrix[:-1, -1], rcond=None)[0]


def rbf_cv(
    df: DataFrame,
    features: Sequence[str] | str,
    target: str,
    fold: str,
    folds: int,
    points: Sequence[RbfPoint],
    dimension: int = 64,
    passes: int = 2,
    seed: int = 0,
    base: Moments | None = None,
) -> list[float]:
    """Pooled cross-validated r2 of every point; all points share each scan.

    ``passes`` counts the reweighted scans towards the epsilon-insensitive loss;
    0 keeps the squared loss, which needs one scan.
    """
    base = base or fit_moments(df, features, target, fold, folds)  # only for scaling; reusable
    n, mean, products = covariance(base.total)
    sd = np.sqrt(np.clip(np.diag(products), 0, None) / max(n - 1, 1))
    scale, place = np.where(sd > 0, sd, 1.0), mean + base.centre
    sst = products[-1, -1] / scale[-1] ** 2
    rows = moment_rows(df, features, target, fold)
    scan = pack_rows(rows).totals if passes else lambda statistic: collect_sums(sum_over_rows(rows, statistic))
    size = dimension + 2
    upper = np.triu_indices(size)

    def standard(batch):
        return (batch["x"] - place[:-1]) / scale[:-1], (batch["y"] - place[-1]) / scale[-1]

    def symmetric(flat):
        matrix = np.zeros((size, size))
        matrix[upper] = flat
        return matrix + np.triu(matrix, 1).T

    def first(batch):
        x, y = standard(batch)
        out = {}
        for i, point in enumerate(points):
            design = np.column_stack([_design(x, point, dimension, seed), y])
            for f in np.unique(batch["fold"]):
                part = design[batch["fold"] == f]
                out[f"{i}|{f}"] = (part.T @ part)[upper]
        return out

    sums = scan(first)
    held = {i: [symmetric(sums[f"{i}|{f}"]) if f"{i}|{f}" in sums else np.zeros((size, size)) for f in range(folds)]
            for i in range(len(points))}
    fitted = {i: [_ridge(sum(m) - m[f], points[i].c) for f in range(folds)] for i, m in held.items()}

    for _ in range(passes):
        def reweighted(batch, current=fitted):
            x, y = standard(batch)
            out = {}
            for i, point in enumerate(points):
                z = _design(x, point, dimension, seed)
                for f in range(folds):
                    rest = batch["fold"] != f
                    if not rest.any():
                        continue
                    residual = y[rest] - z[rest] @ current[i][f]
                    gap = np.abs(residual) - point.epsilon
                    weight = np.where(gap > 0, 1.0 / np.maximum(gap, SMALLEST_GAP), 0.0)
                    pulled = y[rest] - np.sign(residual) * point.epsilon
                    design = np.column_stack([z[rest], pulled])
                    out[f"{i}|{f}"] = ((design * weight[:, None]).T @ design)[upper]
            return out

        sums = scan(reweighted)
        # half of the weight: the slope of the loss is 1 outside the zone, that of w * r^2 is 2 w r
        fitted = {
            i: [_ridge(0.5 * symmetric(sums[f"{i}|{f}"]), points[i].c) if f"{i}|{f}" in sums else fitted[i][f]
                for f in range(folds)]
            for i in fitted
        }

    if passes == 0:
        errors = {i: sum(float(np.append(-b, 1.0) @ held[i][f] @ np.append(-b, 1.0)) for f, b in enumerate(fits))
                  for i, fits in fitted.items()}
    else:
        def held_out(batch):
            x, y = standard(batch)
            out = {}
            for i, point in enumerate(points):
                z = _design(x, point, dimension, seed)
                slopes = np.array(fitted[i])[batch["fold"]]
                out[str(i)] = np.array([((y - (z * slopes).sum(axis=1)) ** 2).sum()])
            return out

        errors = {int(k): float(v[0]) for k, v in scan(held_out).items()}
    return [1.0 - errors[i] / sst for i in range(len(points))]
