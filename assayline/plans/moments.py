"""Moment matrices ``[1, X, y]' [1, X, y]``: one scan serves every least-squares fit.

The training moments of a cross-validation fold are the total minus the fold,
and the moments of a feature subset are a sub-matrix, so neither needs the
rows again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.plans.scans import collect_sums, feature_array, feature_names, is_complete, long_sums, means_of, sum_over_rows


@dataclass(frozen=True)
class Moments:
    """Moment matrices per fold, ``(folds, p + 2, p + 2)``, about the shift ``centre``."""

    features: tuple[str, ...]
    folds: np.ndarray
    centre: np.ndarray

    @property
    def total(self) -> np.ndarray:
        return self.folds.sum(axis=0)

    def subset(self, positions: Sequence[int]) -> Moments:
        """Moments of some of the features (target kept)."""
        last = self.folds.shape[1] - 1
        rows = np.array([0, *[p + 1 for p in positions], last])
        return Moments(
            tuple(self.features[p] for p in positions),
            self.folds[:, rows[:, None], rows[None, :]],
            self.centre[np.array([*positions, last - 1])],
        )


def shift_of(rows: DataFrame) -> np.ndarray:
    """About the mean; removes the digits lost when |mean| >> std."""
    return means_of(rows, "x", "y")


def moment_rows(
    df: DataFrame,
    features: Sequence[str] | str,
    target: str | None = None,
    fold: Column | str | None = None,
) -> DataFrame:
    """Columns ``x`` (array), ``y`` and ``fold`` of the rows without a missing value."""
    x = feature_array(features)
    y = F.col(target).cast("double") if target else F.lit(0.0)
    f = F.lit(0) if fold is None else (F.col(fold) if isinstance(fold, str) else fold)
    known = is_complete(features) if target is None else is_complete(features) & is_complete([target])
    return df.where(known).select(x.alias("x"), y.alias("y"), f.cast("int").alias("fold"))


def moment_sums(rows: DataFrame, centre: np.ndarray) -> DataFrame:
    """Upper triangles of the moment matrices as partial sums (model = fold)."""
    size = len(centre) + 1
    upper = np.triu_indices(size)

    def statistic(batch):
        design = np.column_stack(
            [np.ones(len(batch["y"])), batch["x"] - centre[:-1], batch["y"] - centre[-1]]
        )
        out = {}
        for fold in np.unique(batch["fold"]):
            part = design[batch["fold"] == fold]
            out[str(fold)] = (part.T @ part)[upper]
        return out

    return sum_over_rows(rows, statistic)


def fit_moments(
    df: DataFrame,
    features: Sequence[str] | str,
    target: str,
    fold: Column | str | None = None,
    folds: int = 1,
) -> Moments:
    """Collect the moment matrices of all folds in one scan.

    The shift comes from a few rows; where it turns out to be far from a feature's mean, the scan is
    repeated with the mean.
    """
    rows = moment_rows(df, features, target, fold)
    centre = shift_of(rows)
    matrices = _matrices(rows, centre, folds)
    n, mean, products = covariance(matrices.sum(axis=0))
    if (np.abs(mean) > FAR * np.sqrt(np.clip(np.diag(products), 0, None) / n)).any():
        centre = centre + mean
        matrices = _matrices(rows, centre, folds)
    return Moments(tuple(feature_names(df, features)), matrices, centre)


#: Standard deviations between a shift and the mean that cost too many digits.
FAR = 1e3


def _matrices(rows: DataFrame, centre: np.ndarray, folds: int) -> np.ndarray:
    size = len(centre) + 1
    upper = np.triu_indices(size)
    matrices = np.zeros((folds, size, size))
    for model, flat in collect_sums(moment_sums(rows, centre)).items():
        matrix = np.zeros((size, size))
        matrix[upper] = flat
        matrices[int(model)] = matrix + np.triu(matrix, 1).T
    return matrices


def moment_table(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    fold: Column | str | None = None,
) -> DataFrame:
    """Uncentred sums of products per fold in long form: (fold, a, b, value).

    ``a`` and ``b`` run over ``"1"``, the features and the target, a before b.
    """
    names = ["1", *feature_names(df, features), target]
    pairs = [(names[i], names[j]) for i, j in zip(*np.triu_indices(len(names)))]
    sums = moment_sums(moment_rows(df, features, target, fold), np.zeros(len(names) - 1))
    table = df.sparkSession.createDataFrame(
        [(n, a, b) for n, (a, b) in enumerate(pairs)], "idx int, a string, b string"
    )
    return long_sums(sums).join(F.broadcast(table), "idx").select(  # (p + 2)^2 / 2 rows
        F.col("model").cast("int").alias("fold"), "a", "b", "value"
    )


def covariance(matrix: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Row count, means and centred sums of products of a moment matrix."""
    n = matrix[0, 0]
    mean = matrix[0, 1:] / n
    return n, mean, matrix[1:, 1:] - n * np.outer(mean, mean)


def correlation(matrix: np.ndarray) -> np.ndarray:
    """Pearson correlations from a moment matrix; constant columns correlate with nothing."""
    _, _, products = covariance(matrix)
    scale = np.sqrt(np.clip(np.diag(products), 0, None))
    with np.errstate(divide="ignore", invalid="ignore"):
        r = products / np.outer(scale, scale)
    r[~np.isfinite(r)] = 0.0
    np.fill_diagonal(r, 1.0)
    return np.clip(r, -1.0, 1.0)
