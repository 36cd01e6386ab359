"""Partial least squares with one target, fitted and cross-validated from moment matrices.

The components follow the modified kernel algorithm (Dayal and MacGregor,
1997).  Scaling inside each training fold comes from the fold's own moments.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.functions.scalar import dot
from assayline.plans.moments import Moments, covariance, fit_moments
from assayline.plans.scans import feature_array

RANK_TOLERANCE = 1e-10


def pls_coefficients(matrix: np.ndarray, components: int) -> np.ndarray:
    """Rows ``[intercept, slopes]`` in the units of ``matrix`` for 1 .. ``components`` components."""
    n, mean, products = covariance(matrix)
    sd = np.sqrt(np.clip(np.diag(products), 0, None) / max(n - 1, 1))
    scale = np.where(sd > 0, sd, 1.0)
    scaled = products / np.outer(scale, scale)
    xx, left = scaled[:-1, :-1], scaled[:-1, -1].copy()
    p = len(left)
    rotations, loadings = np.zeros((components, p)), np.zeros((components, p))
    slopes, out = np.zeros(p), np.zeros((components, p + 1))
    tiny = RANK_TOLERANCE * max(float(np.trace(xx)), 1e-300)
    for a in range(components):
        length = np.linalg.norm(left)
        if length > 0:
            direction = left / length
            rotation = direction - rotations[:a].T @ (loadings[:a] @ direction)
            carried = xx @ rotation
            size = rotation @ carried
            if size > tiny * (rotation @ rotation):
                loadings[a], rotations[a] = carried / size, rotation
                share = (left @ rotation) / size
                left = left - loadings[a] * share * size
                slopes = slopes + rotation * share
        b = slopes * scale[-1] / scale[:-1]
        out[a, 0], out[a, 1:] = mean[-1] - mean[:-1] @ b, b
    return out


def squared_error(matrix: np.ndarray, coefficients: np.ndarray) -> float:
    """Sum of squared residuals of the rows behind ``matrix``."""
    v = np.concatenate([-coefficients, [1.0]])
    return float(v @ matrix @ v)


def matrix_rank(matrix: np.ndarray) -> int:
    """Rank of the standardised features."""
    _, _, products = covariance(matrix[:-1, :-1])
    sd = np.sqrt(np.clip(np.diag(products), 0, None))
    keep = sd > 0
    if not keep.any():
        return 0
    r = products[np.ix_(keep, keep)] / np.outer(sd[keep], sd[keep])
    values = np.linalg.eigvalsh(r)
    return int((values > RANK_TOLERANCE * values.max()).sum())


def cross_validated_r2(folds: np.ndarray, max_components: int = 10) -> np.ndarray:
    """Pooled r2 of the held-out rows for 1 .. min(rank, max_components, p) components."""
    total = folds.sum(axis=0)
    components = min(matrix_rank(total), max_components, total.shape[0] - 2)
    if components < 1:
        return np.zeros(0)
    errors = np.zeros(components)
    for held_out in folds:
        fitted = pls_coefficients(total - held_out, components)
        errors += [squared_error(held_out, c) for c in fitted]
    sst = covariance(total)[2][-1, -1]
    return 1.0 - errors / sst if sst > 0 else np.full(components, -np.inf)


@dataclass(frozen=True)
class PlsModel:
    """Coefficients in original units."""

    features: tuple[str, ...]
    intercept: float
    slopes: tuple[float, ...]
    components: int

    def predict(self, features: Sequence[str] | str) -> Column:
        return dot(feature_array(features), self.slopes) + F.lit(self.intercept)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [("intercept", self.intercept), *zip(self.features, self.slopes)]
        return spark.createDataFrame(rows, "term string, coefficient double")


def model_from(moments: Moments, components: int) -> PlsModel:
    fitted = pls_coefficients(moments.total, components)[-1]
    slopes = fitted[1:]
    intercept = fitted[0] + moments.centre[-1] - slopes @ moments.centre[:-1]
    return PlsModel(moments.features, float(intercept), tuple(map(float, slopes)), components)


def pls_fit(df: DataFrame, features: Sequence[str] | str, target: str, components: int) -> PlsModel:
    """Fit with a given number of components; one scan."""
    return model_from(fit_moments(df, features, target), components)


def pls_cv(
    df: DataFrame,
    features: Sequence[str] | str,
    target: str,
    fold: Column | str,
    folds: int = 5,
    max_components: int = 10,
) -> DataFrame:
    """Pooled r2 of the held-out rows per number of components: (components, r2, is_best)."""
    moments = fit_moments(df, features, target, fold, folds)
    r2 = cross_validated_r2(moments.folds, max_components)
    best = int(np.argmax(r2)) if len(r2) else -1
    rows = [(a + 1, float(v), a == best) for a, v in enumerate(r2)]
    return df.sparkSession.createDataFrame(rows, "components int, r2 double, is_best boolean")


def pls_cv_predict(
    df: DataFrame,
    features: Sequence[str] | str,
    target: str,
    fold: str,
    folds: int = 5,
    components: int = 1,
    out: str = "predicted",
) -> DataFrame:
    """Prediction of each row by the model trained without its fold."""
    moments = fit_moments(df, features, target, fold, folds)
    held_out = None
    for f in range(folds):
        rest = Moments(moments.features, (moments.total - moments.folds[f])[None], moments.centre)
        score = model_from(rest, components).predict(features)
        held_out = F.when(F.col(fold) == f, score) if held_out is None else held_out.when(F.col(fold) == f, score)
    return df.withColumn(out, held_out)


def r2_score(df: DataFrame, target: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """``1 - sse / sst`` over the rows with both values: (keys, r2)."""
    y, p = F.col(target), F.col(predicted)
    rows = df.where(y.isNotNull() & p.isNotNull())
    sse, sst = F.sum((y - p) * (y - p)), F.var_pop(y) * F.count("*")
    return rows.groupBy(*keys).agg((1 - F.try_divide(sse, sst)).alias("r2"))
