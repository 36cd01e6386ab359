"""Missing values filled by iterated Gaussian mixture regression."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.operators.mixture import COVARIANCE_TYPES, Mixture, mixture_bic
from assayline.operators.scale import fit_scaler
from assayline.plans.scans import collect_sums, map_rows, means_of, sum_over_rows


def fill_missing(x: np.ndarray, model: Mixture) -> np.ndarray:
    """Replace NaN cells by the conditional mean of the likeliest component given the observed cells.

    Rows are handled together per pattern of missing cells.
    """
    out = x.copy()
    missing = np.isnan(x)
    patterns, which = np.unique(missing, axis=0, return_inverse=True)
    which = np.asarray(which).ravel()
    for number, pattern in enumerate(patterns):
        if not pattern.any():
            continue
        rows = np.flatnonzero(which == number)
        gone, seen = np.flatnonzero(pattern), np.flatnonzero(~pattern)
        if len(seen):
            best = model.log_joint(x[rows][:, seen], seen).argmax(axis=1)
        else:
            best = np.full(len(rows), int(model.weights.argmax()))
        for component in np.unique(best):
            chosen = rows[best == component]
            mean, cov = model.means[component], model.covariances[component]
            filled = np.repeat(mean[gone][None], len(chosen), axis=0)
            if len(seen):
                slope = np.linalg.solve(cov[np.ix_(seen, seen)], cov[np.ix_(seen, gone)])
                filled = filled + (x[chosen][:, seen] - mean[seen]) @ slope
            out[np.ix_(chosen, gone)] = filled
    return out


def _mean_and_std(rows: DataFrame, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Means and sample standard deviations of the elements of a complete array column."""
    shift = means_of(rows, column)

    def statistic(batch):
        x = batch[column] - shift
        return {"all": np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])}

    flat = collect_sums(sum_over_rows(rows.select(column), statistic))["all"]
    d = len(shift)
    n, total, squares = flat[0], flat[1:1 + d], flat[1 + d:]
    return total / n + shift, np.sqrt((squares - total * total / n) / max(n - 1, 1))


def impute_mixture(
    df: DataFrame,
    features: Sequence[str],
    rounds: int = 10,
    max_components: int = 20,
    covariance_types: Sequence[str] = COVARIANCE_TYPES,
    **options,
) -> DataFrame:
    """Fill the missing cells of ``features``; observed cells and other columns stay as they are.

    Every round standardises, chooses a mixture by the Bayesian information
    criterion, and predicts the missing cells from the observed ones.  The first
    round learns from the complete rows, later rounds from the completed table.
    A completed row depends only on its observed cells and the current model, so
    each round reads the source rows and the lineage does not grow.
    """
    features = list(features)
    nan = F.lit(float("nan"))
    cells = F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), nan) for c in features])
    rows = df.withColumn("_cells", cells)
    known = F.expr(" and ".join(f"`{c}` is not null and not isnan(`{c}`)" for c in features))

    observed = fit_scaler(df, features)  # per feature over the rows that have it
    row_mean = np.array([observed.mean[c] for c in features], dtype=float)
    row_std = np.array([observed.std[c] for c in features], dtype=float)
    learning = rows.where(known).select("_cells")
    fill = None
    for _ in range(rounds):
        mean, std = _mean_and_std(learning, "_cells")
        if fill is not None:
            row_mean, row_std = mean, std
        scaled = map_rows(learning, [], ["_cells"], lambda b, m=mean, s=std: {"z": (b["_cells"] - m) / s}, "z array<double>")
        model, _grid = mixture_bic(scaled, "z", max_components, covariance_types, **options)

        def fill(batch, model=model, mean=mean, std=std, a=row_mean, b=row_std):
            cells = batch["_cells"]
            filled = fill_missing((cells - a) / b, model) * std + mean
            return {"_filled": np.where(np.isnan(cells), filled, cells)}

        learning = map_rows(rows, [], ["_cells"], fill, "_filled array<double>").select(F.col("_filled").alias("_cells"))

    # complete rows never leave the JVM
    whole = df.where(known)
    filled = map_rows(rows.where(~known), df.columns, ["_cells"], fill, "_filled array<double>")
    return whole.select([F.col(f"`{c}`").cast("double").alias(c) if c in features else F.col(f"`{c}`") for c in df.columns]).unionByName(
        filled.select([
            F.get("_filled", F.lit(features.index(c))).alias(c) if c in features else F.col(f"`{c}`") for c in df.columns
        ])
    )
