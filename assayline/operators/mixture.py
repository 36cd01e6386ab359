"""Gaussian mixtures fitted by expectation maximisation, many models per scan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.plans.scans import PackedRows, feature_array, is_complete, map_rows, means_of, pack_rows

COVARIANCE_TYPES = ("full", "tied", "diag", "spherical")
RIDGE = 1e-6  # added to every variance


@dataclass(frozen=True)
class Mixture:
    """Weights (k), means (k, d) and covariances (k, d, d) of the components."""

    covariance_type: str
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    log_likelihood: float = -np.inf
    rows: float = 0.0

    @property
    def components(self) -> int:
        return len(self.weights)

    @property
    def parameters(self) -> int:
        """Number of free parameters."""
        k, d = self.means.shape
        covariance = {
            "full": k * d * (d + 1) // 2, "tied": d * (d + 1) // 2, "diag": k * d, "spherical": k,
        }[self.covariance_type]
        return k * d + k - 1 + covariance

    @property
    def bic(self) -> float:
        return -2.0 * self.log_likelihood + self.parameters * np.log(self.rows)

    def log_joint(self, x: np.ndarray, columns: Sequence[int] | None = None) -> np.ndarray:
        """Log of weight times density per row and component, over some of the columns."""
        pick = np.arange(self.means.shape[1]) if columns is None else np.asarray(columns)
        out = np.empty((len(x), self.components))
        for j in range(self.components):
            root = np.linalg.cholesky(self.covariances[j][np.ix_(pick, pick)])
            z = (x - self.means[j, pick]) @ np.linalg.inv(root).T
            log_det = 2.0 * np.log(np.diag(root)).sum()
            out[:, j] = -0.5 * ((z * z).sum(axis=1) + log_det + len(pick) * np.log(2 * np.pi))
        with np.errstate(divide="ignore"):
            return out + np.log(self.weights)

    def table(self, spark: SparkSession) -> DataFrame:
        """Parameters in long form: (component, weight, i, j, mean, covariance)."""
        rows = [
            (c, float(self.weights[c]), i, j, float(self.means[c, i]), float(self.covariances[c, i, j]))
            for c in range(self.components) for i in range(self.means.shape[1]) for j in range(self.means.shape[1])
        ]
        return spark.createDataFrame(rows, "component int, weight double, i int, j int, mean double, covariance double")


def log_sum(values: np.ndarray) -> np.ndarray:
    """Logarithm of the row sums of exponentials."""
    top = values.max(axis=1, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(values - top).sum(axis=1)) + top[:, 0]


def _weighted_sums(x: np.ndarray, r: np.ndarray, about: np.ndarray) -> np.ndarray:
    """Per component: sum of r, of r * z, and of the full r * z z', z being x - about[component] (d is small).

    Sums about a point near the component keep the digits that a far component would lose about a common one.
    """
    first, second = [], []
    for j in range(r.shape[1]):
        z = x - about[j]
        weighted = z * r[:, [j]]
        first.append(weighted.sum(axis=0))
        second.append(weighted.T @ z)
    return np.concatenate([r.sum(axis=0), np.ravel(first), np.ravel(second)])


def _maximise(sums: np.ndarray, k: int, d: int, covariance_type: str, about: np.ndarray) -> Mixture:
    """New parameters from the weighted sums about the points ``about``."""
    counts = np.maximum(sums[:k], 10 * np.finfo(float).eps)
    moved = sums[k:k + k * d].reshape(k, d) / counts[:, None]
    means = about + moved
    second = sums[k + k * d:].reshape(k, d, d)
    spread = second / counts[:, None, None] - moved[:, :, None] * moved[:, None, :]
    if covariance_type == "tied":
        spread = np.repeat(np.tensordot(counts / counts.sum(), spread, axes=1)[None], k, axis=0)
    elif covariance_type == "diag":
        spread = np.stack([np.diag(np.diag(s)) for s in spread])
    elif covariance_type == "spherical":
        spread = np.stack([np.eye(d) * np.trace(s) / d for s in spread])
    return Mixture(covariance_type, counts / counts.sum(), means, spread + RIDGE * np.eye(d))


def _started(rows: PackedRows, source: DataFrame, specs: Sequence[tuple[int, str, int]], shift: np.ndarray) -> dict:
    """First parameters of each (components, type, start).

    Start ``s`` cuts the rows into equal parts along principal axis ``s``.
    The two halves along the first axis and so on are only places to begin.
    """
    d = len(shift)

    def whole(batch):
        x = batch["x"] - shift
        return {"all": np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])}

    flat = rows.totals(whole)["all"]
    n, mean = flat[0], flat[1:1 + d] / flat[0]
    spread = flat[1 + d:].reshape(d, d) / n - np.outer(mean, mean)
    axes = np.linalg.eigh(spread)[1][:, ::-1].T
    axes = axes * np.sign(axes[np.arange(d), np.abs(axes).argmax(axis=1)])[:, None]
    used = sorted({min(s, d - 1) for _, _, s in specs})
    scores = map_rows(
        source, [], ["x"], lambda b: {"score": (b["x"] - shift - mean) @ axes[used].T}, "score array<double>"
    )
    top = max(k for k, _, _ in specs)
    shares = sorted({round(i / k, 12) for k in range(1, top + 1) for i in range(1, k)}) or [0.5]
    found = scores.agg(*[
        F.percentile_approx(F.get("score", F.lit(i)), shares, 2000).alias(f"q{i}") for i in range(len(used))
    ]).first()
    cuts = {
        (k, a): [found[i][shares.index(round(j / k, 12))] for j in range(1, k)]
        for i, a in enumerate(used) for k in {k for k, _, _ in specs}
    }

    def parts(batch):
        x = batch["x"] - shift
        out = {}
        for (k, a), edges in cuts.items():
            part = np.searchsorted(np.array(edges), (x - mean) @ axes[a], side="left")
            out[f"{k}|{a}"] = _weighted_sums(x, np.eye(k)[part], np.zeros((k, d)))
        return out

    sums = rows.totals(parts)
    return {
        (k, kind, s): _maximise(sums[f"{k}|{min(s, d - 1)}"], k, d, kind, np.zeros((k, d))) for k, kind, s in specs
    }


def fit_mixtures(
    df: DataFrame,
    features: Sequence[str] | str,
    specs: Sequence[tuple[int, str]],
    starts: int = 2,
    rounds: int = 100,
    tolerance: float = 1e-3,
) -> dict[tuple[int, str], Mixture]:
    """Fit every (components, covariance type); the best of ``starts`` starts is kept.

    All unfinished models advance together: one scan per round.  A model whose covariance stops
    being positive definite has failed: its likelihood is minus infinity, and the others go on.  A model stops when
    its mean log-likelihood rises by less than ``tolerance``.
    """
    source = df.where(is_complete(features)).select(feature_array(features).alias("x"))
    rows = pack_rows(source)
    shift = means_of(source, "x")  # only against lost digits
    d = len(shift)
    full = [(k, kind, s) for k, kind in specs for s in range(starts if k > 1 else 1)]
    models: dict = _started(rows, source, full, shift)
    active, finished = dict(models), {}
    for _ in range(rounds):
        def expect(batch, current=active):
            x = batch["x"] - shift
            out = {}
            for (k, kind, s), model in current.items():
                try:
                    joint = model.log_joint(x)
                except np.linalg.LinAlgError:  # a covariance that is not positive definite: this model has failed
                    out[f"{k}|{kind}|{s}"] = np.full(2 + k + k * d + k * d * d, np.nan)
                    continue
                each = log_sum(joint)
                r = np.exp(joint - each[:, None])
                out[f"{k}|{kind}|{s}"] = np.concatenate([[each.sum(), len(x)], _weighted_sums(x, r, model.means)])
            return out

        sums = rows.totals(expect)
        following = {}
        for key, model in active.items():
            flat = sums["|".join(map(str, key))]
            likelihood, n = float(flat[0]), float(flat[1])
            if not np.isfinite(flat).all():
                finished[key] = replace(model, log_likelihood=-np.inf, rows=1.0)  # its criterion is infinite
                continue
            scored = replace(model, log_likelihood=likelihood, rows=n)
            if (likelihood - models[key].log_likelihood) / n < tolerance and np.isfinite(models[key].log_likelihood):
                finished[key] = scored
            else:
                models[key] = scored
                following[key] = _maximise(flat[2:], key[0], d, key[1], model.means)
        active = following
        if not active:
            break
    rows.unpersist()
    best: dict[tuple[int, str], Mixture] = {}
    for (k, kind, _), model in {**models, **finished}.items():
        shifted = replace(model, means=model.means + shift)
        if (k, kind) not in best or shifted.log_likelihood > best[(k, kind)].log_likelihood:
            best[(k, kind)] = shifted
    return best


def fit_mixture(
    df: DataFrame, features: Sequence[str] | str, components: int, covariance_type: str = "full", **options
) -> Mixture:
    """Fit one mixture; a :class:`FailedFit` where its covariance stops being positive definite."""
    model = fit_mixtures(df, features, [(components, covariance_type)], **options)[(components, covariance_type)]
    if not np.isfinite(model.log_likelihood):
        raise FailedFit(f"a covariance of the {covariance_type} mixture of {components} is not positive definite")
    return model


class FailedFit(ValueError):
    """A model that could not be fitted."""


def mixture_bic(
    df: DataFrame,
    features: Sequence[str] | str,
    max_components: int = 10,
    covariance_types: Sequence[str] = COVARIANCE_TYPES,
    **options,
) -> tuple[Mixture, DataFrame]:
    """Best model by the Bayesian information criterion, and the whole grid in long form."""
    specs = [(k, kind) for kind in covariance_types for k in range(1, max_components + 1)]
    models = fit_mixtures(df, features, specs, **options)
    order = sorted(specs, key=lambda s: (models[s].bic, specs.index(s)))
    rows = [(k, kind, float(models[(k, kind)].bic), (k, kind) == order[0]) for k, kind in specs]
    table = df.sparkSession.createDataFrame(
        rows, "components int, covariance_type string, bic double, is_best boolean"
    )
    return models[order[0]], table


def score_mixture(df: DataFrame, id_cols: Sequence[str], features: Sequence[str] | str, model: Mixture) -> DataFrame:
    """(ids, cluster_number, probabilities array, log_density) per row."""
    rows = df.select(*id_cols, feature_array(features).alias("_x"))

    def fn(batch):
        joint = model.log_joint(batch["_x"])
        each = log_sum(joint)
        return {
            "cluster_number": joint.argmax(axis=1), "probabilities": np.exp(joint - each[:, None]), "log_density": each
        }

    return map_rows(rows, id_cols, ["_x"], fn, "cluster_number int, probabilities array<double>, log_density double")


def mixture_probabilities(df: DataFrame, id_cols: Sequence[str], features: Sequence[str] | str, model: Mixture) -> DataFrame:
    """(ids, one probability column per component, named by its number)."""
    scored = score_mixture(df, id_cols, features, model)
    return scored.select(*id_cols, *[F.get("probabilities", F.lit(j)).alias(str(j)) for j in range(model.components)])


def mesh(spark: SparkSession, x: tuple[float, float, int], y: tuple[float, float, int]) -> DataFrame:
    """All points of a rectangular grid: (ix, iy, x1, x2), each axis (first, last, points)."""
    def place(index: str, axis: tuple[float, float, int]) -> F.Column:
        first, last, points = axis
        return F.lit(first) + F.col(index) * F.lit((last - first) / max(points - 1, 1))

    ids = spark.range(x[2] * y[2]).select(
        F.pmod("id", F.lit(x[2])).cast("int").alias("ix"), F.floor(F.col("id") / F.lit(x[2])).cast("int").alias("iy")
    )
    return ids.select("ix", "iy", place("ix", x).alias("x1"), place("iy", y).alias("x2"))


def density_grid(
    spark: SparkSession,
    model: Mixture,
    x: tuple[float, float, int] = (-4.0, 3.0, 50),
    y: tuple[float, float, int] = (-3.0, 3.0, 50),
) -> DataFrame:
    """Negative log density on a grid: (ix, iy, x1, x2, negative_log_density)."""
    points = mesh(spark, x, y)
    scored = score_mixture(points, ["ix", "iy", "x1", "x2"], ["x1", "x2"], model)
    return scored.select("ix", "iy", "x1", "x2", (-F.col("log_density")).alias("negative_log_density"))
