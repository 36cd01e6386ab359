"""Generative topographic maps (Bishop, Svensen and Williams, 1998), plain and sparse, many per scan."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.operators.mixture import log_sum
from assayline.operators.neighbours import k3n_error, nearest_neighbours
from assayline.plans.scans import collect_sums, feature_array, is_complete, map_rows, pack_rows, sum_over_rows
from assayline.session import cut_lineage

JOBS_AT_ONCE = 4
FAILED_SCORE = 10e100  # score of a map that could not be fitted
PRUNE = 1e-8  # mixing coefficients below this become zero in a sparse map


@dataclass(frozen=True)
class MapSpec:
    """``nodes`` x ``nodes`` map points, ``centres`` x ``centres`` basis functions."""

    nodes: int = 30
    centres: int = 5
    variance: float = 4.0
    regulariser: float = 0.001
    sparse: bool = False


@dataclass(frozen=True)
class TopographicMap:
    """A fitted map: node means in feature space, noise precision and mixing coefficients."""

    spec: MapSpec
    means: np.ndarray
    precision: float
    mixing: np.ndarray
    log_likelihood: float = -np.inf
    success: bool = True

    @property
    def grid(self) -> np.ndarray:
        return square_grid(self.spec.nodes)

    def log_density(self, x: np.ndarray) -> np.ndarray:
        """Log density of each node at each row, without the mixing coefficient."""
        distance = (x * x).sum(axis=1)[:, None] - 2.0 * x @ self.means.T + (self.means**2).sum(axis=1)
        constant = 0.5 * x.shape[1] * np.log(self.precision / (2 * np.pi))
        return constant - 0.5 * self.precision * np.clip(distance, 0, None)

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return self.log_density(x) + np.log(self.mixing)


def square_grid(points: int) -> np.ndarray:
    """``points`` x ``points`` evenly spaced places on [-1, 1]^2, both ends included."""
    axis = np.linspace(-1.0, 1.0, points) if points > 1 else np.zeros(1)
    return np.array([(a, b) for b in axis for a in axis])


def _basis(spec: MapSpec) -> np.ndarray:
    """Radial basis functions at the nodes, and a constant."""
    nodes, centres = square_grid(spec.nodes), square_grid(spec.centres)
    distance = ((nodes[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)
    return np.column_stack([np.exp(-distance / (2.0 * spec.variance)), np.ones(len(nodes))])


def _first_map(spec: MapSpec, mean: np.ndarray, spread: np.ndarray) -> TopographicMap:
    """Nodes on the plane of the first two principal axes, noise from the third."""
    values, axes = np.linalg.eigh(spread)
    values, axes = np.clip(values[::-1], 0, None), axes[:, ::-1].T
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
    plane = np.sqrt(values[:2])[:, None] * axes[:2]
    grid = square_grid(spec.nodes)
    basis = _basis(spec)
    target = grid[:, : len(plane)] @ plane + mean
    means = basis @ np.linalg.lstsq(basis, target, rcond=None)[0]
    gap = ((means[0] - means[1]) ** 2).sum() / 4.0 if len(means) > 1 else 1.0
    noise = max(values[2] if len(values) > 2 else 0.0, gap, 1e-6)
    return TopographicMap(spec, means, 1.0 / noise, np.full(len(grid), 1.0 / len(grid)))


def _next_map(model: TopographicMap, sums: np.ndarray, n: float, squares: float) -> TopographicMap:
    nodes, d = model.means.shape
    counts, weighted = sums[1:1 + nodes], sums[1 + nodes:].reshape(nodes, d)
    basis = _basis(model.spec)
    try:
        left = basis.T @ (basis * counts[:, None])
        left = left + np.eye(len(left)) * (model.spec.regulariser / model.precision)
        means = basis @ np.linalg.solve(left, basis.T @ weighted)
        noise = (squares - 2.0 * (means * weighted).sum() + counts @ (means**2).sum(axis=1)) / (n * d)
    except np.linalg.LinAlgError:
        return replace(model, success=False)
    if not (np.isfinite(means).all() and np.isfinite(noise) and noise > 0):
        return replace(model, success=False)
    mixing = model.mixing
    if model.spec.sparse:
        mixing = counts / n
        mixing = np.where(mixing < PRUNE, 0.0, mixing)
        mixing = mixing / mixing.sum()
    return replace(model, means=means, precision=1.0 / noise, mixing=mixing)


def fit_maps(
    df: DataFrame,
    features: Sequence[str] | str,
    specs: Sequence[MapSpec],
    rounds: int = 300,
    tolerance: float = 1e-9,
) -> list[TopographicMap]:
    """Fit one map per spec on standardised features; unfinished maps share each scan."""
    rows = pack_rows(df.where(is_complete(features)).select(feature_array(features).alias("x")))

    def whole(batch):
        x = batch["x"]
        return {"all": np.concatenate([[len(x), (x * x).sum()], x.sum(axis=0), (x.T @ x).ravel()])}

    flat = rows.totals(whole)["all"]
    n, squares = flat[0], flat[1]
    d = int(round((-1 + np.sqrt(1 + 4 * (len(flat) - 2))) / 2))
    mean = flat[2:2 + d] / n
    spread = flat[2 + d:].reshape(d, d) / n - np.outer(mean, mean)
    models = [_first_map(s, mean, spread) for s in specs]
    active = list(range(len(specs)))
    for _ in range(rounds):
        def expect(batch, current={i: models[i] for i in active}):
            x, out = batch["x"], {}
            for i, model in current.items():
                joint = model.log_joint(x)
                each = log_sum(joint)
                r = np.exp(joint - each[:, None])
                out[str(i)] = np.concatenate([[each.sum()], r.sum(axis=0), (r.T @ x).ravel()])
            return out

        sums = rows.totals(expect)
        going = []
        for i in active:
            likelihood = float(sums[str(i)][0])
            rise = likelihood - models[i].log_likelihood
            models[i] = replace(models[i], log_likelihood=likelihood)
            if np.isfinite(rise) and rise / n < tolerance:
                continue
            models[i] = _next_map(models[i], sums[str(i)], n, squares)
            if models[i].success:
                going.append(i)
        active = going
        if not active:
            break
    rows.unpersist()
    return models


def fit_map(df: DataFrame, features: Sequence[str] | str, spec: MapSpec, **options) -> TopographicMap:
    return fit_maps(df, features, [spec], **options)[0]


def map_positions(df: DataFrame, id_cols: Sequence[str], features: Sequence[str] | str, model: TopographicMap) -> DataFrame:
    """(ids, t1_mean, t2_mean, t1_mode, t2_mode, log_density): responsibility-weighted and likeliest node."""
    grid = model.grid

    def fn(batch):
        joint = model.log_joint(batch["_x"])
        each = log_sum(joint)
        mean = np.exp(joint - each[:, None]) @ grid
        mode = grid[joint.argmax(axis=1)]
        return {
            "t1_mean": mean[:, 0], "t2_mean": mean[:, 1], "t1_mode": mode[:, 0], "t2_mode": mode[:, 1],
            "log_density": each,
        }

    rows = df.select(*id_cols, feature_array(features).alias("_x"))
    added = "t1_mean double, t2_mean double, t1_mode double, t2_mode double, log_density double"
    return map_rows(rows, id_cols, ["_x"], fn, added)


def responsibilities(df: DataFrame, id_cols: Sequence[str], features: Sequence[str] | str, model: TopographicMap) -> DataFrame:
    """(ids, responsibilities array): one share per node, summing to one."""
    def fn(batch):
        joint = model.log_joint(batch["_x"])
        return {"responsibilities": np.exp(joint - log_sum(joint)[:, None])}

    rows = df.select(*id_cols, feature_array(features).alias("_x"))
    return map_rows(rows, id_cols, ["_x"], fn, "responsibilities array<double>")


def map_grid(
    nodes: Sequence[int] = (30,),
    centres: Sequence[int] = tuple(range(2, 22, 2)),
    variances: Sequence[float] = tuple(2.0**e for e in range(-5, 4, 2)),
    regularisers: Sequence[float] = (0.0, *(2.0**e for e in range(-4, 0))),
    sparse: bool = False,
) -> list[MapSpec]:
    """Every combination of the hyperparameters."""
    return [MapSpec(k, q, v, r, sparse) for k in nodes for q in centres for v in variances for r in regularisers]


def map_grid_search(
    df: DataFrame,
    id_col: str,
    features: Sequence[str] | str,
    specs: Sequence[MapSpec],
    k: int = 10,
    rounds: int = 300,
    **options,
) -> tuple[TopographicMap, DataFrame]:
    """Score every map by the neighbour error of its means in both directions; the smallest wins.

    Returns the best map and (nodes, centres, variance, regulariser, sparse, k3n_error, is_best).
    """
    models = fit_maps(df, features, specs, rounds=rounds)
    base = df.select(id_col, feature_array(features).alias("a"))
    in_a = cut_lineage(nearest_neighbours(base, id_col, "a", k, **options))

    def score(model: TopographicMap) -> float:
        if not model.success:
            return FAILED_SCORE
        placed = map_positions(df, [id_col], features, model).select(id_col, F.array("t1_mean", "t2_mean").alias("b"))
        return k3n_error(base.join(placed, id_col), id_col, "a", "b", k, in_a, **options)

    with ThreadPoolExecutor(JOBS_AT_ONCE) as pool:  # independent Spark jobs fill the cluster together
        scores = list(pool.map(score, models))
    best = int(np.argmin(scores))
    rows = [
        (s.nodes, s.centres, float(s.variance), float(s.regulariser), s.sparse, float(v), i == best)
        for i, (s, v) in enumerate(zip(specs, scores))
    ]
    schema = (
        "nodes int, centres int, variance double, regulariser double, sparse boolean, "
        "k3n_error double, is_best boolean"
    )
    return models[best], df.sparkSession.createDataFrame(rows, schema)


def merge_steps(mixing: np.ndarray) -> list[np.ndarray]:
    """Mixing coefficients of every merging step: the smallest is dropped and shared out equally."""
    steps, current = [], np.asarray(mixing, dtype=float).copy()
    while True:
        steps.append(current.copy())
        used = np.flatnonzero(current > 0)
        if len(used) <= 1:
            return steps
        gone = used[int(current[used].argmin())]
        rest = used[used != gone]
        current[rest] += current[gone] / len(rest)
        current[gone] = 0.0


def merge_clusters(
    df: DataFrame, id_cols: Sequence[str], features: Sequence[str] | str, model: TopographicMap
) -> tuple[DataFrame, DataFrame]:
    """Merge the clusters of a sparse map by the Bayesian information criterion.

    Node densities do not change while coefficients are dropped, so the whole
    sequence is known beforehand: one scan scores every step, a second one labels
    the rows at the best step.  Returns (steps: clusters, bic, labels_used, is_best) and
    (ids, cluster_number).
    """
    steps = np.array(merge_steps(model.mixing))
    with np.errstate(divide="ignore"):
        log_steps = np.log(steps)
    rows = df.select(*id_cols, feature_array(features).alias("_x"))

    def statistic(batch):
        density = model.log_density(batch["_x"])
        out = {"n": np.array([len(density)], dtype=float)}
        for s, weights in enumerate(log_steps):
            joint = density + weights
            out[f"L{s}"] = np.array([log_sum(joint).sum()])
            out[f"U{s}"] = np.bincount(joint.argmax(axis=1), minlength=len(weights)).astype(float)
        return out

    sums = collect_sums(sum_over_rows(rows.select("_x"), statistic))
    n = float(sums["n"][0])
    counts = [int((w > 0).sum()) for w in steps]
    bic = [-2.0 * float(sums[f"L{s}"][0]) + c * np.log(n) for s, c in enumerate(counts)]
    best = int(np.argmin(bic))
    table = [
        (c, float(b), int((sums[f"U{s}"] > 0).sum()), s == best) for s, (c, b) in enumerate(zip(counts, bic))
    ]
    steps_table = df.sparkSession.createDataFrame(
        table, "clusters int, bic double, labels_used int, is_best boolean"
    )
    chosen = log_steps[best]
    labels = map_rows(
        rows, id_cols, ["_x"],
        lambda b: {"cluster_number": (model.log_density(b["_x"]) + chosen).argmax(axis=1)}, "cluster_number int",
    )
    return steps_table, labels
