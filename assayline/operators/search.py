"""Evolutionary search for features, spectral regions and lag regions.

The rows are read once, for the moment matrices per fold.  Every generation is
a Spark job over the population, which scores each new feature set from a
sub-matrix of the moments; variation of the short genomes happens on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.operators.pls import cross_validated_r2
from assayline.operators.rbf import RbfPoint, rbf_cv
from assayline.operators.signal import lag_table
from assayline.plans.moments import Moments, fit_moments
from assayline.plans.ordered import with_folds
from assayline.session import cut_lineage

# Score of an empty feature set; share of swapped and changed individuals; share of
# changed genes; tournament size; cut between chosen and not chosen; bounds of the exponents of two.
EMPTY_SCORE = -999.0
CROSSOVER = 0.5
MUTATION = 0.2
GENE_MUTATION = 0.05
TOURNAMENT = 3
CHOSEN = 0.5
EXPONENT_BOUNDS = ((-5.0, 10.0), (-10.0, 0.0), (-20.0, 10.0))  # C, epsilon, gamma

Decoder = Callable[[np.ndarray], tuple]


@dataclass(frozen=True)
class Genome:
    """Bounds of the genes; a switch gene flips when it mutates, a number is drawn again."""

    lower: np.ndarray
    upper: np.ndarray
    is_switch: np.ndarray

    @staticmethod
    def switches(count: int) -> Genome:
        return Genome(np.zeros(count), np.ones(count), np.ones(count, dtype=bool))

    @staticmethod
    def regions(count: int, positions: int, width: int) -> Genome:
        """``count`` pairs of a start in [0, positions] and a width in [0, width]."""
        return Genome(
            np.zeros(2 * count), np.tile([float(positions), float(width)], count), np.zeros(2 * count, dtype=bool)
        )

    def with_numbers(self, bounds: Sequence[tuple[float, float]]) -> Genome:
        low, high = zip(*bounds)
        return Genome(
            np.append(self.lower, low), np.append(self.upper, high),
            np.append(self.is_switch, np.zeros(len(bounds), dtype=bool)),
        )


@dataclass(frozen=True)
class SearchResult:
    """Chosen features of the last population's best individual, its score and genome, and the log."""

    features: tuple[str, ...]
    score: float
    genome: tuple[float, ...]
    best_ever: float
    generations: DataFrame

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, f) for i, f in enumerate(self.features)]
        return spark.createDataFrame(rows, "position int, feature string")

    def selected(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """The columns ``keep`` (ids, target) of the searched table and the selected features, each a column.

        Elements of an array column are named ``{column}_{position}``, as in the search.
        """
        def column(name: str):
            array, _, place = name.rpartition("_")
            return F.col(f"`{name}`") if name in df.columns else F.get(f"`{array}`", F.lit(int(place))).alias(name)

        return df.select(*[F.col(f"`{k}`") for k in keep], *[column(f) for f in self.features])


def chosen_positions(genome: np.ndarray) -> tuple[int, ...]:
    """Features whose gene exceeds one half."""
    return tuple(int(i) for i in np.flatnonzero(genome > CHOSEN))


def region_positions(genome: np.ndarray, width: int, edges: Sequence[int] = ()) -> tuple[int, ...]:
    """Union of the half-open regions (start, width) of a genome.

    A region ends at the end of the block of ``edges`` (sorted block ends) that holds
    its start, or at ``width`` when there are no blocks.
    """
    ends = np.array(sorted({*edges, width}))
    found: dict[int, None] = {}
    for start, length in np.floor(genome.reshape(-1, 2)).astype(int):
        if start >= width:
            continue
        end = min(start + length, int(ends[np.searchsorted(ends, start, side="right")]))
        found.update(dict.fromkeys(range(start, end)))
    return tuple(found)


def _offspring(population: np.ndarray, scores: np.ndarray, genome: Genome, rng: np.random.Generator) -> np.ndarray:
    """Tournament selection, two-point crossover of neighbours, mutation."""
    size, genes = population.shape
    rivals = rng.integers(size, size=(size, TOURNAMENT))
    winners = rivals[np.arange(size), scores[rivals].argmax(axis=1)]
    children = population[winners].copy()
    for i in range(0, size - 1, 2):
        if genes > 1 and rng.random() < CROSSOVER:
            a, b = np.sort(rng.choice(genes + 1, size=2, replace=False))
            children[[i, i + 1], a:b] = children[[i + 1, i], a:b]
    drawn = rng.uniform(genome.lower, genome.upper, size=children.shape)
    flipped = np.where(children > CHOSEN, 0.0, 1.0)
    changed = (rng.random(size) < MUTATION)[:, None] & (rng.random(children.shape) < GENE_MUTATION)
    return np.where(changed, np.where(genome.is_switch, flipped, drawn), children)


def evolve(
    spark: SparkSession,
    genome: Genome,
    decode: Decoder,
    score: Callable[[list[tuple]], list[float]],
    names: Callable[[tuple], Sequence[str]],
    population: int = 100,
    generations: int = 150,
    seed: int = 100,
) -> SearchResult:
    """Run the search; a decoded individual is scored once, however often it appears."""
    rng = np.random.default_rng(seed)
    people = rng.uniform(genome.lower, genome.upper, size=(population, len(genome.lower)))
    known: dict[tuple, float] = {}
    log = []
    for generation in range(generations + 1):
        if generation:
            people = _offspring(people, scores, genome, rng)
        keys = [decode(p) for p in people]
        fresh = [k for k in dict.fromkeys(keys) if k not in known]
        known.update(zip(fresh, score(fresh)) if fresh else ())
        scores = np.array([known[k] for k in keys])
        log += [(generation, i, float(s), k in fresh) for i, (s, k) in enumerate(zip(scores, keys))]
    best = int(scores.argmax())
    table = spark.createDataFrame(log, "generation int, individual int, fitness double, is_new boolean")
    return SearchResult(
        tuple(names(keys[best])), float(scores[best]), tuple(map(float, people[best])),
        max(known.values()), generation_log(table),
    )


def generation_log(population: DataFrame) -> DataFrame:
    """Fitness statistics per generation: (generation, evaluated, minimum, maximum, mean, std)."""
    return population.groupBy("generation").agg(
        F.count_if("is_new").alias("evaluated"),
        F.min("fitness").alias("minimum"),
        F.max("fitness").alias("maximum"),
        F.avg("fitness").alias("mean"),
        F.sqrt(F.abs(F.avg(F.col("fitness") * F.col("fitness")) - F.pow(F.avg("fitness"), F.lit(2)))).alias("std"),
    )


def pls_scorer(spark: SparkSession, moments: Moments, max_components: int = 10) -> Callable[[list[tuple]], list[float]]:
    """Best pooled r2 of each feature set; the sets are a DataFrame, the moments a broadcast."""
    shared = spark.sparkContext.broadcast(moments)

    def score_batch(frames):
        for frame in frames:
            values = []
            for positions in frame["positions"]:
                r2 = cross_validated_r2(shared.value.subset(list(positions)).folds, max_components)
                values.append(float(r2.max()) if len(r2) else EMPTY_SCORE)
            yield pd.DataFrame({"number": frame["number"], "fitness": values})

    def score(sets: list[tuple]) -> list[float]:
        out = {i: EMPTY_SCORE for i in range(len(sets))}
        rows = [(i, [int(p) for p in s]) for i, s in enumerate(sets) if len(s)]
        if rows:
            people = spark.createDataFrame(rows, "number int, positions array<int>")
            tasks = min(len(rows), spark.sparkContext.defaultParallelism)
            scored = people.repartition(tasks).mapInPandas(score_batch, "number int, fitness double")
            out.update({r["number"]: r["fitness"] for r in scored.collect()})
        return [out[i] for i in range(len(sets))]

    return score


def select_features_ga(
    df: DataFrame, features: Sequence[str] | str, target: str, fold: str, folds: int = 5,
    max_components: int = 10, **options,
) -> SearchResult:
    """Search for the feature set with the best cross-validated partial least squares."""
    moments = fit_moments(df, features, target, fold, folds)
    spark = df.sparkSession
    return evolve(
        spark, Genome.switches(len(moments.features)), chosen_positions, pls_scorer(spark, moments, max_components),
        lambda k: [moments.features[p] for p in k], **options,
    )


def select_regions_ga(
    df: DataFrame, features: Sequence[str] | str, target: str, fold: str, folds: int = 5, regions: int = 5,
    max_width: int = 20, max_components: int = 10, block_ends: Sequence[int] = (), **options,
) -> SearchResult:
    """Search for a few regions of neighbouring features, for example of a spectrum."""
    moments = fit_moments(df, features, target, fold, folds)
    spark, width = df.sparkSession, len(moments.features)
    return evolve(
        spark, Genome.regions(regions, width, max_width), lambda g: region_positions(g, width, block_ends),
        pls_scorer(spark, moments, max_components), lambda k: [moments.features[p] for p in k], **options,
    )


def lagged_rows(
    df: DataFrame, order: Sequence[str], target: str, features: Sequence[str], max_lag: int = 50, span: int = 1,
    folds: int = 5,
) -> tuple[DataFrame, list[str], list[int]]:
    """Lag table with contiguous folds, its feature names, and the ends of the variables' blocks."""
    table = lag_table(df, order, target, features, max_lag, span, row="_row")
    count = max_lag // span + 1
    names = [f"{f}_{i}" for f in features for i in range(count)]
    ends = list(accumulate(count for _ in features))
    return with_folds(table, ["_row"], folds, "_fold"), names, ends


def select_lags_ga(
    df: DataFrame, order: Sequence[str], target: str, features: Sequence[str], max_lag: int = 50, span: int = 1,
    folds: int = 5, regions: int = 5, max_width: int = 20, max_components: int = 10, **options,
) -> SearchResult:
    """Search for process variables and delays; a region stays within one variable."""
    table, names, ends = lagged_rows(df, order, target, features, max_lag, span, folds)
    return select_regions_ga(
        cut_lineage(table), names, target, "_fold", folds, regions, max_width, max_components, ends, **options
    )


# ---- the same searches for kernel regression, with its three exponents as further genes ---------


def _rbf_search(df, features, target, fold, folds, genome, positions_of, dimension, passes, options) -> SearchResult:
    names = list(features)
    base = fit_moments(df, names, target, fold, folds)

    def decode(g: np.ndarray) -> tuple:
        exponents = tuple(int(v) for v in np.rint(g[-3:]))
        return (positions_of(g[:-3]), exponents)

    def score(keys: list[tuple]) -> list[float]:
        usable = [k for k in keys if k[0]]
        points = [RbfPoint(p, 2.0 ** c, 2.0 ** e, 2.0 ** g) for p, (c, e, g) in usable]
        found = dict(zip(usable, rbf_cv(df, names, target, fold, folds, points, dimension, passes, base=base))) if usable else {}
        return [found.get(k, EMPTY_SCORE) for k in keys]

    return evolve(
        df.sparkSession, genome.with_numbers(EXPONENT_BOUNDS), decode, score, lambda k: [names[p] for p in k[0]],
        **options,
    )


def select_features_rbf_ga(
    df: DataFrame, features: Sequence[str], target: str, fold: str, folds: int = 5, dimension: int = 64,
    passes: int = 0, **options,
) -> SearchResult:
    """Feature search for kernel regression; the last three genes are the exponents of C, epsilon, gamma."""
    return _rbf_search(
        df, features, target, fold, folds, Genome.switches(len(features)), chosen_positions, dimension, passes, options
    )


def select_regions_rbf_ga(
    df: DataFrame, features: Sequence[str], target: str, fold: str, folds: int = 5, regions: int = 5,
    max_width: int = 20, dimension: int = 64, passes: int = 0, block_ends: Sequence[int] = (), **options,
) -> SearchResult:
    """Region search for kernel regression."""
    width = len(features)
    return _rbf_search(
        df, features, target, fold, folds, Genome.regions(regions, width, max_width),
        lambda g: region_positions(g, width, block_ends), dimension, passes, options,
    )


def select_lags_rbf_ga(
    df: DataFrame, order: Sequence[str], target: str, features: Sequence[str], max_lag: int = 50, span: int = 1,
    folds: int = 5, **options,
) -> SearchResult:
    """Lag search for kernel regression."""
    table, names, ends = lagged_rows(df, order, target, features, max_lag, span, folds)
    return select_regions_rbf_ga(cut_lineage(table), names, target, "_fold", folds, block_ends=ends, **options)
