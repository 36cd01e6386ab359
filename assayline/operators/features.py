"""Removing and grouping features by dominant value and by correlation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayline.operators.scale import fit_scaler
from assayline.functions.scalar import row_mean
from assayline.plans.moments import Moments, correlation, fit_moments
from assayline.plans.scans import feature_names

# ---- dominant values ------------------------------------------------------------------------


def unpivot_features(df: DataFrame, id_cols: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Wide to long: (ids, feature, value)."""
    typed = df.select(*id_cols, *[F.col(f"`{c}`").cast("double").alias(c) for c in features])
    return typed.unpivot(list(id_cols), list(features), "feature", "value")


def value_counts(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """How often each value of each feature occurs, and its share: (feature, value, n, rate).

    Values are told apart in their own type, whatever it is.  ``value`` is a number if all features are, else a text.
    """
    numeric = all(isinstance(df.schema[c].dataType, T.NumericType) for c in features)
    counts = df.select(*[_as_text(df, c).alias(c) for c in features]).unpivot([], list(features), "feature", "value")
    counts = counts.groupBy("feature", "value").agg(F.count("*").alias("n"))
    rows = df.count()
    if numeric:
        counts = counts.withColumn("value", F.col("value").cast("double"))
    return counts.withColumn("rate", F.col("n") / F.lit(float(max(rows, 1))))


def _as_text(df: DataFrame, name: str) -> Column:
    """A value as a text that tells it apart; minus zero is zero."""
    column = F.col(f"`{name}`")
    fractional = isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))
    return (column + F.lit(0.0) if fractional else column).cast("string")


def dominant_rates(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Share of the most frequent value (null counts as a value) per feature: (feature, rate)."""
    return value_counts(df, features).groupBy("feature").agg(F.max("rate").alias("rate"))


def dominated_features(df: DataFrame, features: Sequence[str], threshold: float = 0.8) -> list[str]:
    """Features whose most frequent value has a share of at least ``threshold``.

    A value held by more than 60 % of the non-null rows is what a quantile
    sketch returns for the middle rank, so above that the only candidate is
    that value: two aggregates without a shuffle of values.  Lower thresholds, and
    features that are no numbers, count every value.
    """
    sketched = [c for c in features if threshold > 0.65 and isinstance(df.schema[c].dataType, T.NumericType)]
    counted_whole = [c for c in features if c not in sketched]
    rates = {r["feature"]: r["rate"] for r in dominant_rates(df, counted_whole).collect()} if counted_whole else {}
    dominated = {c for c, rate in rates.items() if rate >= threshold}
    dominated.update(_sketched_dominated(df, sketched, threshold) if sketched else ())
    return [c for c in features if c in dominated]


def _sketched_dominated(df: DataFrame, features: Sequence[str], threshold: float) -> list[str]:
    numeric = [F.col(f"`{c}`") for c in features]
    middle = df.agg(*[F.percentile_approx(c, 0.5, 1000).alias(str(i)) for i, c in enumerate(numeric)]).first()
    counted = df.agg(
        F.count("*").alias("n"),
        *[F.count_if(c == F.lit(middle[i])).alias(f"v{i}") for i, c in enumerate(numeric)],
        *[F.count_if(c.isNull()).alias(f"z{i}") for i, c in enumerate(numeric)],
    ).first()
    n = max(counted["n"], 1)
    return [
        c for i, c in enumerate(features)
        if max(counted[f"v{i}"] or 0, counted[f"z{i}"] or 0) / n >= threshold
    ]


def drop_dominant(df: DataFrame, features: Sequence[str], threshold: float = 0.8) -> DataFrame:
    """Remove the features dominated by one value."""
    return df.drop(*dominated_features(df, features, threshold))


# ---- correlation ----------------------------------------------------------------------------


def correlation_matrix(df: DataFrame, features: Sequence[str] | str) -> tuple[list[str], np.ndarray]:
    """Pearson correlations over complete rows, from one scan; p x p on the driver."""
    moments: Moments = fit_moments(df.withColumn("_zero", F.lit(0.0)), features, "_zero")
    return list(moments.features), correlation(moments.total[:-1, :-1])


def correlation_pairs(df: DataFrame, features: Sequence[str] | str) -> DataFrame:
    """Absolute correlations in long form: (feature_a, feature_b, abs_r), diagonal included."""
    names, r = correlation_matrix(df, features)
    rows = [(a, b, float(abs(r[i, j]))) for i, a in enumerate(names) for j, b in enumerate(names)]
    return df.sparkSession.createDataFrame(rows, "feature_a string, feature_b string, abs_r double")


def pairs_to_drop(
    names: Sequence[str], r: np.ndarray, threshold: float = 0.95, sum_scope: str = "current"
) -> list[str]:
    """Features deleted, in order, until no pair reaches ``threshold``.

    Of the most correlated pair the one with the larger sum of absolute
    correlations goes (the earlier one on a tie).  ``sum_scope="current"`` sums over
    the features still present, ``"all"`` over the full matrix.
    """
    if sum_scope not in ("current", "all"):
        raise ValueError("sum_scope must be 'current' or 'all'")
    full = np.abs(np.asarray(r, dtype=float))
    current = full.copy()
    np.fill_diagonal(current, 0.0)
    deleted: list[str] = []
    while current.size and current.max() >= threshold:
        first, second = np.unravel_index(int(current.argmax()), current.shape)
        sums = (current if sum_scope == "current" else full).sum(axis=0)
        gone = first if sums[first] >= sums[second] else second
        current[gone, :] = current[:, gone] = 0.0
        deleted.append(names[gone])
    return deleted


def drop_correlated(
    df: DataFrame, features: Sequence[str], threshold: float = 0.95, sum_scope: str = "current"
) -> DataFrame:
    """Remove features until no pair correlates at ``threshold`` or above."""
    names, r = correlation_matrix(df, features)
    return df.drop(*pairs_to_drop(names, r, threshold, sum_scope))


def similarity_matrix(df: DataFrame, kept: Sequence[str], dropped: Sequence[str]) -> DataFrame:
    """Absolute correlation of the kept features (rows, in order) with the dropped ones (columns)."""
    names, r = correlation_matrix(df, [*kept, *dropped])
    at = {n: i for i, n in enumerate(names)}
    rows = [
        (n, k, *[float(abs(r[at[k], at[d]])) for d in dropped]) for n, k in enumerate(kept)
    ]
    schema = "position int, feature string, " + ", ".join(f"`{d}` double" for d in dropped)
    return df.sparkSession.createDataFrame(rows, schema).orderBy("position").drop("position")


def complete_linkage(r: np.ndarray, threshold: float = 0.95) -> list[int]:
    """Cluster features so that within a cluster every absolute correlation exceeds ``threshold``.

    Merges the two clusters with the smallest largest distance ``1 / abs(r)``
    while that is below ``1 / threshold``.  Clusters are numbered by their
    smallest feature position.
    """
    with np.errstate(divide="ignore"):
        distance = 1.0 / np.abs(np.asarray(r, dtype=float))
    np.fill_diagonal(distance, np.inf)
    members = {i: [i] for i in range(len(distance))}
    while len(members) > 1:
        a, b = sorted(int(v) for v in np.unravel_index(int(distance.argmin()), distance.shape))
        if not distance[a, b] < 1.0 / threshold:
            break
        joined = np.maximum(distance[a], distance[b])
        distance[a, :] = distance[:, a] = joined
        distance[a, a] = np.inf
        distance[b, :] = distance[:, b] = np.inf
        members[a] += members.pop(b)
    numbers = [0] * len(distance)
    for number, first in enumerate(sorted(members)):
        for m in members[first]:
            numbers[m] = number
    return numbers


def cluster_features(df: DataFrame, features: Sequence[str] | str, threshold: float = 0.95) -> DataFrame:
    """Cluster number of each feature: (position, feature, cluster_number, is_selected)."""
    names, r = correlation_matrix(df, features)
    numbers = complete_linkage(r, threshold)
    rows = [(i, n, c, numbers.index(c) == i) for i, (n, c) in enumerate(zip(names, numbers))]
    return df.sparkSession.createDataFrame(
        rows, "position int, feature string, cluster_number int, is_selected boolean"
    )


def average_clusters(df: DataFrame, keep: Sequence[str], clusters: DataFrame) -> DataFrame:
    """One column per cluster: the feature itself, or the mean of its standardised members.

    ``clusters`` is the table of :func:`cluster_features` (one row per feature).
    """
    table = sorted(clusters.collect(), key=lambda row: row["position"])
    groups: dict[int, list[str]] = {}
    for row in table:
        groups.setdefault(row["cluster_number"], []).append(row["feature"])
    scaler = fit_scaler(df, [row["feature"] for row in table])
    scaled = df.select(*keep, *[
        scaler.scaled(c).alias(c) if len(g) > 1 else F.col(f"`{c}`") for g in groups.values() for c in g
    ])
    return scaled.select(*keep, *[
        F.col(f"`{g[0]}`") if len(g) == 1 else row_mean(g).alias(f"mean_in_cluster_{k}")
        for k, g in sorted(groups.items())
    ])


def spread_array(df: DataFrame, column: str, keep: Sequence[str]) -> DataFrame:
    """Array elements as columns ``{column}_{i}``."""
    names = feature_names(df, column)
    return df.select(*keep, *[F.get(column, F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)])
