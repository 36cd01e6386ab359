"""Standardisation to zero mean and unit sample standard deviation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Names of the numeric columns in table order."""
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [c for c, t in df.dtypes if (t in kinds or t.startswith("decimal")) and c not in exclude]


def string_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Names of the text columns in table order."""
    return [c for c, t in df.dtypes if t == "string" and c not in exclude]


@dataclass(frozen=True)
class Scaler:
    """Means and standard deviations of features, reusable on other tables and on streams."""

    mean: dict[str, float | None]
    std: dict[str, float | None]

    def scaled(self, feature: str) -> Column:
        mean, std = self.mean[feature], self.std[feature]
        if mean is None or not std:  # no value, one value, or constant
            return F.lit(None).cast("double")
        return (F.col(f"`{feature}`") - F.lit(mean)) / F.lit(std)

    def unscaled(self, feature: str) -> Column:
        mean, std = self.mean[feature], self.std[feature]
        if mean is None or std is None:
            return F.lit(None).cast("double")
        return F.col(f"`{feature}`") * F.lit(std) + F.lit(mean)

    def autoscale(self, df: DataFrame) -> DataFrame:
        return df.select([self.scaled(c).alias(c) if c in self.mean else F.col(f"`{c}`") for c in df.columns])

    def unscale(self, df: DataFrame) -> DataFrame:
        return df.select([self.unscaled(c).alias(c) if c in self.mean else F.col(f"`{c}`") for c in df.columns])


def fit_scaler(df: DataFrame, features: Sequence[str]) -> Scaler:
    """Mean and sample standard deviation per feature, nulls skipped, in one aggregate."""
    row = df.agg(
        *[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(features)],
        *[F.stddev_samp(f"`{c}`").alias(f"s{i}") for i, c in enumerate(features)],
    ).first()
    return Scaler(
        {c: row[f"m{i}"] for i, c in enumerate(features)},
        {c: row[f"s{i}"] for i, c in enumerate(features)},
    )


def autoscale(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``(x - mean) / std`` per feature; a constant feature becomes null."""
    return fit_scaler(df, features).autoscale(df)


def describe_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Long table of the statistics per feature."""
    stats = {
        "n": lambda c: F.count(c).cast("double"),
        "total": lambda c: F.sum(c).cast("double"),
        "minimum": lambda c: F.min(c).cast("double"),
        "maximum": lambda c: F.max(c).cast("double"),
        "mean": F.avg,
        "std_samp": F.stddev_samp,
        "std_pop": F.stddev_pop,
        "var_pop": F.var_pop,
        "sum_of_squares": lambda c: F.sum(c * c).cast("double"),
    }
    wide = df.agg(*[f(F.col(f"`{c}`")).alias(f"{c}|{s}") for c in features for s, f in stats.items()])
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("feature"), *[F.col(f"`{c}|{s}`").alias(s) for s in stats])
                for c in features
            ]
        )
    )
    return wide.select(rows.alias("r")).select("r.*")
