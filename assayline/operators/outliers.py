"""Limits outside which a value counts as an outlier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.operators.signal import smooth_series
from assayline.plans.joins import join_stats
from assayline.plans.quantiles import exact_median
from assayline.session import cut_lineage

# Fixed value: makes the median absolute deviation estimate a normal standard deviation.
NORMAL_MAD = 1.4826


def _attach(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    if keys:
        return join_stats(df, stats, keys, "left")
    row = stats.first()  # one row of statistics for the whole table
    return df.select("*", *[F.lit(row[c]).alias(c) for c in stats.columns])


def three_sigma_limits(df: DataFrame, value: str, keys: Sequence[str] = (), width: float = 3.0) -> DataFrame:
    """Mean -+ ``width`` population standard deviations per key: (keys, lower, upper)."""
    mean, std = F.avg(value), F.stddev_pop(value)
    return df.groupBy(*keys).agg((mean - width * std).alias("lower"), (mean + width * std).alias("upper"))


def hampel_limits(
    df: DataFrame, value: str, keys: Sequence[str] = (), width: float = 3.0
) -> DataFrame:
    """Median -+ ``width`` * 1.4826 * median absolute deviation per key: (keys, centre, mad, lower, upper)."""
    keys = list(keys)
    centre = exact_median(df, value, keys, "centre")
    placed = _attach(df, centre, keys)
    mad = exact_median(placed, F.abs(F.col(value) - F.col("centre")), keys, "mad")
    both = _attach(centre, mad, keys)
    reach = width * NORMAL_MAD * F.col("mad")
    return both.select(
        *keys, "centre", "mad", (F.col("centre") - reach).alias("lower"), (F.col("centre") + reach).alias("upper")
    )


def flag_outside(df: DataFrame, value: str, limits: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Add ``lower``, ``upper`` and the boolean ``is_outlier``."""
    bounds = limits.select(*keys, "lower", "upper")
    outside = (F.col(value) < F.col("lower")) | (F.col(value) > F.col("upper"))
    return _attach(df, bounds, keys).withColumn("is_outlier", outside)


def three_sigma(df: DataFrame, value: str, keys: Sequence[str] = (), width: float = 3.0) -> DataFrame:
    """Rows with their three-sigma limits and flag."""
    return flag_outside(df, value, three_sigma_limits(df, value, keys, width), keys)


def hampel(df: DataFrame, value: str, keys: Sequence[str] = (), width: float = 3.0) -> DataFrame:
    """Rows with their Hampel limits and flag."""
    return flag_outside(df, value, hampel_limits(df, value, keys, width), keys)


def savgol_hampel(
    df: DataFrame,
    order: Sequence[str],
    value: str,
    keys: Sequence[str] = (),
    window: int = 61,
    poly: int = 2,
    width: float = 3.0,
    **chunks: int,
) -> DataFrame:
    """Hampel rule on ``value - smoothed``; the limits follow the smoothed series."""
    smoothed = smooth_series(df, order, value, window, poly, 0, keys, out="smoothed", **chunks)
    rest = cut_lineage(smoothed.withColumn("_rest", F.col(value) - F.col("smoothed")))
    bounds = hampel_limits(rest, "_rest", keys, width).select(*keys, "lower", "upper")
    return (
        _attach(rest, bounds, keys)
        .withColumn("lower", F.col("smoothed") + F.col("lower"))
        .withColumn("upper", F.col("smoothed") + F.col("upper"))
        .withColumn("is_outlier", (F.col(value) < F.col("lower")) | (F.col(value) > F.col("upper")))
        .drop("_rest")
    )
