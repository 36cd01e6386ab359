"""Scoring a stream with statistics learnt beforehand on a table.

Both functions are stateless projections of each row, so they need no watermark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.operators.scale import Scaler


def scale_stream(stream: DataFrame, scaler: Scaler) -> DataFrame:
    """Standardise with a fitted scaler."""
    return scaler.autoscale(stream)


def flag_stream(stream: DataFrame, value: str, limits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``lower``, ``upper`` and ``is_outlier`` from a static table of limits per key.

    A stream-static join; Spark broadcasts the limits when they are small.  Every row stays: without limits for its
    key (null keys match null) the added columns are null.
    """
    bounds = limits.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "lower", "upper")
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    outside = (F.col(value) < F.col("lower")) | (F.col(value) > F.col("upper"))
    return stream.join(bounds, same, "left").drop(*[f"_k_{k}" for k in keys]).withColumn("is_outlier", outside)
