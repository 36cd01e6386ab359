"""Choosing, ordering and reshaping rows of sample tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rows_at_minimum(df: DataFrame, score: str) -> DataFrame:
    """All rows whose score equals the smallest score of the table."""
    smallest = df.agg(F.min(score)).first()[0]
    return df.where(F.col(score) == F.lit(smallest))


def best_rows(df: DataFrame, score: str, keys: Sequence[str] = (), ties: Sequence[str] = (), largest: bool = False) -> DataFrame:
    """The row with the best score per key; ties go to the smallest ``ties``.

    An aggregate of one struct per key, so partial results are combined before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    sign = -F.col(score) if largest else F.col(score)
    order = F.struct(sign.alias("_s"), *[F.col(t).alias(f"_t{i}") for i, t in enumerate(ties)])
    best = F.min_by(F.struct(*rest), order).alias("_r")
    return df.where(F.col(score).isNotNull()).groupBy(*keys).agg(best).select(*keys, "_r.*")


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of every key along ``order``."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(*keys).agg(first).select(*keys, "_r.*").select(*df.columns)


def in_list_order(column: str, order: Sequence) -> Column:
    """0-based place of a value in an explicit order; null for other values."""
    place = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(column))
    return F.nullif(place - 1, F.lit(-1))


def keep_members(df: DataFrame, column: str, members: Sequence | DataFrame) -> DataFrame:
    """Rows whose value is in a list, or in the first column of a table."""
    if isinstance(members, DataFrame):
        return df.join(members.select(F.col(members.columns[0]).alias(column)).distinct(), column, "left_semi")
    return df.where(F.col(column).isin(list(members)))


def drop_members(df: DataFrame, column: str, members: Sequence | DataFrame) -> DataFrame:
    """Rows whose value is not in a list, or not in the first column of a table."""
    if isinstance(members, DataFrame):
        return df.join(members.select(F.col(members.columns[0]).alias(column)).distinct(), column, "left_anti")
    return df.where(~F.col(column).isin(list(members)))


def block_of(index: Column | str, ends: Sequence[int]) -> Column:
    """Number of the half-open block that holds an index; null outside all blocks.

    Block ``b`` runs from the previous end (0 for the first) up to ``ends[b]``.
    """
    i = F.col(index) if isinstance(index, str) else index
    passed = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= i))
    return F.when((i >= 0) & (i < ends[-1]), passed)


def explode_regions(df: DataFrame, start: Column, width: Column, limit: Column | int, out: str = "index") -> DataFrame:
    """One row per index of the region ``[start, min(start + width, limit))``; empty regions vanish."""
    stop = limit if isinstance(limit, Column) else F.lit(limit)
    end = F.least((start + width).cast("long"), stop.cast("long"))
    inside = F.when(end > start, F.sequence(start.cast("long"), F.greatest(end - 1, start.cast("long"))))
    return df.withColumn(out, F.explode(inside))


def transpose_by(df: DataFrame, id_col: str, features: Sequence[str], ids: Sequence) -> DataFrame:
    """Features as rows and the listed ids as columns, through the long form."""
    long = df.unpivot([id_col], list(features), "feature", "value")
    return long.groupBy("feature").pivot(id_col, list(ids)).agg(F.first("value"))
