"""Joins that hold up when one key has a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.session import cut_lineage

BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
HEAVY_ROWS = 1_000_000
MAX_HEAVY_KEYS = 100_000


def _renamed(right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return right.select(
        *[F.col(f"`{k}`").alias(f"_k_{k}") for k in keys], *[F.col(f"`{c}`") for c in right.columns if c not in keys]
    )


def _joined(left: DataFrame, renamed: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    same = [left[k].eqNullSafe(renamed[f"_k_{k}"]) for k in keys]
    return left.join(renamed, same, how).drop(*[f"_k_{k}" for k in keys])


def split_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    heavy_rows: int = HEAVY_ROWS,
    max_heavy_keys: int = MAX_HEAVY_KEYS,
) -> DataFrame:
    """Equi-join in which ``left`` may have hot keys and ``right`` has one row per key; nulls match.

    Keys with more than ``heavy_rows`` rows (and more than a ``max_heavy_keys``-th of
    the table, so there are fewer than ``max_heavy_keys`` of them) get their rows of
    ``right`` by broadcast and are not shuffled; all other keys are joined by a shuffle.
    """
    counts = left.groupBy(*keys).agg(F.count("*").alias("_n"))
    total, largest = counts.agg(F.sum("_n"), F.max("_n")).first()
    bound = max(heavy_rows, -(-(total or 0) // max_heavy_keys))
    if (largest or 0) <= bound:
        return _joined(left, _renamed(right, keys), keys, how)
    heavy = cut_lineage(counts.where(F.col("_n") > bound).select(*keys, F.lit(True).alias("_heavy")))
    marked = _joined(left, F.broadcast(_renamed(heavy, keys)), keys, "left")
    hot, cold = marked.where("_heavy").drop("_heavy"), marked.where(F.col("_heavy").isNull()).drop("_heavy")
    hot_right = _joined(right, F.broadcast(_renamed(heavy, keys)), keys, "inner").drop("_heavy")
    return _joined(hot, F.broadcast(_renamed(hot_right, keys)), keys, how).unionByName(
        _joined(cold, _renamed(right, keys), keys, how)
    )


def join_stats(
    df: DataFrame,
    stats: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    broadcast_rows: int = BROADCAST_ROWS,
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """Join one-row-per-key ``stats`` to ``df``; null keys match each other.

    ``stats`` is written and measured first.  Up to ``broadcast_rows`` rows of ``BROADCAST_BYTES`` together
    it is broadcast, so ``df`` is not shuffled; beyond that see :func:`split_join`.
    """
    small = cut_lineage(stats)
    if fits(small, broadcast_rows):
        return _joined(df, F.broadcast(_renamed(small, keys)), keys, how)
    return split_join(df, small, keys, how, heavy_rows)


def fits(small: DataFrame, most_rows: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a written table may be broadcast; its width is measured on some of its rows."""
    some = small.limit(1000).toArrow()
    if some.num_rows < 1000:
        return some.num_rows <= most_rows and some.nbytes <= most_bytes
    n = small.limit(most_rows + 1).count()
    return n <= most_rows and n * some.nbytes / 1000 <= most_bytes
