"""Row positions and windows over long ordered series.

A window without a partition key, or with a key that holds a third of the
rows, runs in one task.  Here positions come from a range-partitioned sort,
and windows run over chunks of bounded length that carry a halo of their
neighbours' rows, so no task sees more than ``chunk_rows`` plus the halo.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayline.plans.joins import join_stats
from assayline.session import cut_lineage

CHUNK_ROWS = 100_000


def row_positions(
    df: DataFrame,
    order: Sequence[str],
    keys: Sequence[str] = (),
    pos: str = "pos",
    total: str | None = None,
) -> DataFrame:
    """Add the 0-based position of each row within its key, by ``order``.

    ``order`` must be unique within a key for the result to be deterministic.
    Rows are range partitioned and sorted on (keys, order), written once together with their partition number,
    and numbered from the partition sizes.
    """
    keys, order = list(keys), list(order)
    by = keys + order
    ordered = cut_lineage(
        df.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_local", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    )
    sizes = ordered.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()
    starts = [0, *accumulate(r["n"] for r in sizes)][:-1]
    spark = df.sparkSession
    start_table = spark.createDataFrame(
        [(r["_part"], s) for r, s in zip(sizes, starts)], "_part int, _start long"
    )
    placed = (
        ordered.join(F.broadcast(start_table), "_part")  # one row per partition
        .withColumn(pos, F.col("_local") + F.col("_start"))
        .drop("_part", "_local", "_start")
    )
    if keys:
        spans = placed.groupBy(*keys).agg(F.min(pos).alias("_first_pos"), F.count("*").alias("_group_rows"))
        placed = join_stats(placed, spans, keys).withColumn(pos, F.col(pos) - F.col("_first_pos"))
        if total:
            placed = placed.withColumn(total, F.col("_group_rows"))
        return placed.drop("_first_pos", "_group_rows")
    return placed.withColumn(total, F.lit(sum(r["n"] for r in sizes))) if total else placed


def with_halo(
    df: DataFrame, pos: str, before: int, after: int, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Cut positions into chunks and copy each chunk's neighbours into it.

    Adds ``_chunk`` and ``_own``; a window over (keys, _chunk) then finds
    ``before`` earlier and ``after`` later rows of every row with ``_own`` true.
    """
    size = max(chunk_rows, before, after, 1)
    home = F.floor(F.col(pos) / F.lit(size))
    inside = F.col(pos) - home * F.lit(size)
    targets = [home]
    if after:
        targets.append(F.when((inside < after) & (home > 0), home - 1))
    if before:
        targets.append(F.when(inside >= size - before, home + 1))
    return (
        df.withColumn("_home", home)
        .withColumn("_chunk", F.explode(F.array_compact(F.array(*targets))))
        .withColumn("_own", F.col("_chunk") == F.col("_home"))
        .drop("_home")
    )


def contiguous_fold(pos: Column, total: Column, folds: int) -> Column:
    """0-based fold of a row; folds are contiguous and the first ``total % folds`` are one longer."""
    small = F.floor(total / F.lit(folds))
    longer = total % F.lit(folds)
    head = longer * (small + 1)
    return (
        F.when(pos < head, F.floor(pos / (small + 1)))
        .otherwise(longer + F.floor((pos - head) / F.greatest(small, F.lit(1))))
        .cast("int")
    )


def with_folds(
    df: DataFrame, order: Sequence[str], folds: int, fold: str = "fold"
) -> DataFrame:
    """Contiguous k-fold assignment along ``order``."""
    placed = row_positions(df, order, pos="_pos", total="_total")
    return placed.withColumn(fold, contiguous_fold(F.col("_pos"), F.col("_total"), folds)).drop(
        "_pos", "_total"
    )


def shuffled_fold(ids: Sequence[Column | str], folds: int, seed: int) -> Column:
    """0-based fold from a hash of the id and a seed; needs no sort and survives repartitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), *ids), F.lit(folds)).cast("int")
