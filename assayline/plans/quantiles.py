"""Exact medians of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayline.plans.joins import join_stats
from assayline.session import cut_lineage


def exact_median(df: DataFrame, value: str | Column, keys: Sequence[str] = (), name: str = "median") -> DataFrame:
    """One row per key with the exact median of ``value`` (nulls skipped).

    Ranks are read where the values lie: counts per value are range partitioned by (keys, value), the totals of the partitions
    give each one's first rank, and only partitions that hold a middle rank are added up value by value, one task each.  A group may
    have any number of values.
    """
    keys = list(keys)
    value = F.col(value) if isinstance(value, str) else value
    base = df.select(*keys, value.cast("double").alias("_v")).where(F.col("_v").isNotNull())
    counts = base.groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
    placed = cut_lineage(counts.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()))
    totals = placed.groupBy(*keys, "_part").agg(F.sum("_c").alias("_t"))
    by_key = Window.partitionBy(*[F.col(k) for k in keys])  # of a key a row per partition at most
    before = by_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("*", F.sum("_t").over(by_key).alias("_n"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_start"))
    first_rank, second_rank = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    middle = starts.where((F.col("_start") < second_rank) & (first_rank <= F.col("_start") + F.col("_t"))).drop("_t")
    rows = join_stats(placed, middle, [*keys, "_part"])
    upto = Window.partitionBy(*[F.col(k) for k in keys], "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.withColumn("_upto", F.col("_start") + F.sum("_c").over(upto))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_upto") - F.col("_c") < rank) & (rank <= F.col("_upto")), F.col("_v")))

    found = ranked.groupBy(*keys).agg(at(first_rank).alias("_a"), at(second_rank).alias("_z"))
    return found.select(*keys, ((F.col("_a") + F.col("_z")) / 2).alias(name))
