"""Train and test rows chosen by the id, so the split survives repartitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BUCKETS = 10_007  # a prime
_STEP = 7_919


def split_share(id_column: Column | str, seed: int = 42) -> Column:
    """A number in [0, 1) that depends only on an integer id and the seed."""
    i = F.col(id_column) if isinstance(id_column, str) else id_column
    mixed = F.pmod(i, F.lit(1_000_003)) * F.lit(_STEP) + F.lit(seed * 104_729)
    squared = F.pmod(mixed, F.lit(_BUCKETS)) * F.pmod(mixed, F.lit(_BUCKETS)) + mixed
    return F.pmod(squared, F.lit(_BUCKETS)) / F.lit(_BUCKETS)


def with_split(df: DataFrame, id_col: str, train: float = 0.7, seed: int = 42) -> DataFrame:
    """Add the boolean ``is_train``."""
    key = F.col(id_col) if df.schema[id_col].dataType.simpleString() in ("int", "bigint") else F.xxhash64(id_col)
    return df.withColumn("is_train", split_share(key, seed) < F.lit(train))


def train_test_split(df: DataFrame, id_col: str, train: float = 0.7, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Two tables; every row is in exactly one of them."""
    both = with_split(df, id_col, train, seed)
    return both.where("is_train").drop("is_train"), both.where(~F.col("is_train")).drop("is_train")
