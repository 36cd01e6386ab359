"""Dummy variables and category codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.operators.scale import numeric_columns, string_columns
from assayline.plans.joins import join_stats
from assayline.plans.ordered import row_positions

MAX_LEVELS = 2_000


def levels_of(df: DataFrame, columns: Sequence[str], most: int = MAX_LEVELS) -> dict[str, list[str]]:
    """Sorted distinct values of each text column; an error when there are over ``most``, as each becomes a column."""
    pairs = (
        df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("level")) for c in columns
        ])).alias("p"))
        .select("p.*")
        .where(F.col("level").isNotNull())
        .distinct()
        .limit(most + 1)
        .collect()
    )
    if len(pairs) > most:
        raise ValueError(f"more than {most} levels in {list(columns)}; use dummies_long or category_codes")
    return {c: sorted(r["level"] for r in pairs if r["column"] == c) for c in columns}


def dummies_long(df: DataFrame, id_col: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The true cells of the dummy variables, one row each and without a bound on levels: (id, column, level)."""
    text = list(columns) if columns is not None else string_columns(df, [id_col])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("level")) for c in text])
    return df.select(id_col, F.explode(cells).alias("cell")).select(id_col, "cell.*").where(F.col("level").isNotNull())


def dummy_variables(
    df: DataFrame, id_col: str, columns: Sequence[str] | None = None, max_levels: int = MAX_LEVELS
) -> DataFrame:
    """Id, then the numeric columns, then one boolean ``{column}_{level}`` per level, levels sorted.

    A missing value is false in every column.
    """
    text = list(columns) if columns is not None else string_columns(df, [id_col])
    numeric = numeric_columns(df, [id_col])
    dummies = [
        F.coalesce(F.col(f"`{c}`") == F.lit(level), F.lit(False)).alias(f"{c}_{level}")
        for c, levels in levels_of(df, text, max_levels).items()
        for level in levels
    ]
    return df.select(id_col, *[F.col(f"`{c}`") for c in numeric], *dummies)


def category_codes(df: DataFrame, column: str, order: Sequence[str], out: str = "code") -> DataFrame:
    """Add integer codes numbered by first appearance along ``order``; null stays null.

    Any number of categories: they are numbered by a range-partitioned sort and joined back with hot ones split.
    """
    known = df.where(F.col(column).isNotNull())
    first_seen = known.groupBy(column).agg(F.min(F.struct(*[F.col(o) for o in order])).alias("_first"))
    numbered = row_positions(first_seen, ["_first", column], pos="_pos")
    return join_stats(df, numbered.select(column, F.col("_pos").cast("int").alias(out)), [column], "left")
