"""Column functions for scaling, sentinels and index arithmetic."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def logit(v: Column | str) -> Column:
    """``ln(v / (1 - v))``; null outside (0, 1)."""
    v = F.col(v) if isinstance(v, str) else v
    return F.when((v > 0) & (v < 1), F.ln(v / F.nullif(1 - v, F.lit(0.0))))


def inverse_logit(z: Column | str) -> Column:
    """``exp(z) / (1 + exp(z))`` without overflow for large ``z``."""
    z = F.col(z) if isinstance(z, str) else z
    return 1 / (1 + F.exp(-z))


def reciprocal(v: Column | str) -> Column:
    """``1 / v``, null at zero."""
    v = F.col(v) if isinstance(v, str) else v
    return F.try_divide(F.lit(1.0), v)


def sentinel_to_null(df: DataFrame, columns: Sequence[str], sentinel: float = 999) -> DataFrame:
    """Replace a marker value by null in the named columns only."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit(sentinel)) for c in columns})


def null_to_sentinel(df: DataFrame, columns: Sequence[str], sentinel: float = 999) -> DataFrame:
    """Replace null by a marker value in the named columns."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(sentinel)) for c in columns})


def missing_pattern(columns: Sequence[str]) -> Column:
    """Text of 0 and 1 per row; 1 marks a missing column."""
    return F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns])


def round_half_even(v: Column | str) -> Column:
    """Round to the nearest integer, halves to even."""
    return F.rint(v)


def linear_space(start: float, stop: float, num: int) -> Column:
    """Array of ``num`` evenly spaced values, both ends included."""
    step = (stop - start) / max(num - 1, 1)
    return F.transform(F.sequence(F.lit(0), F.lit(num - 1)), lambda i: F.lit(start) + i * F.lit(step))


def powers_of_two(first: int, last: int, step: int = 1) -> Column:
    """Array of ``2 ** e`` for the exponents ``first, first + step, ... <= last``."""
    return F.transform(
        F.sequence(F.lit(first), F.lit(last), F.lit(step)), lambda e: F.pow(F.lit(2.0), e)
    )


def index_range(start: Column, end: Column) -> Column:
    """Integers of the half-open range ``[start, end)``; empty when ``end <= start``."""
    return F.when(end > start, F.sequence(start, F.greatest(end - 1, start))).otherwise(
        F.array().cast("array<bigint>")
    )


def pairs_of(values: Column, count: int) -> Column:
    """Array of (start, width) structs from a flat array of 2 * count numbers, rounded down."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(count - 1)),
        lambda i: F.struct(
            F.floor(F.get(values, 2 * i)).alias("start"), F.floor(F.get(values, 2 * i + 1)).alias("width")
        ),
    )


def first_true(flags: Column) -> Column:
    """0-based position of the first true element, null when there is none."""
    return F.nullif(F.array_position(flags, F.lit(True)) - 1, F.lit(-1))


def overwrite(values: Column, replacements: Mapping[int, Column | float]) -> Column:
    """Array with the elements at the given positions replaced."""
    def at(v: Column, i: Column) -> Column:
        out = v
        for position, new in replacements.items():
            out = F.when(i == position, new if isinstance(new, Column) else F.lit(new)).otherwise(out)
        return out

    return F.transform(values, at)


def row_mean(columns: Sequence[str]) -> Column:
    """Mean over columns of a row, nulls skipped."""
    cells = [F.col(f"`{c}`").cast("double") for c in columns]
    total = reduce(add, [F.coalesce(c, F.lit(0.0)) for c in cells])
    return F.try_divide(total, reduce(add, [c.isNotNull().cast("int") for c in cells]))


def spread(values: Column, names: Sequence[str]) -> list[Column]:
    """Elements of an array as named columns."""
    return [F.get(values, F.lit(i)).alias(n) for i, n in enumerate(names)]


def dot(values: Column, weights: Sequence[float]) -> Column:
    """Inner product of an array column with constant weights."""
    if len(weights) <= 256:  # plain arithmetic is compiled, array lambdas are interpreted
        return reduce(add, [F.get(values, F.lit(i)) * F.lit(float(w)) for i, w in enumerate(weights)])
    constants = F.array(*[F.lit(float(w)) for w in weights])
    return F.aggregate(F.zip_with(values, constants, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
