"""Smoothing and lagging of spectra and ordered series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayline.functions.smoothing import savgol
from assayline.plans.ordered import CHUNK_ROWS, row_positions, with_halo

SMOOTHED_CHUNK_ROWS = 8_192  # rows of a series gathered into one array


def smooth_spectra(
    df: DataFrame, spectrum: str, window: int = 21, poly: int = 2, deriv: int = 0, out: str | None = None
) -> DataFrame:
    """Savitzky-Golay over an array column; a projection, no shuffle."""
    return df.withColumn(out or spectrum, savgol(F.col(spectrum), window, poly, deriv))


def smooth_spectra_wide(
    df: DataFrame, columns: Sequence[str], window: int = 21, poly: int = 2, deriv: int = 0
) -> DataFrame:
    """The same over one column per wavelength; the columns keep their names."""
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in columns])
    smoothed = df.withColumn("_s", savgol(values, window, poly, deriv))
    return smoothed.select(
        [F.get("_s", F.lit(columns.index(c))).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns]
    )


def wavelength_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Names of spectral columns as numbers: (position, name, wavelength)."""
    names = df.sparkSession.createDataFrame(list(enumerate(columns)), "position int, name string")
    return names.withColumn("wavelength", F.col("name").try_cast("double"))


def smooth_series(
    df: DataFrame,
    order: Sequence[str],
    value: str,
    window: int = 61,
    poly: int = 2,
    deriv: int = 0,
    keys: Sequence[str] = (),
    out: str = "smoothed",
    chunk_rows: int = SMOOTHED_CHUNK_ROWS,
) -> DataFrame:
    """Savitzky-Golay along rows; series shorter than the window give null.

    Every series is cut into chunks that carry a halo of their neighbours' values.  A
    chunk becomes one bounded array of positions and values, so long series spread over many tasks and the
    same weights serve the interior and both ends; the other columns are joined back by position.
    """
    reach = window - 1
    placed = row_positions(df, order, keys, pos="_pos")
    chunked = with_halo(placed, "_pos", reach, reach, chunk_rows)
    point = F.struct("_pos", "_own", F.col(value).cast("double").alias("_v"))
    series = [F.col(k).alias(f"_k_{k}") for k in keys]
    chunks = chunked.groupBy(*series, "_chunk").agg(F.array_sort(F.collect_list(point)).alias("_c"))
    # a chunk either reaches the end of its series or holds reach rows beyond its own
    names = [f"_k_{k}" for k in keys]
    smoothed = chunks.select(*names, "_c", savgol(F.col("_c._v"), window, poly, deriv).alias("_s"))
    pairs = smoothed.select(*names, "_s", F.posexplode("_c").alias("_i", "_p")).where("_p._own")
    pairs = pairs.select(*names, F.col("_p._pos").alias("_at"), F.get("_s", F.col("_i")).alias(out))
    same = [placed[k].eqNullSafe(pairs[f"_k_{k}"]) for k in keys] + [placed["_pos"] == pairs["_at"]]
    return placed.join(pairs, same).drop("_pos", "_at", *names)


def lag_table(
    df: DataFrame,
    order: Sequence[str],
    target: str,
    features: Sequence[str],
    max_lag: int = 50,
    span: int = 1,
    keys: Sequence[str] = (),
    drop: str = "any",
    row: str = "row",
    keep: Sequence[str] = (),
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """The target at t beside each feature at t, t - span, ..., named ``{feature}_{i}``.

    ``i`` is the index of the lag, 0 .. max_lag // span.  ``row`` is the
    0-based row number in the series; the first ``max_lag`` rows are removed.
    ``drop="any"`` also removes rows with any null, ``"target"`` rows without a
    target, ``"none"`` nothing.
    """
    if drop not in ("any", "target", "none"):
        raise ValueError("drop must be 'any', 'target' or 'none'")
    placed = row_positions(df, order, keys, pos=row)
    chunked = with_halo(placed, row, max_lag, 0, chunk_rows)
    series = Window.partitionBy(*[F.col(k) for k in keys], "_chunk").orderBy(row)
    lagged = [
        (F.lag(f, i * span).over(series) if i else F.col(f)).alias(f"{f}_{i}")
        for f in features
        for i in range(max_lag // span + 1)
    ]
    shown = list(dict.fromkeys([*keys, *keep, row]))
    table = chunked.select(*shown, target, *lagged, "_own").where(F.col("_own") & (F.col(row) >= max_lag))
    table = table.drop("_own")
    if drop == "any":
        return table.dropna(subset=[target, *[f"{f}_{i}" for f in features for i in range(max_lag // span + 1)]])
    return table.dropna(subset=[target]) if drop == "target" else table
