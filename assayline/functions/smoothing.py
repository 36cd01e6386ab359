"""Least-squares polynomial smoothing (Savitzky and Golay, 1964)."""

from __future__ import annotations

from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def window_weights(window: int, poly: int, deriv: int = 0) -> np.ndarray:
    """Row ``r``: weights that give the fitted polynomial (or derivative) at point ``r`` of a window.

    The middle row is the usual centred filter; the other rows serve the first
    and last points of a series, which have no full centred window.
    """
    if window % 2 == 0 or poly >= window:
        raise ValueError("window must be odd and longer than the polynomial degree")
    if deriv > poly:
        return np.zeros((window, window))
    at = np.arange(window, dtype=float) - window // 2
    fit = np.linalg.pinv(np.vander(at, poly + 1, increasing=True))  # degree x window
    powers = np.arange(poly + 1)
    scale = np.array([factorial(k) / factorial(k - deriv) if k >= deriv else 0.0 for k in powers])
    basis = at[:, None] ** np.clip(powers - deriv, 0, None)[None, :] * scale[None, :]
    return basis @ fit


def smooth_rows(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Smooth each row of a matrix at least as wide as the window."""
    window, width = len(weights), values.shape[1]
    half = window // 2
    out = np.zeros_like(values)
    middle = out[:, half:width - half]
    for j in range(window):  # one vectorised step per weight
        middle += values[:, j:j + width - window + 1] * weights[half, j]
    out[:, :half] = values[:, :window] @ weights[:half].T
    out[:, width - half:] = values[:, width - window:] @ weights[half + 1:].T
    return out


def savgol(spectrum: Column, window: int, poly: int, deriv: int = 0) -> Column:
    """Smooth an array column; ends are fitted on the first and last ``window`` points.

    Arrays shorter than the window give null, and so do points whose window holds a null.
    Whole Arrow batches are smoothed at once: nested array functions would be
    interpreted value by value.
    """
    weights = window_weights(window, poly, deriv)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def smooth(spectra: pa.Array) -> pa.Array:
        flat = spectra.flatten().to_numpy(zero_copy_only=False)
        sizes = np.diff(spectra.offsets.to_numpy())
        known = spectra.is_valid().to_numpy(zero_copy_only=False)
        sizes = np.where(known, sizes, 0)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        out = np.full(len(flat), np.nan)
        for size in np.unique(sizes[sizes >= window]):
            rows = np.flatnonzero(sizes == size)
            cells = starts[rows][:, None] + np.arange(size)
            out[cells] = smooth_rows(flat[cells], weights)
        short = pa.array(sizes < window)
        offsets = pa.array(np.append(starts[:-1], starts[-1]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(out, from_pandas=True), mask=short)

    return smooth(spectrum.cast("array<double>"))
