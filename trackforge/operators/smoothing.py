"""Smoothing along tracks with built-in window expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackforge.core import Track


def rolling_mean(df: DataFrame, t: Track, column: str, size: int = 5, *, to: str | None = None) -> DataFrame:
    """Centred mean that shrinks at a track's ends."""
    return df.withColumn(to or f"{column}_smoothed", F.avg(column).over(t.back(-(size // 2), size - 1 - size // 2)))


def trailing_mean(df: DataFrame, t: Track, column: str, size: int, *, to: str | None = None) -> DataFrame:
    """Mean of the last ``size`` rows, this one included."""
    return df.withColumn(to or f"{column}_smoothed", F.avg(column).over(t.back(-(size - 1), 0)))


def difference(t: Track, c: str) -> Column:
    """Half the way from the row before to the row after; the whole one-sided way at the ends."""
    before, after = F.lag(c).over(t.w), F.lead(c).over(t.w)
    return F.coalesce((after - before) / 2, after - F.col(c), F.col(c) - before)


def savgol_taps(window: int, degree: int) -> np.ndarray:
    """window x window: row i gives the weights of a window's values for the fitted value at place i."""
    x = np.arange(window) - window // 2
    v = np.vander(x, degree + 1, increasing=True).astype(float)
    return v @ np.linalg.pinv(v)


def savgol_powers(window: int, degree: int) -> np.ndarray:
    """degree + 1 x window: row k gives the weights of a window's values for the factor of x to the k, with x from -1 to
    1 over the window."""
    x = (np.arange(window) - window // 2) / max(window // 2, 1)
    return np.linalg.pinv(np.vander(x, degree + 1, increasing=True))


def _at(frame: Column, taps: np.ndarray) -> Column:
    return F.aggregate(F.zip_with(frame, F.array(*[F.lit(float(w)) for w in taps]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def savgol(df: DataFrame, t: Track, column: str, window: int = 5, degree: int = 2, *, to: str | None = None) -> DataFrame:
    """Savitzky-Golay filter; at a track's ends, the polynomial of the first or last whole window.
    An even window counts as one more. Tracks shorter than a window, and windows with a null, give
    null."""
    window += 1 - window % 2
    half, powers = window // 2, savgol_powers(window, degree)
    d = df.withColumns({"_n": F.row_number().over(t.w), "_of": F.count(F.lit(1)).over(t.whole), "_v": F.collect_list(F.coalesce(F.col(column).cast("double"), F.lit(float("nan")))).over(t.back(-half, half))})
    # end rows evaluate the polynomial of the first or last whole window, a few numbers a track
    fitted = F.array(*[_at(F.col("_v"), p) for p in powers])
    d = d.withColumns({"_first": F.max(F.when(F.col("_n") == half + 1, fitted)).over(t.whole), "_lasts": F.max(F.when(F.col("_n") == F.col("_of") - half, fitted)).over(t.whole)})

    def at(c: str, x: Column) -> Column:
        out = F.col(c)[degree]
        for k in range(degree - 1, -1, -1):
            out = out * (x / max(half, 1)) + F.col(c)[k]
        return out

    value = F.when(F.col("_n") <= half, at("_first", F.col("_n") - (half + 1))).when(F.col("_n") > F.col("_of") - half, at("_lasts", F.col("_n") - F.col("_of") + half)).otherwise(_at(F.col("_v"), powers[0]))
    value = F.when(F.col("_of") >= window, F.nanvl(value, F.lit(None).cast("double")))
    return d.withColumn(to or f"{column}_savgol", value).drop("_n", "_of", "_v", "_first", "_lasts")


def gaussian(df: DataFrame, t: Track, column: str, sigma: float = 2.0, *, truncate: float = 4.0, to: str | None = None) -> DataFrame:
    """Gaussian filter; a track is mirrored at its ends (d c b a | a b c d | d c b a)."""
    r = int(truncate * sigma + 0.5)
    taps = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    taps = [w / sum(taps) for w in taps]
    d = df.withColumns({"_n": F.row_number().over(t.w), "_of": F.count(F.lit(1)).over(t.whole), "_v": F.collect_list(F.coalesce(F.col(column).cast("double"), F.lit(float("nan")))).over(t.back(-2 * r, 2 * r))})
    low = F.greatest(F.lit(1), F.col("_n") - 2 * r)  # the row at the frame's start
    value = F.lit(0.0)
    for i, w in zip(range(-r, r + 1), taps, strict=True):
        at = F.pmod(F.col("_n") - 1 + i, 2 * F.col("_of"))
        at = F.when(at < F.col("_of"), at).otherwise(2 * F.col("_of") - 1 - at)  # 0-based place in the track
        value = value + w * F.get("_v", at + 1 - low)
    return d.withColumn(to or f"{column}_smoothed_gaussian", F.nanvl(value, F.lit(None).cast("double"))).drop("_n", "_of", "_v")


def interpolate(df: DataFrame, t: Track, column: str, *, to: str | None = None) -> DataFrame:
    """Nulls on the line between their neighbours by row; the nearest value beyond the ends."""
    n = F.row_number().over(t.w)
    d = df.withColumn("_n", n).withColumn("_k", F.when(F.col(column).isNotNull(), F.struct("_n", F.col(column).alias("v"))))
    a = F.last("_k", ignorenulls=True).over(t.upto)
    b = F.first("_k", ignorenulls=True).over(t.w.rowsBetween(0, 2**31 - 1))
    d = d.withColumns({"_a": a, "_b": b})
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col("_n") - F.col("_a._n")) / F.nullif(F.col("_b._n") - F.col("_a._n"), F.lit(0))
    return d.withColumn(to or column, F.coalesce(F.col(column), line, "_a.v", "_b.v")).drop("_n", "_k", "_a", "_b")
