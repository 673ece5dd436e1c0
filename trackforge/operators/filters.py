"""Row filters and the choice of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackforge.core import Track
from trackforge.functions.numeric import finite, ieee_div, try_number
from trackforge.operators.kinematics import seconds_between
from trackforge.operators.profile import quantiles
from trackforge.functions.geo import haversine_m


def drop_na(df: DataFrame, *columns: str) -> DataFrame:
    """Rows without null in the columns (all columns if none are given)."""
    return df.dropna("any", subset=list(columns) or None)


def quantile_trim(df: DataFrame, column: str, low: float = 0.01, high: float = 0.99, *, track: str | None = None) -> DataFrame:
    """Rows whose value lies within the quantiles (interpolated, inclusive), of each track or of the
    whole table (then they are looked for at once). Rows with null go."""
    if track:
        bounds = F.percentile(column, F.array(F.lit(low), F.lit(high))).over(Window.partitionBy(track))  # a track is one task's
        d = df.withColumn("_q", bounds).where(F.col(column).between(F.col("_q")[0], F.col("_q")[1]))
        return d.select(*df.columns)
    lo, hi = quantiles(df, {column: [low, high]})[column]
    return df.where(F.lit(False) if lo is None else F.col(column).between(lo, hi))


def speed_outliers(df: DataFrame, t: Track, ts: str, lat: str, lon: str, most: float) -> DataFrame:
    """Rows reached from the row before at less than ``most`` metres a second; the first row stays."""
    p = lambda c: F.lag(c).over(t.w)
    d = df.withColumn("_v", ieee_div(haversine_m(p(lat), p(lon), F.col(lat), F.col(lon)), seconds_between(p(ts), F.col(ts))))
    return d.where(F.col("_v").isNull() | (F.col("_v") < most)).drop("_v")


def poor_quality(quality: Column, good: int = 4) -> Column:
    """Whether a GPS quality is known and not the good one."""
    n = try_number(quality)
    return n.isNotNull() & (n != good)


def finite_rows(df: DataFrame, *columns: str) -> DataFrame:
    keep = F.lit(True)
    for c in columns:
        keep = keep & finite(F.col(c)).isNotNull()
    return df.where(keep)


def moving(df: DataFrame, speed: str, more_than: float) -> DataFrame:
    return df.where(F.col(speed) > more_than)


def every_nth(df: DataFrame, t: Track, n: int) -> DataFrame:
    """The 1st, n+1st, 2n+1st ... row of each track."""
    return df.withColumn("_n", F.row_number().over(t.w) - 1).where(F.col("_n") % n == 0).drop("_n")


def radius_marks(df: DataFrame, radius: str = "mean_radius", kind: str = "segment_type", low: float = 400.0, high: float = 30_000.0) -> DataFrame:
    """Rows of steady curves whose radius, whichever way they turn, can be marked on a chart."""
    return df.where(F.abs(radius).between(low, high) & (F.col(kind) == "steady_curve"))


def tagged(df: DataFrame, key: str, *values: str, tags: str = "tags") -> DataFrame:
    """Ways that have the tag, with one of the values if any are given."""
    v = F.try_element_at(F.col(tags), F.lit(key))
    return df.where(v.isin(*values) if values else v.isNotNull())


# Columns are chosen from names while planning; no rows are read.


def position_pairs(columns: list[str]) -> list[tuple[str, str]]:
    """(lat, lon) column pairs, the raw one first, then smoothed ones by name."""
    have = set(columns)
    raw = [("GPS_lat", "GPS_lon")] if {"GPS_lat", "GPS_lon"} <= have else []
    smoothed = sorted(c for c in columns if c.startswith("GPS_lat_smoothed_") and c.replace("lat", "lon", 1) in have)
    return raw + [(c, c.replace("lat", "lon", 1)) for c in smoothed]


def choose_position(columns: list[str], source: str | None = None) -> tuple[str, str]:
    """The pair of a smoothing method ("raw" and "none" mean the unsmoothed one), or the first pair."""
    pairs = position_pairs(columns)
    if source in ("raw", "none"):
        source = "raw"
    for lat, lon in pairs:
        if source is None or (lat.partition("smoothed_")[2] or "raw") == source:
            return lat, lon
    raise KeyError(f"no position columns for {source or 'any source'} among {columns}")


def named_like(columns: list[str], *parts: str, without: str | None = None) -> list[str]:
    """Columns whose name holds one of the parts, upper or lower case."""
    low = lambda s: s.lower()
    return [c for c in columns if any(low(p) in low(c) for p in parts) and not (without and low(without) in low(c))]


def heading_columns(columns: list[str]) -> list[str]:
    return named_like(columns, "heading", without="yaw_rate")


def yaw_rate_columns(columns: list[str]) -> list[str]:
    return named_like(columns, "yaw_rate")


def curvature_columns(columns: list[str]) -> list[str]:
    return named_like(columns, "curvature")
