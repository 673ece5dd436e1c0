"""Tables behind maps and charts. Drawing is the reader's; these are what is drawn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackforge.core import Track
from trackforge.functions.numeric import arrow, kmh, min_max_scale, symmetric_scale, try_number
from trackforge.operators import filters, profile, resample, segmentation

OUT_OF_RANGE = "#FFFF00"


def signals(df: DataFrame, t: Track, ts: str, *columns: str) -> DataFrame:
    """track, ts, signal, value: columns as rows, without nulls (a chart of several lines)."""
    return df.unpivot([t.track, ts], list(columns), "signal", "value").where(F.col("value").isNotNull())


def yaw_chart(df: DataFrame, t: Track, ts: str) -> tuple[DataFrame, DataFrame]:
    """(signals of all turn rates, lo and hi of their axis)."""
    names = [*filters.yaw_rate_columns(df.columns), *[c for c in ("Gier", "Gier_GPS") if c in df.columns]]
    return signals(df, t, ts, *names), profile.joint_range(df, *names)


def colour_track(df: DataFrame, t: Track, value: str, lat: str, lon: str, *, symmetric: bool = False) -> DataFrame:
    """Lines from row to row with a colour value from 0 to 1, by the left end."""
    d = segmentation.line_segments(df.dropna(subset=[lat, lon]), t, lat, lon)
    v = try_number(F.col(value))
    if symmetric:
        return d.withColumn("colour", symmetric_scale(v, F.max(F.abs(v)).over(t.whole)))
    return d.withColumn("colour", min_max_scale(v, F.min(v).over(t.whole), F.max(v).over(t.whole)))


def out_of_range(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """flag_colour for values outside [low, high]."""
    return df.withColumn("flag_colour", F.when((F.col(value) < low) | (F.col(value) > high), OUT_OF_RANGE))


def speed_layer(df: DataFrame, t: Track, speed: str, lat: str, lon: str) -> DataFrame:
    return colour_track(df.withColumn("speed_kmh", kmh(F.col(speed))), t, "speed_kmh", lat, lon)


def ends_layer(df: DataFrame, t: Track, lat: str, lon: str) -> DataFrame:
    """track, first and last place."""
    d = df.dropna(subset=[lat, lon])
    return d.groupBy(t.track).agg(*[f(c, t.seq).alias(f"{n}_{c}") for n, f in (("first", F.min_by), ("last", F.max_by)) for c in (lat, lon)])


def tunnel_layer(df: DataFrame, t: Track, tunnel: str, lat: str, lon: str) -> DataFrame:
    return segmentation.first_and_last(df, t, tunnel, lat, lon)


def blocked_layer(df: DataFrame, t: Track, blocked: str = "gps_blocked") -> DataFrame:
    """The middle row of each run of blocked rows."""
    return segmentation.middle_rows(segmentation.run_id(df, t, blocked, to="_run").where(F.col(blocked)), t, "_run").drop("_run")


def curvature_strip(df: DataFrame, t: Track, curvature: str, x: str = "x", y: str = "y") -> DataFrame:
    return segmentation.line_segments(df, t, x, y, curvature)


def radius_markers(df: DataFrame, t: Track, x: str = "x", y: str = "y", radius: str = "mean_radius") -> DataFrame:
    """Per run of one radius: its median place and radius, where it can be marked."""
    d = segmentation.run_id(df, t, radius, to="_run")
    d = filters.radius_marks(d, radius)
    return d.groupBy(t.track, "_run").agg(F.median(x).alias(x), F.median(y).alias(y), F.first(radius).alias(radius)).drop("_run")


def time_ticks(df: DataFrame, ticks: DataFrame, t: Track, distance: str = "cumulative_distance_m", time: str = "elapsed_time_s") -> DataFrame:
    """The time at each tick of the distance axis."""
    return resample.asof_interpolate(df, ticks, t.track, distance, time)


def elevation_chart(df: DataFrame, t: Track, distance: str, elevation: str, gradient: str) -> tuple[DataFrame, DataFrame]:
    """(signals of elevation and gradient over the distance, range of the gradient's axis)."""
    return signals(df, t, distance, elevation, gradient), profile.padded_range(df, gradient)


def quiver(df: DataFrame, t: Track, heading: str, x: str = "x", y: str = "y", every: int = 20) -> DataFrame:
    """Every n-th row with the arrow of its heading."""
    dx, dy = arrow(F.col(heading))
    return filters.every_nth(df, t, every).select(t.track, t.seq, x, y, dx.alias("dx"), dy.alias("dy"))


def has_radius(df: DataFrame, radius: str) -> DataFrame:
    return df.where(F.col(radius).isNotNull())
