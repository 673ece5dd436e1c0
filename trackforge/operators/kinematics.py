"""Time, place, heading, turn rate, distance, gradient and curvature along tracks.

All are window expressions over one partitioning (track) and order (seq): a chain of them plans as
one exchange and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackforge.core import Track
from trackforge.functions.geo import bearing_deg, geodesic_m, haversine_m, to_mercator, to_utm, utm_zone
from trackforge.functions.numeric import compass, finite, ieee_div, wrap_deg

EPS = 1e-6
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]"


def seconds_between(a: Column, b: Column) -> Column:
    """Seconds from a to b, with microseconds."""
    return F.timestamp_diff("MICROSECOND", a, b) / 1e6


def parse_time(df: DataFrame, column: str, *, strict: bool = True, to: str | None = None) -> DataFrame:
    """The column as timestamp_ntz. strict: a bad value is an error; else it becomes null."""
    if dict(df.dtypes)[column] == "timestamp_ntz":
        return df.withColumn(to or column, F.col(column))
    parsed = F.to_timestamp_ntz if strict else lambda c, f: F.try_to_timestamp(c, f).cast("timestamp_ntz")
    return df.withColumn(to or column, parsed(F.col(column), F.lit(TIME_FORMAT)))


def elapsed_time(df: DataFrame, t: Track, ts: str = "ts", *, delta: bool = False) -> DataFrame:
    """elapsed_time_s since the track's first row; with delta, delta_time_s since the row before."""
    out = df.withColumn("elapsed_time_s", seconds_between(F.first(ts).over(t.upto), F.col(ts)))
    return out.withColumn("delta_time_s", seconds_between(F.lag(ts).over(t.w), F.col(ts))) if delta else out


def epoch_seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def smoothing_method(column: str) -> str:
    """The method in a coordinate column's name: what follows "smoothed_", or "raw"."""
    return column.partition("smoothed_")[2] or "raw"


def to_planar(df: DataFrame, t: Track, lat: str = "GPS_lat", lon: str = "GPS_lon", *, zone: int | None = None, labels: bool = True) -> DataFrame:
    """UTM x, y in the zone of the track's mean position (or a given one); with labels, the
    projection and smoothing method as columns."""
    z = F.lit(zone) if zone else utm_zone(F.avg(lon).over(t.whole))
    north = F.avg(lat).over(t.whole) >= 0
    out = df.withColumns({"_zone": z, "_north": north})
    x, y = to_utm(F.col(lon), F.col(lat), F.col("_zone"), F.col("_north"))
    out = out.withColumns({"x": x, "y": y})
    if labels:
        epsg = F.concat(F.lit("EPSG:"), (F.when(F.col("_north"), 32600).otherwise(32700) + F.col("_zone")).cast("string"))
        out = out.withColumns({"selected_smoothing_method": F.lit(smoothing_method(lat)), "projection_epsg": epsg})
    return out.drop("_zone", "_north")


def to_mercator_columns(df: DataFrame, lat: str, lon: str) -> DataFrame:
    x, y = to_mercator(F.col(lon), F.col(lat))
    return df.withColumns({"mx": x, "my": y})


def heading_dx_dy(df: DataFrame, t: Track, x: str = "x", y: str = "y", *, reach: int = 3, to: str = "heading_dx_dy_grad") -> DataFrame:
    """Direction from the mean of the ``reach`` rows before to that of the rows after; null where
    there are fewer."""
    mean = lambda c, a, b: F.avg(c).over(t.back(a, b))
    whole = F.lag(F.lit(1), reach).over(t.w).isNotNull() & F.lead(F.lit(1), reach).over(t.w).isNotNull()
    dx, dy = (mean(c, 1, reach) - mean(c, -reach, -1) for c in (x, y))
    return df.withColumn(to, F.when(whole, compass(dx, dy)))


def strictly_increasing(df: DataFrame, t: Track, s: str, *, eps: float = EPS, to: str | None = None) -> DataFrame:
    """s with every value at least eps above the one before it."""
    n = F.row_number().over(t.w) * eps
    return df.withColumn("_lifted", F.col(s) - n).withColumn(to or s, F.max("_lifted").over(t.upto) + n).drop("_lifted")


def gradient_of(t: Track, y: Column, x: Column) -> Column:
    """dy/dx at uneven spacing: second order inside, one-sided at a track's ends."""
    before, after = (lambda c: F.lag(c).over(t.w)), (lambda c: F.lead(c).over(t.w))
    hs, hd = x - before(x), after(x) - x
    inner = (hs * hs * after(y) + (hd * hd - hs * hs) * y - hd * hd * before(y)) / F.nullif(hs * hd * (hs + hd), F.lit(0.0))
    return F.when(hs.isNotNull() & hd.isNotNull(), inner).otherwise(F.coalesce(ieee_div(after(y) - y, hd), ieee_div(y - before(y), hs)))


def heading_ds(df: DataFrame, t: Track, x: str = "x", y: str = "y", s: str = "cumulative_distance_m", *, to: str = "heading_dx_ds_grad") -> DataFrame:
    """Direction of (dx/ds, dy/ds), with s made strictly increasing first."""
    d = strictly_increasing(df, t, s, to="_s")
    d = d.withColumns({"_dx": gradient_of(t, F.col(x), F.col("_s")), "_dy": gradient_of(t, F.col(y), F.col("_s"))})
    return d.withColumn(to, compass(F.col("_dx"), F.col("_dy"))).drop("_s", "_dx", "_dy")


def bearing_to_next(df: DataFrame, t: Track, lat: str, lon: str, *, to: str = "heading") -> DataFrame:
    """Great-circle bearing to the next row, in [0, 360); null for the last."""
    n = lambda c: F.lead(c).over(t.w)
    return df.withColumn(to, F.pmod(bearing_deg(F.col(lat), F.col(lon), n(lat), n(lon)), F.lit(360.0)))


def bearing_from_previous(df: DataFrame, t: Track, lat: str, lon: str, *, to: str = "heading") -> DataFrame:
    """Great-circle bearing from the row before, in [-180, 180]; null for the first."""
    p = lambda c: F.lag(c).over(t.w)
    return df.withColumn(to, bearing_deg(p(lat), p(lon), F.col(lat), F.col(lon)))


def yaw_rate(df: DataFrame, t: Track, headings: list[str], *, time: str = "elapsed_time_s", marker: str | None = "segment_marker", sign: float = 1.0, wrap: bool = True, keep_delta: bool = False) -> DataFrame:
    """yaw_rate_from_<heading> in degrees a second: the wrapped change of heading over the time
    step (a step of 0 counts as 1e-6 s). With a marker column, rates at stops are 0 and the row after
    each STOP_END goes."""
    step = F.col(time) - F.lag(time).over(t.w)
    out = df.withColumn("time_delta_s", F.when(step.isNull() | (step == 0), EPS).otherwise(step))
    for h in headings:
        change = F.col(h) - F.lag(h).over(t.w)
        rate = sign * (wrap_deg(change) if wrap else change) / F.col("time_delta_s")
        if marker in df.columns:
            rate = F.when(F.col(marker).isin("STOP_START", "STOP_END"), 0.0).otherwise(rate)
        out = out.withColumn(f"yaw_rate_from_{h}", rate)
    if marker in df.columns:
        out = drop_after_stop(out, t, marker)
    return out if keep_delta else out.drop("time_delta_s")


def drop_after_stop(df: DataFrame, t: Track, marker: str = "segment_marker") -> DataFrame:
    """Without the row after each STOP_END, unless it is a STOP_END too."""
    out = df.withColumn("_last", F.lag(marker).over(t.w))
    gone = (F.col("_last") == "STOP_END") & ((F.col(marker) != "STOP_END") | F.col(marker).isNull())
    return out.where(~F.coalesce(gone, F.lit(False))).drop("_last")


def traveled_distance(df: DataFrame, t: Track, lat: str = "GPS_lat", lon: str = "GPS_lon", *, exact: bool = True, keep_step: bool = False) -> DataFrame:
    """cumulative_distance_m: metres since the track's first row, along the WGS84 ellipsoid, or
    along great circles if not exact (then without Python)."""
    p = lambda c: F.lag(c).over(t.w)
    measure = geodesic_m if exact else haversine_m
    out = df.withColumns({"_lat": p(lat), "_lon": p(lon)})
    out = out.withColumn("distance", F.coalesce(measure(F.col("_lat"), F.col("_lon"), F.col(lat).cast("double"), F.col(lon).cast("double")), F.lit(0.0)))
    out = out.withColumn("cumulative_distance_m", F.sum("distance").over(t.upto)).drop("_lat", "_lon")
    return out if keep_step else out.drop("distance")


def grade(df: DataFrame, t: Track, elevation: str = "elevation", distance: str = "cumulative_distance_m") -> DataFrame:
    """gradient (rise over way, 0 without way and at the first row) and gradient_per_mille."""
    rise, way = (F.col(c) - F.lag(c).over(t.w) for c in (elevation, distance))
    first = F.lag(F.lit(1)).over(t.w).isNull()
    out = df.withColumn("gradient", F.when(first | (way == 0), 0.0).otherwise(rise / F.nullif(way, F.lit(0.0))))
    return out.withColumn("gradient_per_mille", F.col("gradient") * 1000)


def curvature_and_radius(df: DataFrame, t: Track, headings: list[str], distance: str = "cumulative_distance_m", *, straight_radius: float | None = None) -> DataFrame:
    """curvature_<heading> (1/m, signed) and radius_m_<heading>: no turn is curvature 0 and an infinite
    radius, a turn without way an infinite curvature and radius 0. A radius above straight_radius
    counts as straight."""
    ds = F.col(distance) - F.lag(distance).over(t.w)
    out = df.withColumn("_ds", ds)
    out = out.withColumn("_ds", F.coalesce("_ds", F.lead("_ds").over(t.w)))
    for h in headings:
        turn = F.coalesce(F.radians(wrap_deg(F.col(h) - F.lag(h).over(t.w))), F.lit(0.0))
        out = out.withColumn("_turn", turn)
        k = F.when(F.col("_turn") == 0, 0.0).otherwise(ieee_div(F.col("_turn"), F.col("_ds")))
        r = F.when(F.col("_turn") == 0, float("inf")).otherwise(F.col("_ds") / F.nullif("_turn", F.lit(0.0)))
        if straight_radius is not None:
            far = F.abs(r) > straight_radius
            k, r = F.when(far, 0.0).otherwise(k), F.when(far, float("inf")).otherwise(r)
        out = out.withColumns({f"radius_m_{h}": r, f"curvature_{h}": k})
    return out.drop("_ds", "_turn")


def curvature_from_rates(df: DataFrame, t: Track, yaw: str, speed: str, *, to: str = "curvature_yaw") -> DataFrame:
    """Turn rate over speed, in 1/m; null where that isn't finite, and for the last row."""
    k = finite(ieee_div(F.radians(F.col(yaw)), F.col(speed)))
    return df.withColumn(to, F.when(F.lead(F.lit(1)).over(t.w).isNotNull(), k))


def instant_radius(k: Column, least: float = 1e-12) -> Column:
    return F.when(F.abs(k) <= least, float("inf")).otherwise(1 / F.nullif(k, F.lit(0.0)))


def ml_features(df: DataFrame, t: Track, ts: str, lat: str, lon: str, speed: str) -> DataFrame:
    """Five columns for learning: time, place, speed, heading and its rate (not wrapped), of rows
    where all are known."""
    d = bearing_from_previous(df, t, lat, lon)
    step = seconds_between(F.lag(ts).over(t.w), F.col(ts))
    d = d.withColumn("yaw_rate", ieee_div(F.col("heading") - F.lag("heading").over(t.w), step))
    return d.select(t.track, t.seq, ts, speed, lat, lon, "heading", "yaw_rate").dropna()
