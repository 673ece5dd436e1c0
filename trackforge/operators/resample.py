"""Time buckets and values at other places."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackforge.core import Track, with_seq
from trackforge.operators import kinematics, sequential, smoothing


def bucket_mean(df: DataFrame, track: str, ts: str, step: str, *columns: str) -> DataFrame:
    """Means of tumbling buckets of time; empty buckets aren't there. Works on streams, too."""
    g = df.groupBy(track, F.window(ts, step).alias("_w")).agg(*[F.avg(c).alias(c) for c in columns])
    return g.select(track, F.col("_w.start").alias(ts), *columns)


def asof_interpolate(known: DataFrame, asked: DataFrame, track: str, x: str, y: str, *, to: str | None = None) -> DataFrame:
    """asked (track, x, other columns) with y on the line between the known points around its x, and
    the end point's y beyond them. One union, one sort; no range join."""
    to = to or y
    rest = [c for c in asked.columns if c not in (track, x)]
    k = known.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(track, x).agg(F.avg(y).alias("_y")).select(track, x, "_y", F.lit(0).alias("_kind"), *[F.lit(None).cast(dict(asked.dtypes)[c]).alias(c) for c in rest])
    a = asked.select(track, x, F.lit(None).cast("double").alias("_y"), F.lit(1).alias("_kind"), *rest)
    p = F.when(F.col("_kind") == 0, F.struct(F.col(x).alias("x"), F.col("_y").alias("y")))
    w = Window.partitionBy(track).orderBy(x, "_kind")
    d = k.unionByName(a).withColumn("_p", p)
    d = d.withColumns({"_a": F.last("_p", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_b": F.first("_p", True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    exact = F.when(F.col("_a.x") == F.col(x), F.col("_a.y"))
    line = F.col("_a.y") + (F.col("_b.y") - F.col("_a.y")) * (F.col(x) - F.col("_a.x")) / F.nullif(F.col("_b.x") - F.col("_a.x"), F.lit(0.0))
    return d.withColumn(to, F.coalesce(exact, line, "_a.y", "_b.y")).where("_kind = 1").select(*asked.columns, to)


def smoothed_resampled(df: DataFrame, t: Track, ts: str, lat: str, lon: str, speed: str, step: str, **kalman) -> DataFrame:
    """track, seq, ts, elapsed_time_s, lat, lon, speed, is_moving and smoothed places of a log that is brought to
    even steps first: means of its buckets of time; what a bucket has no value of on the line between its
    neighbours; then the filter that knows stops from moves."""
    d = with_seq(bucket_mean(df, t.track, ts, step, lat, lon, speed), t.track, ts, to=t.seq)
    for c in (lat, lon, speed):
        d = smoothing.interpolate(d, t, c)
    d = kinematics.elapsed_time(d.where(F.col(lat).isNotNull() & F.col(lon).isNotNull() & F.col(speed).isNotNull()), t, ts)
    return sequential.kalman_track(d, t, lat, lon, speed, **kalman)
