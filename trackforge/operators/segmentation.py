"""Runs of equal rows, and the classes of straight, transition and curve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackforge.core import Track
from trackforge.functions.numeric import INF, replace_inf
from trackforge.operators.kinematics import gradient_of, instant_radius, strictly_increasing
from trackforge.operators.smoothing import difference, rolling_mean, savgol


def run_id(df: DataFrame, t: Track, *columns: str, to: str = "segment_id", null_breaks: bool = False) -> DataFrame:
    """Number the runs of equal values, from 1. null_breaks: every null is a run of its own."""
    same = F.lit(True)
    for c in columns:
        one = F.col(c).eqNullSafe(F.lag(c).over(t.w))
        same = same & (one & F.col(c).isNotNull() if null_breaks else one)
    new = (~same | F.lag(F.lit(1)).over(t.w).isNull()).cast("long")
    return df.withColumn("_new", new).withColumn(to, F.sum("_new").over(t.upto)).drop("_new")


def per_run(t: Track, run: str) -> "F.WindowSpec":
    from pyspark.sql import Window

    return Window.partitionBy(t.track, run)


def segment(df: DataFrame, t: Track, curvature: str, distance: str = "cumulative_distance_m", *, straight: float = 1e-4, steady: float = 1e-6, tie_fix: bool = True) -> DataFrame:
    """curvature_smooth, dcurv, straight_mask, steady_mask, segment_type (straight, transition,
    steady_curve), instant_radius, segment_id and mean_radius (infinite on straights)."""
    k = F.col(curvature)
    k = F.when(F.abs(k) == INF, 1e9).when(k == 0, 1e-9).otherwise(k)
    d = savgol(df.withColumn("_k", k), t, "_k", 3, 1, to="curvature_smooth")
    d = strictly_increasing(d, t, distance, to="_s") if tie_fix else d.withColumn("_s", F.col(distance))
    d = d.withColumn("dcurv", gradient_of(t, F.col("curvature_smooth"), F.col("_s")))
    d = d.withColumns({"straight_mask": F.coalesce(F.abs("curvature_smooth") < straight, F.lit(False)), "steady_mask": F.coalesce(F.abs("dcurv") < steady, F.lit(False))})
    d = d.withColumn("segment_type", F.when(F.col("straight_mask"), "straight").when(F.col("steady_mask"), "steady_curve").otherwise("transition"))
    d = d.withColumn("instant_radius", instant_radius(F.col("curvature_smooth")))
    d = run_id(d, t, "segment_type")
    mean = F.when(F.col("segment_type") == "straight", INF).otherwise(F.avg("instant_radius").over(per_run(t, "segment_id")))
    return d.withColumn("mean_radius", mean).drop("_k", "_s")


#: Names of classes in logs of former versions.
TRANSITION, LINE, CURVE, UNDEFINED = "Übergangsbogen", "straight line", "curve", "undefined"


def segment_by_slope(df: DataFrame, t: Track, curvature: str, radius: str, *, slope: float = 0.005, straight: float = 0.001, shortest: int = 3) -> DataFrame:
    """segment_type (Übergangsbogen, straight line, curve; undefined for short runs) and mittelradius, the
    mean radius of a curve without infinities."""
    d = savgol(df, t, curvature, 5, 2, to="_k").withColumn("_slope", difference(t, "_k"))
    d = rolling_mean(rolling_mean(d, t, "_slope", 5, to="_slope5"), t, "_k", 5, to="_k5")
    kind = F.when(F.abs("_slope5") >= slope, TRANSITION).when(F.abs("_k5") < straight, LINE).otherwise(CURVE)
    d = run_id(d.withColumn("segment_type", kind), t, "segment_type", to="_run")
    w = per_run(t, "_run")
    d = d.withColumn("segment_type", F.when(F.count(F.lit(1)).over(w) < shortest, UNDEFINED).otherwise(F.col("segment_type")))
    mean = F.avg(F.when(F.col(radius) != INF, F.col(radius))).over(w)
    return d.withColumn("mittelradius", F.when(F.col("segment_type") == CURVE, mean)).drop("_k", "_slope", "_slope5", "_k5", "_run")


def segment_by_spread(df: DataFrame, t: Track, radius: str, *, straight_radius: float = 10_000.0, spread: float = 50.0) -> DataFrame:
    """segment_type (straight, curve, transition): runs of straight or bent rows by the smoothed
    radius; a bent run is a curve if its radii spread little. segment_radius: a curve's mean."""
    d = rolling_mean(df, t, radius, 5, to="_r")
    d = run_id(d.withColumn("is_straight", F.coalesce(F.abs("_r") > straight_radius, F.lit(True))), t, "is_straight")
    w = per_run(t, "segment_id")
    narrow = F.coalesce(F.stddev_samp(replace_inf(F.col(radius))).over(w) < spread, F.lit(False))
    kind = F.when(F.col("is_straight"), "straight").when(narrow, "curve").otherwise("transition")
    d = d.withColumn("segment_type", kind)
    return d.withColumn("segment_radius", F.when(F.col("segment_type") == "curve", F.avg(F.when(F.col(radius) != INF, F.col(radius))).over(w))).drop("_r")


def mean_without_inf(c: str) -> Column:
    """Mean of the values that aren't +infinity."""
    return F.avg(F.when(F.col(c) != INF, F.col(c)))


def middle_rows(df: DataFrame, t: Track, run: str) -> DataFrame:
    """The middle row of each run; of an even number, the later of the two."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(t.track, run).orderBy(t.seq))
    return df.withColumns({"_n": n, "_of": F.count(F.lit(1)).over(per_run(t, run))}).where(F.col("_n") == F.floor(F.col("_of") / 2) + 1).drop("_n", "_of")


def first_and_last(df: DataFrame, t: Track, run: str, *columns: str) -> DataFrame:
    """first_<c> and last_<c> of each run that has a number."""
    aggs = [f(c, t.seq).alias(f"{name}_{c}") for c in columns for f, name in ((F.min_by, "first"), (F.max_by, "last"))]
    return df.where(F.col(run).isNotNull()).groupBy(t.track, run).agg(*aggs)


def appearance_codes(df: DataFrame, t: Track, column: str, *, to: str = "code") -> DataFrame:
    """0, 1, 2 ... for a column's values in the order in which they first appear in their track."""
    from pyspark.sql import Window

    firsts = df.groupBy(t.track, column).agg(F.min(t.seq).alias("_at"))
    codes = firsts.withColumn(to, F.row_number().over(Window.partitionBy(t.track).orderBy("_at")) - 1).drop("_at")
    a = df.alias("a")
    return a.join(codes.alias("b"), (F.col(f"a.{t.track}") == F.col(f"b.{t.track}")) & F.col(f"a.{column}").eqNullSafe(F.col(f"b.{column}"))).select("a.*", to)


def without_repeats(df: DataFrame, t: Track, *columns: str) -> DataFrame:
    """Rows in which one of the columns differs from the row before."""
    same = F.lag(F.lit(1)).over(t.w).isNotNull()
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(t.w))
    return df.withColumn("_same", same).where(~F.col("_same")).drop("_same")


def line_segments(df: DataFrame, t: Track, *columns: str) -> DataFrame:
    """Each row with the next one's columns as next_<c>; the last row of a track goes."""
    d = df.withColumns({f"next_{c}": F.lead(c).over(t.w) for c in columns})
    return d.withColumn("_on", F.lead(F.lit(1)).over(t.w)).where("_on is not null").drop("_on")
