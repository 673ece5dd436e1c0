"""The daily pipeline: an ordered list of steps, each a DataFrame -> DataFrame, in one lazy plan over
all tracks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackforge.core import Track
from trackforge.operators import filters, kinematics, segmentation, sequential


@dataclass(frozen=True)
class Config:
    """Which steps run, and on which columns. source: the smoothing whose places are used once they
    exist (rolling_windows after the compaction). skip_failing: a track that a kernel fails on is left out
    instead of failing the others."""

    track: Track = Track()
    ts: str = "ts"
    lat: str = "GPS_lat"
    lon: str = "GPS_lon"
    speed: str = "speed"
    elevation: str = "elevation"
    steps: tuple[str, ...] = ("time", "rolling_windows", "planar", "distance", "heading_dx_dy", "heading_ds", "yaw_rate", "radius", "segments")
    headings: tuple[str, ...] = ("heading_dx_dy_grad", "heading_dx_ds_grad")
    trim: tuple[str, float, float] = ("yaw_rate_from_heading_dx_ds_grad", 0.01, 0.99)
    exact_distance: bool = True
    skip_failing: bool = True
    more: dict = field(default_factory=dict)

    def place(self, df: DataFrame) -> tuple[str, str]:
        a = f"{self.lat}_smoothed_rolling_windows"
        return (a, f"{self.lon}_smoothed_rolling_windows") if a in df.columns else (self.lat, self.lon)


def _renumbered(df: DataFrame, c: Config) -> DataFrame:
    """seq afresh: compaction gives a piece's first and last row their own numbers, which may be equal."""
    w = c.track.whole.orderBy("elapsed_time_s", c.track.seq, F.col("segment_marker") == "STOP_END")
    return df.withColumn(c.track.seq, F.row_number().over(w))


#: The column in which steps say why they failed on a track ("step: error"); null where they didn't.
FAILED = "_failed"

#: The registry: name -> step. Others can be added under names of their own.
STEPS: dict[str, Callable[[DataFrame, Config], DataFrame]] = {
    "time": lambda d, c: kinematics.elapsed_time(d, c.track, c.ts),
    "rolling_windows": lambda d, c: _renumbered(sequential.stop_move(d, c.track, c.lat, c.lon, c.speed, "elapsed_time_s", errors=(FAILED, "rolling_windows") if c.skip_failing else None), c),
    "planar": lambda d, c: kinematics.to_planar(d, c.track, *c.place(d)),
    "distance": lambda d, c: kinematics.traveled_distance(d, c.track, *c.place(d), exact=c.exact_distance),
    "heading_dx_dy": lambda d, c: kinematics.heading_dx_dy(d, c.track),
    "heading_ds": lambda d, c: kinematics.heading_ds(d, c.track),
    "yaw_rate": lambda d, c: kinematics.yaw_rate(d, c.track, [h for h in c.headings if h in d.columns]),
    "trim": lambda d, c: filters.quantile_trim(d, *c.trim, track=c.track.track),
    "radius": lambda d, c: kinematics.curvature_and_radius(d, c.track, [h for h in c.headings if h in d.columns]),
    "segments": lambda d, c: segmentation.segment(d, c.track, f"curvature_{c.headings[-1]}"),
    "gradient": lambda d, c: kinematics.grade(d, c.track, c.elevation),
}

#: What a step adds to a result's name.
SUFFIXES = {
    "time": "time", "rolling_windows": "rollingW", "planar": "planar", "distance": "distance", "heading_dx_dy": "headingDX", "heading_ds": "headingDS",
    "yaw_rate": "yawRate", "trim": "delBoundaries", "radius": "radius", "segments": "übogen", "elevation": "elevation", "gradient": "gradient"}


def _steps(df: DataFrame, c: Config) -> DataFrame:
    d = (kinematics.parse_time(df, c.ts, strict=False) if dict(df.dtypes)[c.ts] == "string" else df).where(F.col(c.ts).isNotNull() & F.col(c.lat).isNotNull() & F.col(c.lon).isNotNull())
    for name in c.steps:
        d = STEPS[name](d, c)
    return d if FAILED in d.columns else d.withColumn(FAILED, F.lit(None).cast("string"))


def run(df: DataFrame, config: Config | None = None, **changes) -> DataFrame:
    """All steps of the config, and ``steps``, their names. Rows without a time (or with one that can't be
    read) or place are left out, and so are tracks that a kernel fails on, instead of failing the others;
    outcomes() names them."""
    c = replace(config or Config(), **changes)
    return _steps(df, c).where(F.col(FAILED).isNull()).drop(FAILED).withColumn("steps", F.array(*map(F.lit, c.steps)))


def outcomes(df: DataFrame, config: Config | None = None, **changes) -> DataFrame:
    """Each track of df: rows_in, rows_out, and the step that failed on it with its error (null if none did)."""
    c = replace(config or Config(), **changes)
    track = c.track.track
    given = df.groupBy(track).agg(F.count(F.lit(1)).alias("rows_in"))
    made = _steps(df, c).groupBy(F.col(track).alias("_track")).agg(F.count(F.when(F.col(FAILED).isNull(), 1)).alias("rows_out"), F.max(FAILED).alias("_why"))
    d = given.join(made, F.col(track).eqNullSafe(F.col("_track")), "left")
    return d.select(track, "rows_in", F.coalesce("rows_out", F.lit(0).cast("long")).alias("rows_out"), F.split_part("_why", F.lit(": "), F.lit(1)).alias("step"), F.regexp_replace("_why", "^[^:]*: ", "").alias("error"))


def save(df: DataFrame, folder: str, config: Config | None = None, **changes) -> None:
    """A folder of CSV files for each track of run()'s result, named by the track and the steps."""
    c = replace(config or Config(), **changes)
    name = F.concat_ws("_", F.col(c.track.track).cast("string"), *[F.lit(SUFFIXES.get(s, s)) for s in c.steps])
    flat = [F.col(f"`{x}`").cast("string").alias(x) if k.startswith(("array", "map", "struct")) else F.col(f"`{x}`") for x, k in df.dtypes]
    df.select(*flat, name.alias("file")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True).partitionBy("file").csv(folder)


def without_outliers(df: DataFrame, c: Config, row_id: str, *, most_speed: float, eps_m: float, least: int) -> DataFrame:
    """Rows that are neither jumps nor alone: the speed filter, then the noise filter by place."""
    d = filters.speed_outliers(df, c.track, c.ts, c.lat, c.lon, most_speed)
    from trackforge.operators.spatial import without_noise

    return without_noise(d, row_id, c.lat, c.lon, eps_m / 111_000.0, least)
