"""Queries over the stand-in tables, one or more for every operator, with DuckDB oracles.

A user of ``events`` stands in for a vehicle: track_id = user_id, order (ts, event_id). Places, speeds
and headings are made from its columns, alike on both sides.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackforge.core import Track, with_seq
from trackforge.functions import geo, numeric
from trackforge.functions.orientation import line_angle_at, slope_weights
from trackforge.operators import filters, kinematics, profile, resample, segmentation, sequential, smoothing, spatial
from trackforge.plans import daily, infrastructure, products
from trackforge.sources import sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
T = Track()
KEY = ("track_id", "seq")


def query(sql: str | None = None) -> Callable:
    """Register a function under its name, with its SQL."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tracks(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """track_id, seq, event_id, ts, kind, v, lat, lon, and columns of events."""
    e = read(spark, sf_dir, "events")
    d = e.select(F.col("user_id").alias("track_id"), "event_id", "ts", F.col("event_type").alias("kind"), F.col("value").alias("v"), (51 + F.col("value") / 1000).alias("lat"), (11 + F.col("event_id") % 100 / 1000).alias("lon"), *more)
    return with_seq(d, "track_id", "ts", "event_id")


#: The same in SQL; every oracle begins with it.
EV = """WITH e AS (SELECT user_id AS track_id, event_id, ts, event_type AS kind, value AS v, 51 + value / 1000 AS lat, 11 + event_id % 100 / 1000 AS lon,
 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, props FROM events)"""
W = "(PARTITION BY track_id ORDER BY seq)"
#: Planar stand-in: metres that make steps of every size, zero among them.
PL = f"""{EV}, p AS (SELECT *, v * 10 AS x, (event_id % 100) * 7.0 AS y, round(sum(CASE WHEN event_id % 5 = 0 THEN 0 ELSE v END) OVER (PARTITION BY track_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 6) AS s,
 (event_id * 37 % 360)::DOUBLE AS h, epoch_us(ts) / 1e6 AS t FROM e)"""


def planar(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tracks(spark, sf_dir)
    s = F.round(F.sum(F.when(F.col("event_id") % 5 == 0, 0).otherwise(F.col("v"))).over(T.upto), 6)
    return d.withColumns({"x": F.col("v") * 10, "y": F.col("event_id") % 100 * 7.0, "s": s, "h": (F.col("event_id") * 37 % 360).cast("double"), "t": kinematics.epoch_seconds(F.col("ts"))})


def r(c: str | Column, n: int = 6, to: str | None = None) -> Column:
    return (F.round(c, n) + 0.0).alias(to or c)  # no negative zeros


#: Added before rounding to six or nine digits where means of a few numbers lie halfway between two digits.
CLEAR6, CLEAR9 = 3.1415926e-7, 3.1415926e-11
#: The same as a factor, for digits of numbers of any size.
CLEAR = 1 + 3.1415926e-12
WRAP = "(((({0}) + 180) % 360 + 360) % 360 - 180)"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run of one kind: its length, way, mean turn rate. One exchange, one sort, and the last sum."""
    d = kinematics.elapsed_time(tracks(spark, sf_dir), T)
    d = kinematics.to_planar(d, T, "lat", "lon", labels=False)
    d = kinematics.traveled_distance(d, T, "lat", "lon", exact=False)
    d = kinematics.yaw_rate(kinematics.heading_ds(d, T), T, ["heading_dx_ds_grad"])
    d = segmentation.run_id(d, T, "kind")
    return d.groupBy("track_id", "segment_id").agg(F.first("kind").alias("kind"), F.count(F.lit(1)).alias("rows"), (F.max("elapsed_time_s") - F.min("elapsed_time_s")).alias("seconds"), (F.max("cumulative_distance_m") - F.min("cumulative_distance_m")).alias("metres"), F.avg("yaw_rate_from_heading_dx_ds_grad").alias("mean_yaw_rate"))


# Time, place, heading, distance, curvature


@query(f"{EV} SELECT track_id, seq, round((epoch_us(ts) - epoch_us(first_value(ts) OVER {W})) / 1e6, 6) AS elapsed_time_s, round((epoch_us(ts) - epoch_us(lag(ts) OVER {W})) / 1e6, 6) AS delta_time_s FROM e")
def elapsed_time(spark, sf):
    return kinematics.elapsed_time(tracks(spark, sf), T, delta=True).select(*KEY, r("elapsed_time_s"), r("delta_time_s"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END AS parsed, round(CASE WHEN event_id % 7 = 0 THEN NULL ELSE epoch_us(ts) / 1e6 END, 6) AS epoch_s FROM events")
def parse_time(spark, sf):
    d = read(spark, sf, "events").withColumn("text", F.when(F.col("event_id") % 7 == 0, "no time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")))
    d = kinematics.parse_time(d, "text", strict=False, to="parsed")
    return d.select("event_id", "parsed", r(kinematics.epoch_seconds(F.col("parsed")), 6, "epoch_s"))


_SERIES = lambda f, g: " + ".join(f"{a!r} * {f}({2 * k} * xi) * {g}({2 * k} * eta)" for k, a in enumerate(geo.ALPHA, 1))
_UTM_X = f"500000 + {geo.UTM_SCALE * geo.RECTIFYING!r} * (eta + {_SERIES('cos', 'sinh')})"
_UTM_Y = f"{geo.UTM_SCALE * geo.RECTIFYING!r} * (xi + {_SERIES('sin', 'cosh')})"
_UTM = f"""{EV}, z AS (SELECT *, floor((avg(lon) OVER (PARTITION BY track_id) + 180) / 6) + 1 AS zone FROM e),
a AS (SELECT *, radians(lon - (zone * 6 - 183)) AS dl, sinh(atanh(sin(radians(lat))) - {geo.E2 ** 0.5!r} * atanh({geo.E2 ** 0.5!r} * sin(radians(lat)))) AS q FROM z),
b AS (SELECT *, atan2(q, cos(dl)) AS xi, asinh(sin(dl) / sqrt(q * q + cos(dl) * cos(dl))) AS eta FROM a)
SELECT track_id, seq, round({_UTM_X}, 3) AS x, round({_UTM_Y}, 3) AS y,
 'raw' AS selected_smoothing_method, 'EPSG:' || (32600 + zone::INT) AS projection_epsg FROM b"""


@query(_UTM)
def utm_project(spark, sf):
    d = kinematics.to_planar(tracks(spark, sf), T, "lat", "lon")
    return d.select(*KEY, r("x", 3), r("y", 3), "selected_smoothing_method", "projection_epsg")


@query(f"{EV} SELECT track_id, seq, round({geo.A} * radians(lon), 3) AS mx, round({geo.A} * ln(tan(pi() / 4 + radians(lat) / 2)), 3) AS my FROM e")
def mercator_project(spark, sf):
    return kinematics.to_mercator_columns(tracks(spark, sf), "lat", "lon").select(*KEY, r("mx", 3), r("my", 3))


@query(f"""{PL} SELECT track_id, seq, CASE WHEN lag(x, 3) OVER w IS NOT NULL AND lead(x, 3) OVER w IS NOT NULL THEN
 round(((degrees(atan2(avg(x) OVER a - avg(x) OVER b, avg(y) OVER a - avg(y) OVER b)) % 360) + 360) % 360, 6) END AS heading_dx_dy_grad FROM p
 WINDOW w AS {W}, a AS (PARTITION BY track_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), b AS (PARTITION BY track_id ORDER BY seq ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""")
def heading_3pt(spark, sf):
    return kinematics.heading_dx_dy(planar(spark, sf), T).select(*KEY, r("heading_dx_dy_grad"))


_S1 = f"""{PL}, q AS (SELECT *, max(s - seq * 1e-6) OVER (PARTITION BY track_id ORDER BY seq ROWS UNBOUNDED PRECEDING) + seq * 1e-6 AS s1 FROM p)"""


def _grad(y: str, x: str) -> str:
    b, a = f"({x} - lag({x}) OVER {W})", f"(lead({x}) OVER {W} - {x})"
    return f"""CASE WHEN lag({x}) OVER {W} IS NOT NULL AND lead({x}) OVER {W} IS NOT NULL THEN ({b} * {b} * lead({y}) OVER {W} + ({a} * {a} - {b} * {b}) * {y} - {a} * {a} * lag({y}) OVER {W}) / ({b} * {a} * ({b} + {a}))
 ELSE coalesce((lead({y}) OVER {W} - {y}) / {a}, ({y} - lag({y}) OVER {W}) / {b}) END"""


@query(f"{_S1} SELECT track_id, seq, round(s1, 6) AS s FROM q")
def strictly_increasing(spark, sf):
    return kinematics.strictly_increasing(planar(spark, sf), T, "s").select(*KEY, r("s"))


@query(f"{PL} SELECT track_id, seq, round({_grad('v', 't')}, 6) AS g FROM p")
def gradient_nonuniform(spark, sf):
    return planar(spark, sf).select(*KEY, r(kinematics.gradient_of(T, F.col("v"), F.col("t")), 6, "g"))


@query(f"{_S1}, g AS (SELECT track_id, seq, {_grad('x', 's1')} AS dx, {_grad('y', 's1')} AS dy FROM q) SELECT track_id, seq, round(((degrees(atan2(dx, dy)) % 360) + 360) % 360, 3) AS heading FROM g")
def heading_ds(spark, sf):
    return kinematics.heading_ds(planar(spark, sf), T, s="s", to="heading").select(*KEY, r("heading", 3))


_BEAR = "degrees(atan2(sin(radians({1} - {0})) * cos(radians({3})), cos(radians({2})) * sin(radians({3})) - sin(radians({2})) * cos(radians({3})) * cos(radians({1} - {0}))))"


@query(f"{EV} SELECT track_id, seq, round(((({_BEAR.format('lon', f'lead(lon) OVER {W}', 'lat', f'lead(lat) OVER {W}')}) % 360) + 360) % 360, 6) AS to_next, round({_BEAR.format(f'lag(lon) OVER {W}', 'lon', f'lag(lat) OVER {W}', 'lat')}, 6) AS from_previous FROM e")
def bearings(spark, sf):
    d = kinematics.bearing_to_next(tracks(spark, sf), T, "lat", "lon", to="to_next")
    return kinematics.bearing_from_previous(d, T, "lat", "lon", to="from_previous").select(*KEY, r("to_next"), r("from_previous"))


_YAW = f"(CASE WHEN coalesce(t - lag(t) OVER {W}, 0) = 0 THEN 1e-6 ELSE t - lag(t) OVER {W} END)"


@query(f"{PL} SELECT track_id, seq, round({WRAP.format(f'h - lag(h) OVER {W}')} / {_YAW}, 6) AS yaw_rate_from_h FROM p")
def wrapped_yaw_rate(spark, sf):
    return kinematics.yaw_rate(planar(spark, sf), T, ["h"], time="t").select(*KEY, r("yaw_rate_from_h"))


_MARK = "CASE event_id % 4 WHEN 0 THEN 'STOP_START' WHEN 1 THEN 'STOP_END' ELSE 'MOVING_2' END"


@query(f"""{PL}, m AS (SELECT *, {_MARK} AS segment_marker FROM p), y AS (SELECT track_id, seq, segment_marker, lag(segment_marker) OVER {W} AS last, CASE WHEN segment_marker LIKE 'STOP%' THEN 0 ELSE {WRAP.format(f'h - lag(h) OVER {W}')} / {_YAW} END AS z FROM m)
SELECT track_id, seq, segment_marker, round(z, 6) AS yaw_rate_from_h FROM y WHERE NOT coalesce(last = 'STOP_END' AND segment_marker <> 'STOP_END', false)""")
def yaw_rate_at_stops(spark, sf):
    k = F.col("event_id") % 4
    d = planar(spark, sf).withColumn("segment_marker", F.when(k == 0, "STOP_START").when(k == 1, "STOP_END").otherwise("MOVING_2"))
    return kinematics.yaw_rate(d, T, ["h"], time="t").select(*KEY, "segment_marker", r("yaw_rate_from_h"))


@query(f"{PL} SELECT track_id, seq, round(-1 * (h - lag(h) OVER {W}) / {_YAW}, 6) + 0.0 AS yaw_rate_from_h, round({_YAW}, 6) AS time_delta_s FROM p")
def unwrapped_yaw_rate(spark, sf):
    return kinematics.yaw_rate(planar(spark, sf), T, ["h"], time="t", sign=-1.0, wrap=False, keep_delta=True).select(*KEY, r("yaw_rate_from_h"), r("time_delta_s"))


_HAV = f"CASE WHEN lag(lat) OVER {W} IS NOT NULL THEN 2 * 6371000 * asin(least(sqrt(pow(sin(radians(lat - lag(lat) OVER {W}) / 2), 2) + cos(radians(lag(lat) OVER {W})) * cos(radians(lat)) * pow(sin(radians(lon - lag(lon) OVER {W}) / 2), 2)), 1)) END"


@query(f"{EV}, d AS (SELECT *, coalesce({_HAV}, 0) AS d FROM e) SELECT track_id, seq, round(d, 3) AS distance, round(sum(d) OVER (PARTITION BY track_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 2) AS cumulative_distance_m FROM d")
def cumulative_distance(spark, sf):
    return kinematics.traveled_distance(tracks(spark, sf), T, "lat", "lon", exact=False, keep_step=True).select(*KEY, r("distance", 3), r("cumulative_distance_m", 2))


def _vincenty_sql(rounds: int = 10) -> str:
    """The inverse geodesic with so many rounds of its fixed point, one query each."""
    f, b = geo.FLAT, geo.A * (1 - geo.FLAT)
    parts = [f"{EV}, l AS (SELECT *, lag(lat) OVER {W} AS la, radians(lon - lag(lon) OVER {W}) AS dl FROM e), u AS (SELECT *, atan({1 - f!r} * tan(radians(la))) AS u1, atan({1 - f!r} * tan(radians(lat))) AS u2, dl AS lam FROM l WHERE la IS NOT NULL), v0 AS (SELECT track_id, seq, dl, lam, sin(u1) AS s1, cos(u1) AS c1, sin(u2) AS s2, cos(u2) AS c2 FROM u)"]
    for k in range(1, rounds + 1):
        parts.append(f"""v{k} AS (SELECT track_id, seq, dl, s1, c1, s2, c2, ss, cs, sigma, cm, c2a, dl + (1 - c) * {f!r} * sa * (sigma + c * ss * (cm + c * cs * (2 * cm * cm - 1))) AS lam
 FROM (SELECT *, {f / 16!r} * c2a * (4 + {f!r} * (4 - 3 * c2a)) AS c FROM (SELECT *, CASE WHEN c2a = 0 THEN 0 ELSE cs - 2 * s1 * s2 / c2a END AS cm FROM (SELECT *, 1 - sa * sa AS c2a FROM
 (SELECT *, CASE WHEN ss = 0 THEN 0 ELSE c1 * c2 * sin(lam) / ss END AS sa, atan2(ss, cs) AS sigma FROM (SELECT *, sqrt(pow(c2 * sin(lam), 2) + pow(c1 * s2 - s1 * c2 * cos(lam), 2)) AS ss, s1 * s2 + c1 * c2 * cos(lam) AS cs FROM (SELECT track_id, seq, dl, lam, s1, c1, s2, c2 FROM v{k - 1})))))))""")
    parts.append(f"""d AS (SELECT track_id, seq, CASE WHEN ss = 0 THEN 0 ELSE {b!r} * big * (sigma - small * ss * (cm + small / 4 * (cs * (2 * cm * cm - 1) - small / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))) END AS d
 FROM (SELECT *, 1 + us / 16384 * (4096 + us * (-768 + us * (320 - 175 * us))) AS big, us / 1024 * (256 + us * (-128 + us * (74 - 47 * us))) AS small FROM (SELECT *, c2a * {(geo.A**2 - b * b) / (b * b)!r} AS us FROM v{rounds})))""")
    return ", ".join(parts) + " SELECT e.track_id, e.seq, round(coalesce(d, 0), 3) AS distance, round(sum(coalesce(d, 0)) OVER (PARTITION BY e.track_id ORDER BY e.seq ROWS UNBOUNDED PRECEDING), 2) AS cumulative_distance_m FROM e LEFT JOIN d ON e.track_id = d.track_id AND e.seq = d.seq"


@query(_vincenty_sql())
def geodesic_distance(spark, sf):
    return kinematics.traveled_distance(tracks(spark, sf), T, "lat", "lon", keep_step=True).select(*KEY, r("distance", 3), r("cumulative_distance_m", 2))


@query(f"{PL} SELECT track_id, seq, round(CASE WHEN lag(s) OVER {W} IS NULL OR s = lag(s) OVER {W} THEN 0 ELSE (v - lag(v) OVER {W}) / (s - lag(s) OVER {W}) END, 6) AS gradient, round(CASE WHEN lag(s) OVER {W} IS NULL OR s = lag(s) OVER {W} THEN 0 ELSE 1000 * (v - lag(v) OVER {W}) / (s - lag(s) OVER {W}) END, 3) AS gradient_per_mille FROM p")
def grade_per_mille(spark, sf):
    return kinematics.grade(planar(spark, sf), T, "v", "s").select(*KEY, r("gradient"), r("gradient_per_mille", 3))


_CURV = f"""{PL}, d AS (SELECT *, coalesce(radians({WRAP.format(f'h - lag(h) OVER {W}')}), 0) AS turn, coalesce(s - lag(s) OVER {W}, lead(s) OVER {W} - s) AS ds FROM p),
k AS (SELECT *, CASE WHEN turn = 0 THEN 0 WHEN ds = 0 THEN sign(turn) * 'Infinity'::DOUBLE ELSE turn / ds END AS curvature_h, CASE WHEN turn = 0 THEN 'Infinity'::DOUBLE ELSE ds / turn END AS radius_m_h FROM d)"""


def _text(c: str) -> Column:
    return F.when(numeric.is_inf(F.col(c)), F.when(F.col(c) > 0, "inf").otherwise("-inf")).otherwise(F.format_string("%.4f", F.round(c, 4) + 0.0)).alias(c)


def _sql_text(c: str) -> str:
    return f"CASE WHEN {c} = 'Infinity'::DOUBLE THEN 'inf' WHEN {c} = '-Infinity'::DOUBLE THEN '-inf' ELSE printf('%.4f', round({c}, 4) + 0.0) END AS {c}"


@query(f"{_CURV} SELECT track_id, seq, {_sql_text('curvature_h')}, {_sql_text('radius_m_h')} FROM k")
def curvature_radius(spark, sf):
    return kinematics.curvature_and_radius(planar(spark, sf), T, ["h"], "s").select(*KEY, _text("curvature_h"), _text("radius_m_h"))


@query(f"{_CURV}, c AS (SELECT track_id, seq, CASE WHEN abs(radius_m_h) > 60 THEN 0 ELSE curvature_h END AS curvature_h, CASE WHEN abs(radius_m_h) > 60 THEN 'Infinity'::DOUBLE ELSE radius_m_h END AS radius_m_h FROM k) SELECT track_id, seq, {_sql_text('curvature_h')}, {_sql_text('radius_m_h')} FROM c")
def curvature_straightened(spark, sf):
    return kinematics.curvature_and_radius(planar(spark, sf), T, ["h"], "s", straight_radius=60.0).select(*KEY, _text("curvature_h"), _text("radius_m_h"))


@query(f"{PL} SELECT track_id, seq, round(CASE WHEN lead(seq) OVER {W} IS NOT NULL AND event_id % 9 <> 0 AND v <> 0 THEN radians(h) / v END, 6) AS curvature_yaw FROM p")
def curvature_from_rates(spark, sf):
    d = planar(spark, sf).withColumn("v", F.when(F.col("event_id") % 9 == 0, 0.0).otherwise(F.col("v")))
    return kinematics.curvature_from_rates(d, T, "h", "v").select(*KEY, r("curvature_yaw"))


@query(f"{EV}, b AS (SELECT *, {_BEAR.format(f'lag(lon) OVER {W}', 'lon', f'lag(lat) OVER {W}', 'lat')} AS heading FROM e), y AS (SELECT *, (heading - lag(heading) OVER {W}) / ((epoch_us(ts) - epoch_us(lag(ts) OVER {W})) / 1e6) AS yaw_rate FROM b) SELECT track_id, seq, round(heading, 5) AS heading, round(yaw_rate, 6) AS yaw_rate FROM y WHERE yaw_rate IS NOT NULL")
def ml_features(spark, sf):
    return kinematics.ml_features(tracks(spark, sf), T, "ts", "lat", "lon", "v").select(*KEY, r("heading", 5), r("yaw_rate"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN s * (s - a) * (s - b) * (s - c) > 0 THEN a * b * c / (4 * sqrt(greatest(s * (s - a) * (s - b) * (s - c), 0))) ELSE 'Infinity'::DOUBLE END, 4) AS radius, round(CASE WHEN abs(l_tax) < 1e-12 THEN NULL ELSE 1 / l_tax END, 6) AS instant FROM (SELECT *, (a + b + c) / 2 AS s FROM (SELECT *, sqrt(pow(l_quantity, 2) + 100.0) AS a, sqrt(pow(l_quantity + 30, 2) + 400.0) AS b, sqrt(900 + 100.0) AS c FROM lineitem))")
def circumradius(spark, sf):
    q = F.col("l_quantity")
    d = read(spark, sf, "lineitem")
    k = numeric.vertices_radius(F.lit(-30.0), F.lit(-10.0), F.lit(0.0), F.lit(0.0), q, F.lit(10.0))
    return d.select("l_orderkey", "l_linenumber", r(k, 4, "radius"), r(numeric.finite(kinematics.instant_radius(F.col("l_tax"))), 6, "instant"))


@query("SELECT l_orderkey, l_linenumber, round(10 * cos(radians(90 - l_extendedprice % 360)), 6) + 0.0 AS dx, round(10 * sin(radians(90 - l_extendedprice % 360)), 6) + 0.0 AS dy, round(l_quantity * 3.6, 6) AS kmh, round(least(g % 180, 180 - g % 180), 6) AS gap, CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_linenumber::DOUBLE END AS n FROM (SELECT *, abs(l_extendedprice % 360 - l_quantity * 7) AS g FROM lineitem)")
def angles_and_numbers(spark, sf):
    d = read(spark, sf, "lineitem")
    h = F.col("l_extendedprice") % 360
    dx, dy = numeric.arrow(h)
    n = numeric.try_number(F.when(F.col("l_returnflag") == "A", "bad").otherwise(F.col("l_linenumber").cast("string")))
    return d.select("l_orderkey", "l_linenumber", r(dx, 6, "dx"), r(dy, 6, "dy"), r(numeric.kmh(F.col("l_quantity")), 6, "kmh"), r(numeric.undirected_gap(h, F.col("l_quantity") * 7), 6, "gap"), n.alias("n"))


# Filters


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey % 11 <> 0")
def drop_na(spark, sf):
    d = read(spark, sf, "orders").withColumn("o_custkey", F.expr("nullif(o_custkey, if(o_custkey % 11 = 0, o_custkey, null))"))
    return filters.drop_na(d, "o_custkey").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT event_id, value FROM events, (SELECT quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS b FROM events) WHERE value BETWEEN a AND b")
def quantile_trim(spark, sf):
    return filters.quantile_trim(read(spark, sf, "events").select("event_id", "value"), "value")


@query("SELECT event_id, user_id, value FROM events JOIN (SELECT user_id AS u, quantile_cont(value, 0.05) AS a, quantile_cont(value, 0.95) AS b FROM events GROUP BY 1) ON user_id = u AND value BETWEEN a AND b")
def quantile_trim_per_track(spark, sf):
    return filters.quantile_trim(read(spark, sf, "events").select("event_id", "user_id", "value"), "value", 0.05, 0.95, track="user_id")


@query(f"{EV}, d AS (SELECT *, ({_HAV}) / nullif((epoch_us(ts) - epoch_us(lag(ts) OVER {W})) / 1e6, 0) AS speed FROM e) SELECT track_id, seq FROM d WHERE speed IS NULL OR speed < 0.5")
def speed_outliers(spark, sf):
    return filters.speed_outliers(tracks(spark, sf), T, "ts", "lat", "lon", 0.5).select(*KEY)


@query(f"{EV} SELECT track_id, seq, event_id % 6 <> 4 AND event_id % 6 <> 5 AS poor FROM e WHERE v > 20 AND (seq - 1) % 3 = 0")
def row_filters(spark, sf):
    d = filters.every_nth(tracks(spark, sf), T, 3)
    d = filters.finite_rows(filters.moving(d, "v", 20.0), "v")
    q = F.when(F.col("event_id") % 6 == 5, "?").otherwise((F.col("event_id") % 6).cast("string"))
    return d.select(*KEY, filters.poor_quality(q).alias("poor"))


@query(f"{EV} SELECT track_id, seq, json_extract_string(props, '$.k')::INT AS k FROM e WHERE json_extract_string(props, '$.k')::INT % 2 = 1")
def json_tags(spark, sf):
    d = tracks(spark, sf, "props").withColumn("tags", F.from_json("props", "map<string,string>"))
    d = filters.tagged(d, "k").withColumn("k", F.col("tags")["k"].try_cast("int"))
    return d.where("k % 2 = 1").select(*KEY, "k")


# Windows and smoothing


@query(f"{EV} SELECT track_id, seq, round(avg(v) OVER (PARTITION BY track_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS centred, round(avg(v) OVER (PARTITION BY track_id ORDER BY seq ROWS 4 PRECEDING), 6) AS trailing FROM e")
def rolling_means(spark, sf):
    d = smoothing.rolling_mean(tracks(spark, sf), T, "v", to="centred")
    return smoothing.trailing_mean(d, T, "v", 5, to="trailing").select(*KEY, r("centred"), r("trailing"))


@query(f"{EV} SELECT track_id, seq, round(coalesce((lead(v) OVER {W} - lag(v) OVER {W}) / 2, lead(v) OVER {W} - v, v - lag(v) OVER {W}), 6) AS d FROM e")
def centred_difference(spark, sf):
    return tracks(spark, sf).select(*KEY, r(smoothing.difference(T, "v"), 6, "d"))


def _savgol_of(c: str, window: int, degree: int) -> str:
    taps, h = smoothing.savgol_taps(window, degree), window // 2
    at = lambda o: c if o == 0 else f"lag({c}, {-o}) OVER {W}" if o < 0 else f"lead({c}, {o}) OVER {W}"
    row = lambda w, first: " + ".join(f"({float(x)!r}) * {at(first + i)}" for i, x in enumerate(w))
    whens = "".join(f" WHEN seq = {i + 1} THEN {row(taps[i], -i)} WHEN seq = n - {i} THEN {row(taps[window - 1 - i], i - window + 1)}" for i in range(h))
    return f"CASE WHEN n < {window} THEN NULL{whens} ELSE {row(taps[h], -h)} END"


def _savgol_sql(window: int, degree: int) -> str:
    return f"{EV}, z AS (SELECT *, count(*) OVER (PARTITION BY track_id) AS n FROM e) SELECT track_id, seq, round({_savgol_of('v', window, degree)}, 6) AS v_savgol FROM z"


@query(_savgol_sql(3, 1))
def savgol_3_1(spark, sf):
    return smoothing.savgol(tracks(spark, sf), T, "v", 3, 1).select(*KEY, r("v_savgol"))


@query(_savgol_sql(5, 2))
def savgol_5_2(spark, sf):
    return smoothing.savgol(tracks(spark, sf), T, "v", 5, 2).select(*KEY, r("v_savgol"))


def _gaussian_sql(sigma: float = 2.0, r: int = 8) -> str:
    w = [math.exp(-0.5 * (o / sigma) ** 2) for o in range(-r, r + 1)]
    at = lambda o: f"((seq - 1 + {o}) % (2 * n) + 2 * n) % (2 * n)"
    terms = " + ".join(f"{c / sum(w)!r} * l[1 + CASE WHEN {at(o)} < n THEN {at(o)} ELSE 2 * n - 1 - {at(o)} END]" for o, c in zip(range(-r, r + 1), w, strict=True))
    return f"{EV}, g AS (SELECT track_id, list(v ORDER BY seq) AS l, count(*) AS n FROM e GROUP BY 1) SELECT track_id, seq, round({terms}, 6) AS v_smoothed_gaussian FROM e JOIN g USING (track_id)"


@query(_gaussian_sql())
def gaussian_smooth(spark, sf):
    return smoothing.gaussian(tracks(spark, sf), T, "v").select(*KEY, r("v_smoothed_gaussian"))


@query(f"""{EV}, k AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN v END AS g FROM e), a AS (SELECT *, last_value(CASE WHEN g IS NOT NULL THEN seq END IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS sa, last_value(g IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS ga,
 first_value(CASE WHEN g IS NOT NULL THEN seq END IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sb, first_value(g IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS gb FROM k)
SELECT track_id, seq, round(coalesce(g, ga + (gb - ga) * (seq - sa) / nullif(sb - sa, 0), ga, gb), 6) AS g FROM a""")
def interpolate_gaps(spark, sf):
    d = tracks(spark, sf).withColumn("g", F.when(F.col("event_id") % 3 == 0, F.col("v")))
    return smoothing.interpolate(d, T, "g").select(*KEY, r("g"))


# Runs and classes

_RUN = "sum(CASE WHEN lag_ IS NOT DISTINCT FROM {0} AND seq > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY track_id ORDER BY seq ROWS UNBOUNDED PRECEDING)"


@query(f"{EV}, l AS (SELECT *, lag(kind) OVER {W} AS lag_ FROM e), g AS (SELECT *, {_RUN.format('kind')}::BIGINT AS segment_id FROM l) SELECT track_id, segment_id, kind, count(*)::BIGINT AS n, round(avg(v), 6) AS mean FROM g GROUP BY ALL")
def run_segments(spark, sf):
    d = segmentation.run_id(tracks(spark, sf), T, "kind")
    return d.groupBy("track_id", "segment_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean"))


_K = f"{PL}, k0 AS (SELECT *, CASE WHEN event_id % 6 = 0 THEN 0 ELSE (v - 50) / 1e5 END AS k FROM p), n AS (SELECT *, count(*) OVER (PARTITION BY track_id) AS n, CASE WHEN k = 0 THEN 1e-9 ELSE k END AS k1 FROM k0)"


def _line_sql(c: str) -> str:
    """The straight line through each window of three at its middle, and at a track's ends: its factors summed from the
    left, as the filter does, so that values at a class's limit fall to the same side."""
    frame = lambda at: [c if at + o == 0 else f"lag({c}, {-at - o}) OVER {W}" if at + o < 0 else f"lead({c}, {at + o}) OVER {W}" for o in (-1, 0, 1)]
    factor = lambda k, at: "(" + " + ".join(["0e0", *[f"{f} * ({float(w):.17e})" for f, w in zip(frame(at), smoothing.savgol_powers(3, 1)[k], strict=True)]]) + ")"
    return f"CASE WHEN n < 3 THEN NULL WHEN seq = 1 THEN {factor(1, 1)} * -1 + {factor(0, 1)} WHEN seq = n THEN {factor(1, -1)} + {factor(0, -1)} ELSE {factor(0, 0)} END"


_SM = _line_sql("k1")


def _curved(spark, sf) -> DataFrame:
    return planar(spark, sf).withColumn("k", F.when(F.col("event_id") % 6 == 0, 0.0).otherwise((F.col("v") - 50) / 1e5))


@query(f"""{_K}, c AS (SELECT *, {_SM} AS c, max(s - seq * 1e-6) OVER (PARTITION BY track_id ORDER BY seq ROWS UNBOUNDED PRECEDING) + seq * 1e-6 AS s1 FROM n), d AS (SELECT *, {_grad('c', 's1')} AS dc FROM c),
m AS (SELECT *, CASE WHEN coalesce(abs(c) < 1e-4, false) THEN 'straight' WHEN coalesce(abs(dc) < 1e-6, false) THEN 'steady_curve' ELSE 'transition' END AS segment_type FROM d), l AS (SELECT *, lag(segment_type) OVER {W} AS lag_ FROM m)
SELECT track_id, seq, segment_type, {_RUN.format('segment_type')}::BIGINT AS segment_id FROM l""")
def segment_curves(spark, sf):
    return segmentation.segment(_curved(spark, sf), T, "k", "s").select(*KEY, "segment_type", "segment_id")


def _digits(c: str) -> Column:
    """Five digits of a number of any size, or its name."""
    return F.when(F.col(c).isNull(), "null").when(numeric.is_inf(F.col(c)), F.when(F.col(c) > 0, "inf").otherwise("-inf")).otherwise(F.format_string("%.4e", F.col(c) * CLEAR)).alias(c)


def _sql_digits(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'null' WHEN {c} = 'Infinity'::DOUBLE THEN 'inf' WHEN {c} = '-Infinity'::DOUBLE THEN '-inf' ELSE printf('%.4e', {c} * {CLEAR!r}) END AS {c}"


_FULL = f"""{_K}, c AS (SELECT *, {_SM} AS c FROM n),
b AS (SELECT *, lag(c) OVER {W} AS c0, lead(c) OVER {W} AS c2, s - lag(s) OVER {W} AS hs, lead(s) OVER {W} - s AS hd FROM c),
d AS (SELECT *, CASE WHEN hs IS NOT NULL AND hd IS NOT NULL THEN (hs * hs * c2 + (hd * hd - hs * hs) * c - hd * hd * c0) / nullif(hs * hd * (hs + hd), 0) ELSE coalesce((c2 - c) / nullif(hd, 0), (c - c0) / nullif(hs, 0)) END AS dc FROM b),
m AS (SELECT *, coalesce(abs(c) < 1e-4, false) AS straight_mask, coalesce(abs(dc) < 1e-6, false) AS steady_mask, CASE WHEN abs(c) <= 1e-12 THEN 'Infinity'::DOUBLE ELSE 1 / c END AS instant_radius FROM d),
t AS (SELECT *, CASE WHEN straight_mask THEN 'straight' WHEN steady_mask THEN 'steady_curve' ELSE 'transition' END AS segment_type FROM m), l AS (SELECT *, lag(segment_type) OVER {W} AS lag_ FROM t),
g AS (SELECT *, {_RUN.format('segment_type')} AS segment_id FROM l), a AS (SELECT *, CASE WHEN segment_type = 'straight' THEN 'Infinity'::DOUBLE ELSE avg(instant_radius) OVER (PARTITION BY track_id, segment_id) END AS mean_radius FROM g)"""


@query(f"{_FULL} SELECT track_id, seq, round(c + {CLEAR9!r}, 9) + 0.0 AS curvature_smooth, straight_mask, steady_mask, {_sql_digits('instant_radius')}, {_sql_digits('mean_radius')} FROM a")
def segment_curves_full(spark, sf):
    d = segmentation.segment(_curved(spark, sf), T, "k", "s", tie_fix=False)
    return d.select(*KEY, r(F.col("curvature_smooth") + CLEAR9, 9, "curvature_smooth"), "straight_mask", "steady_mask", _digits("instant_radius"), _digits("mean_radius"))


_FIVE = "(PARTITION BY track_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
_V3 = f"""{PL}, n AS (SELECT *, (v - 50) / 1e4 AS k, CASE WHEN v = 50 THEN 'Infinity'::DOUBLE ELSE 1 / ((v - 50) / 1e4) END AS radius, count(*) OVER (PARTITION BY track_id) AS n FROM p), c AS (SELECT *, {_savgol_of('k', 5, 2)} AS k1 FROM n),
d AS (SELECT *, coalesce((lead(k1) OVER {W} - lag(k1) OVER {W}) / 2, lead(k1) OVER {W} - k1, k1 - lag(k1) OVER {W}) AS slope FROM c), f AS (SELECT *, avg(slope) OVER {_FIVE} AS slope5, avg(k1) OVER {_FIVE} AS k5 FROM d),
m AS (SELECT *, CASE WHEN abs(slope5) >= 0.005 THEN 'Übergangsbogen' WHEN abs(k5) < 0.001 THEN 'straight line' ELSE 'curve' END AS kind3 FROM f), l AS (SELECT *, lag(kind3) OVER {W} AS lag_ FROM m), g AS (SELECT *, {_RUN.format('kind3')} AS run FROM l),
u AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY track_id, run) < 3 THEN 'undefined' ELSE kind3 END AS segment_type, avg(radius) FILTER (WHERE radius <> 'Infinity'::DOUBLE) OVER (PARTITION BY track_id, run) AS m FROM g)
SELECT track_id, seq, segment_type, round(CASE WHEN segment_type = 'curve' THEN m END, 3) + 0.0 AS mittelradius FROM u"""


@query(_V3)
def segment_curves_v3(spark, sf):
    d = planar(spark, sf).withColumn("k", (F.col("v") - 50) / 1e4)
    d = d.withColumn("radius", numeric.ieee_div(F.lit(1.0), F.col("k")))
    return segmentation.segment_by_slope(d, T, "k", "radius").select(*KEY, "segment_type", r("mittelradius", 3))


@query(f"""{PL}, n AS (SELECT *, CASE WHEN kind = 'view' THEN 'Infinity'::DOUBLE ELSE v * 100 END AS radius FROM p), m AS (SELECT *, coalesce(avg(CASE WHEN kind <> 'view' THEN radius END) OVER {_FIVE} > 10000 OR count_if(kind = 'view') OVER {_FIVE} > 0, true) AS bent FROM n), l AS (SELECT *, lag(bent) OVER {W} AS lag_ FROM m),
g AS (SELECT *, {_RUN.format('bent')}::BIGINT AS segment_id FROM l), w AS (SELECT *, stddev_samp(CASE WHEN kind <> 'view' THEN radius END) OVER (PARTITION BY track_id, segment_id) AS sd, avg(CASE WHEN kind <> 'view' THEN radius END) OVER (PARTITION BY track_id, segment_id) AS m FROM g),
t AS (SELECT *, CASE WHEN bent THEN 'straight' WHEN coalesce(sd < 50, false) THEN 'curve' ELSE 'transition' END AS segment_type FROM w) SELECT track_id, seq, segment_type, segment_id, round(CASE WHEN segment_type = 'curve' THEN m END, 3) AS segment_radius FROM t""")
def segment_by_spread(spark, sf):
    d = planar(spark, sf).withColumn("radius", F.when(F.col("kind") == "view", float("inf")).otherwise(F.col("v") * 100))
    return segmentation.segment_by_spread(d, T, "radius").select(*KEY, "segment_type", "segment_id", r("segment_radius", 3))


@query(f"{EV}, l AS (SELECT *, lag(kind) OVER {W} AS lag_ FROM e), g AS (SELECT *, {_RUN.format('kind')}::BIGINT AS run FROM l), m AS (SELECT *, row_number() OVER (PARTITION BY track_id, run ORDER BY seq) AS i, count(*) OVER (PARTITION BY track_id, run) AS n FROM g) SELECT track_id, run, seq, v FROM m WHERE i = n // 2 + 1")
def middle_rows(spark, sf):
    d = segmentation.run_id(tracks(spark, sf), T, "kind", to="run")
    return segmentation.middle_rows(d, T, "run").select("track_id", "run", "seq", "v")


@query(f"{EV} SELECT track_id, kind, arg_min(v, seq) AS first_v, arg_max(v, seq) AS last_v FROM e WHERE kind <> 'view' GROUP BY ALL")
def first_last_rows(spark, sf):
    d = tracks(spark, sf).withColumn("kind", F.expr("nullif(kind, 'view')"))
    return segmentation.first_and_last(d, T, "kind", "v")


@query(f"{EV}, f AS (SELECT track_id, kind, min(seq) AS place FROM e GROUP BY ALL), c AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY place) - 1 AS code FROM f) SELECT track_id, seq, code::INT AS code FROM e JOIN c USING (track_id, kind)")
def appearance_codes(spark, sf):
    return segmentation.appearance_codes(tracks(spark, sf), T, "kind").select(*KEY, "code")


@query(f"{EV} SELECT track_id, count(*)::BIGINT AS n, count(DISTINCT (kind, floor(v / 50)))::BIGINT AS places FROM (SELECT *, lag(kind) OVER {W} AS lk, lag(floor(v / 50)) OVER {W} AS lv FROM e) WHERE NOT coalesce(kind = lk AND floor(v / 50) = lv, false) GROUP BY 1")
def unique_places(spark, sf):
    d = tracks(spark, sf).withColumn("band", F.floor(F.col("v") / 50))
    return segmentation.without_repeats(d, T, "kind", "band").groupBy("track_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("kind", "band").alias("places"))


@query(f"{EV}, s AS (SELECT *, max(seq) OVER (PARTITION BY track_id) AS n FROM e), m AS (SELECT *, max(v) OVER (PARTITION BY track_id) AS hi, min(v) OVER (PARTITION BY track_id) AS lo FROM s WHERE seq < n) SELECT track_id, seq, round(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0.5 END, 6) AS colour, CASE WHEN v < 10 OR v > 90 THEN '#FFFF00' END AS flag_colour FROM m")
def colour_segments(spark, sf):
    d = products.out_of_range(products.colour_track(tracks(spark, sf), T, "v", "lat", "lon"), "v", 10.0, 90.0)
    return d.select(*KEY, r("colour"), "flag_colour")


# Aggregates


@query("SELECT 'o_orderkey' AS \"column\", count(*)::BIGINT AS rows, count_if(o_orderkey IS NULL)::BIGINT AS nulls, count_if(o_orderkey = 0)::BIGINT AS zeros FROM orders UNION ALL SELECT 'o_totalprice', count(*)::BIGINT, count_if(o_totalprice IS NULL)::BIGINT, count_if(o_totalprice = 0)::BIGINT FROM orders UNION ALL SELECT 'o_orderstatus', count(*)::BIGINT, count_if(o_orderstatus IS NULL)::BIGINT, -1::BIGINT FROM orders")
def null_zero_counts(spark, sf):
    d = profile.null_and_zero_counts(read(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"))
    return d.withColumn("zeros", F.coalesce("zeros", F.lit(-1).cast("long")))


def _describe_sql(c: str, of: str) -> str:
    return f"SELECT '{c}' AS \"column\", count({c})::BIGINT AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75, round(max({c}), 4) AS max FROM {of}"


@query(" UNION ALL ".join(_describe_sql(c, "lineitem") for c in ("l_quantity", "l_extendedprice", "l_discount")))
def stats_profile(spark, sf):
    d = profile.describe(read(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", "l_discount")
    return d.select("column", "count", *[r(c, 4) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


@query("SELECT count(ts)::BIGINT AS non_null, min(ts) AS first_time, max(ts) AS last_time FROM events")
def time_span(spark, sf):
    return profile.time_span(read(spark, sf, "events"), "ts")


@query("SELECT ts::DATE::VARCHAR AS day, count(*)::BIGINT AS entries FROM events GROUP BY 1")
def entries_per_day(spark, sf):
    return profile.entries_per_day(read(spark, sf, "events"), "ts").withColumn("day", F.col("day").cast("string"))


@query("SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY 1")
def value_counts(spark, sf):
    return profile.value_counts(read(spark, sf, "events"), "event_type")


@query("SELECT least(min(l_quantity), min(l_tax)) + 0.0 AS lo, greatest(max(l_quantity), max(l_tax)) AS hi, round(min(l_quantity) - 0.1 * (max(l_quantity) - min(l_quantity)), 6) AS plo, round(max(l_quantity) + 0.1 * (max(l_quantity) - min(l_quantity)), 6) AS phi FROM lineitem")
def axis_ranges(spark, sf):
    d = read(spark, sf, "lineitem")
    p = profile.padded_range(d, "l_quantity").select(r("lo", 6, "plo"), r("hi", 6, "phi"))
    return profile.joint_range(d, "l_quantity", "l_tax").select(r("lo"), r("hi")).crossJoin(p)  # one row each


@query("SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS ts, round(avg(value), 6) AS value FROM events GROUP BY ALL")
def resample_1h(spark, sf):
    return resample.bucket_mean(read(spark, sf, "events"), "user_id", "ts", "1 hour", "value").select("user_id", "ts", r("value"))


@query(f"""{EV}, a AS (SELECT track_id, seq::DOUBLE AS x, avg(v) AS y FROM e WHERE event_id % 3 = 0 GROUP BY ALL), q AS (SELECT track_id, seq - 0.25 AS x, event_id FROM e WHERE event_id % 3 = 1 AND track_id IN (SELECT track_id FROM a)),
l AS (SELECT q.*, (SELECT max(x) FROM a WHERE a.track_id = q.track_id AND a.x <= q.x) AS xa, (SELECT min(x) FROM a WHERE a.track_id = q.track_id AND a.x >= q.x) AS xb FROM q)
SELECT event_id, round(coalesce(u.y + (w.y - u.y) * (l.x - xa) / nullif(xb - xa, 0), u.y, w.y), 9) AS y FROM l LEFT JOIN a u ON u.track_id = l.track_id AND u.x = xa LEFT JOIN a w ON w.track_id = l.track_id AND w.x = xb
UNION ALL SELECT event_id, NULL FROM e WHERE event_id % 3 = 1 AND track_id NOT IN (SELECT track_id FROM a)""")
def asof_interpolate(spark, sf):
    d = tracks(spark, sf)
    known = d.where("event_id % 3 = 0").select("track_id", F.col("seq").cast("double").alias("x"), F.col("v").alias("y"))
    asked = d.where("event_id % 3 = 1").select("track_id", (F.col("seq") - 0.25).cast("double").alias("x"), "event_id")
    return resample.asof_interpolate(known, asked, "track_id", "x", "y").select("event_id", r("y", 9))


# Joins by distance: suppliers are points, customers are places or short lines.

_PTS = "(SELECT s_suppkey AS p, s_suppkey * 131 % 5000 / 1.0 AS x, s_suppkey * 917 % 5000 / 1.0 AS y FROM supplier)"
_SEG = "(SELECT c_custkey AS q, c_custkey * 71 % 5000 / 1.0 AS ax, c_custkey * 313 % 5000 / 1.0 AS ay, c_custkey * 71 % 5000 + c_custkey % 40 - 20.0 AS bx, c_custkey * 313 % 5000 + c_custkey % 30 - 15.0 AS by_ FROM customer)"
_DIST = """(SELECT p, q, sqrt(pow(x - ax - u * (bx - ax), 2) + pow(y - ay - u * (by_ - ay), 2)) AS d FROM (SELECT *, CASE WHEN pow(bx - ax, 2) + pow(by_ - ay, 2) > 0 THEN greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2)))) ELSE 0 END AS u FROM {0} CROSS JOIN {1}))""".format(_PTS, _SEG)


def _points(spark, sf) -> DataFrame:
    k = F.col("s_suppkey")
    return read(spark, sf, "supplier").select(k.alias("p"), (k * 131 % 5000 / 1.0).alias("x"), (k * 917 % 5000 / 1.0).alias("y"))


def _lines(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    ax, ay = k * 71 % 5000 / 1.0, k * 313 % 5000 / 1.0
    return read(spark, sf, "customer").select(k.alias("q"), ax.alias("ax"), ay.alias("ay"), (ax + k % 40 - 20).alias("bx"), (ay + k % 30 - 15).alias("by"), F.lit(0).alias("n"))


@query(f"SELECT p, q, round(d, 6) AS distance FROM {_DIST} WHERE d <= 60")
def within_distance(spark, sf):
    return spatial.near_pairs(_points(spark, sf), _lines(spark, sf), 60.0, "p", "q").select("p", "q", r("distance"))


@query(f"SELECT p.p, coalesce(h, false) AS gps_blocked FROM {_PTS} p LEFT JOIN (SELECT DISTINCT p, true AS h FROM {_DIST} WHERE d <= 60) b ON p.p = b.p")
def left_blocked_flag(spark, sf):
    return spatial.flag_near(_points(spark, sf), _lines(spark, sf), 60.0, "p").select("p", "gps_blocked")


@query(f"SELECT p.p, coalesce(q, -1) AS q FROM {_PTS} p LEFT JOIN (SELECT p, q FROM {_DIST} WHERE d <= 60) b ON p.p = b.p")
def left_join_fanout(spark, sf):
    return spatial.left_near(_points(spark, sf), _lines(spark, sf), 60.0, "p", "q").select("p", F.coalesce("q", F.lit(-1).cast("long")).alias("q"))


@query(f"SELECT DISTINCT p FROM {_DIST} WHERE d <= 60")
def semi_near(spark, sf):
    return spatial.semi_near(_points(spark, sf), _lines(spark, sf), 60.0, "p").select("p")


@query(f"SELECT p, arg_min(q, (d, q)) AS q, round(min(d), 6) AS distance FROM {_DIST} GROUP BY p")
def nearest_line(spark, sf):
    return spatial.nearest(_points(spark, sf), _lines(spark, sf), "p", "q", 50.0).select("p", "q", r("distance"))


@query(f"SELECT p, q, round(d, 6) AS distance FROM (SELECT *, rank() OVER (PARTITION BY p ORDER BY d) AS k FROM {_DIST}) WHERE k = 1")
def nearest_with_ties(spark, sf):
    return spatial.nearest(_points(spark, sf), _lines(spark, sf), "p", "q", 50.0, ties=True).select("p", "q", r("distance"))


_LL = "51 + {0} % 400 / 1000 AS {1}lat, 11 + {0} * 7 % 600 / 1000 AS {1}lon"


@query(f"SELECT p, arg_min(q, (round(d, 6), q)) AS q, round(min(d), 3) AS distance FROM (SELECT s_suppkey AS p, c_custkey AS q, 2 * 6371000 * asin(least(1, sqrt(pow(sin(radians(plat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(plat)) * pow(sin(radians(plon - lon) / 2), 2)))) AS d FROM (SELECT s_suppkey, {_LL.format('s_suppkey * 13', '')} FROM supplier) CROSS JOIN (SELECT c_custkey, {_LL.format('c_custkey * 29', 'p')} FROM customer)) WHERE d <= 700 GROUP BY p")
def radius_join_nearest(spark, sf):
    place = lambda k: ((51 + k % 400 / 1000).alias("lat"), (11 + k * 7 % 600 / 1000).alias("lon"))
    p = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("p"), *place(F.col("s_suppkey") * 13))
    q = read(spark, sf, "customer").select(F.col("c_custkey").alias("q"), *place(F.col("c_custkey") * 29))
    return spatial.radius_join(p, q, 700.0, "p", "q").select("p", "q", r("distance", 3))


@query(f"WITH c AS (SELECT p.p, p.x, p.y FROM {_PTS} p JOIN {_PTS} o ON sqrt(pow(p.x - o.x, 2) + pow(p.y - o.y, 2)) <= 600 GROUP BY ALL HAVING count(*) >= 3) SELECT DISTINCT p.p FROM {_PTS} p JOIN c ON sqrt(pow(p.x - c.x, 2) + pow(p.y - c.y, 2)) <= 600")
def dbscan_noise(spark, sf):
    return spatial.without_noise(_points(spark, sf), "p", "x", "y", 600.0, 3).select("p")


def _grid_lines(spark, sf, kind: str) -> DataFrame:
    """Suppliers as long lines to the east, customers as lines to the north (or nearly east)."""
    if kind == "bridge":
        k = F.col("s_suppkey")
        x, y = k * 131 % 3000 / 1.0, k * 917 % 3000 / 1.0
        return read(spark, sf, "supplier").select(k.alias("bridge"), x.alias("ax"), y.alias("ay"), (x + 80).alias("bx"), (y + 3).alias("by"), F.lit(0).alias("n"))
    k = F.col("c_custkey")
    x, y = k * 71 % 3000 / 1.0, k * 313 % 3000 / 1.0
    tilt = k % 3 == 0
    return read(spark, sf, "customer").select(k.alias("rail"), x.alias("ax"), y.alias("ay"), F.when(tilt, x + 70).otherwise(x + 2).alias("bx"), F.when(tilt, y + 4).otherwise(y + 90).alias("by"), F.lit(0).alias("n"))


_BR = "(SELECT s_suppkey AS bridge, s_suppkey * 131 % 3000 / 1.0 AS ax, s_suppkey * 917 % 3000 / 1.0 AS ay, s_suppkey * 131 % 3000 + 80.0 AS bx, s_suppkey * 917 % 3000 + 3.0 AS by_ FROM supplier)"
_RL = "(SELECT c_custkey AS rail, c_custkey * 71 % 3000 / 1.0 AS cx, c_custkey * 313 % 3000 / 1.0 AS cy, c_custkey * 71 % 3000 + CASE WHEN c_custkey % 3 = 0 THEN 70.0 ELSE 2.0 END AS dx, c_custkey * 313 % 3000 + CASE WHEN c_custkey % 3 = 0 THEN 4.0 ELSE 90.0 END AS dy FROM customer)"


@query(f"""WITH j AS (SELECT *, (bx - ax) * (dy - cy) - (by_ - ay) * (dx - cx) AS det FROM {_BR}, {_RL}), k AS (SELECT *, ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / nullif(det, 0) AS u, ((cx - ax) * (by_ - ay) - (cy - ay) * (bx - ax)) / nullif(det, 0) AS v FROM j)
SELECT bridge, rail, CASE WHEN rail % 3 = 0 THEN 'on' ELSE 'under' END AS position, round(ax + u * (bx - ax), 4) AS x, round(ay + u * (by_ - ay), 4) AS y FROM k WHERE u BETWEEN 0 AND 1 AND v BETWEEN 0 AND 1""")
def parallel_or_crossing(spark, sf):
    met = spatial.meetings(_grid_lines(spark, sf, "bridge"), _grid_lines(spark, sf, "rail"), 10.0, "bridge", "rail", cell=200.0)
    return met.where("position <> 'unknown'").select("bridge", "rail", "position", r("x", 4), r("y", 4))


@query("SELECT s_nationkey, CASE WHEN bool_or(s_acctbal < 0) THEN 'under' ELSE 'on' END AS position FROM supplier GROUP BY 1")
def any_under(spark, sf):
    d = read(spark, sf, "supplier").withColumn("position", F.when(F.col("s_acctbal") < 0, "under").otherwise("unknown"))
    return spatial.any_under(d, "s_nationkey")


@query("SELECT s_suppkey, CASE WHEN s_nationkey < 10 THEN 'below' WHEN s_nationkey > 10 THEN 'above' ELSE 'equal' END AS position FROM supplier")
def level_position(spark, sf):
    return read(spark, sf, "supplier").select("s_suppkey", spatial.level_position(F.col("s_nationkey"), F.lit(10)).alias("position"))


@query("SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer) WHERE k = 1")
def dedup_first(spark, sf):
    return spatial.first_of(read(spark, sf, "customer").select("c_nationkey", "c_custkey"), "c_nationkey", "c_custkey")


@query("SELECT s_suppkey AS id, 'bridge' AS infrastructure, s_acctbal AS height FROM supplier UNION ALL SELECT c_custkey, 'tunnel', NULL FROM customer")
def union_infra(spark, sf):
    b = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("bridge").alias("infrastructure"), F.col("s_acctbal").alias("height"))
    return b.unionByName(read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit("tunnel").alias("infrastructure")), allowMissingColumns=True)


@query("SELECT n_nationkey, n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def lookup_join(spark, sf):
    return read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", "n_name", "r_name")


def _curves(spark, sf) -> DataFrame:
    """Customers as bent lines of three vertices."""
    k = F.col("c_custkey")
    x, y = k * 71 % 5000 / 1.0, k * 313 % 5000 / 1.0
    vertex = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    return read(spark, sf, "customer").select(k.alias("q"), F.array(vertex(0, 0), vertex(20, k % 7 + 1), vertex(40, 0), vertex(60, 3)).alias("geometry"))


_VX = "(SELECT c_custkey AS q, unnest([0, 1, 2, 3]) AS n, c_custkey * 71 % 5000 + unnest([0.0, 20, 40, 60])::DOUBLE AS x, c_custkey * 313 % 5000 + unnest([0.0, c_custkey % 7 + 1, 0, 3])::DOUBLE AS y FROM customer)"
#: Point p against every piece of every curve q; the point's foot lies at ax + u * (bx - ax).
_FEET = f"""v AS (SELECT * FROM {_VX}), sg AS (SELECT * FROM (SELECT q, n, x AS ax, y AS ay, lead(x) OVER (PARTITION BY q ORDER BY n) AS bx, lead(y) OVER (PARTITION BY q ORDER BY n) AS by_ FROM v) WHERE bx IS NOT NULL),
f AS (SELECT *, greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2)))) AS u FROM {_PTS}, sg), fd AS (SELECT *, sqrt(pow(x - ax - u * (bx - ax), 2) + pow(y - ay - u * (by_ - ay), 2)) AS d FROM f)"""


@query(f"""WITH {_FEET}, b AS (SELECT p, arg_min(q, (d, q, n)) AS q, arg_min(n + CASE WHEN u > 0.5 THEN 1 ELSE 0 END, (d, q, n)) AS n, min(d) AS d FROM fd GROUP BY p),
t AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM v WINDOW w AS (PARTITION BY q ORDER BY n)),
e AS (SELECT *, sqrt(pow(x - nx, 2) + pow(y - ny, 2)) AS a, sqrt(pow(px - nx, 2) + pow(py - ny, 2)) AS b, sqrt(pow(px - x, 2) + pow(py - y, 2)) AS c FROM t), h AS (SELECT *, (a + b + c) / 2 AS s FROM e)
SELECT b.p, b.q, round(d, 4) AS dist2rail, round(coalesce(a * h.b * c / (4 * sqrt(s * (s - a) * (s - h.b) * (s - c))), -1), 4) AS map_radius FROM b JOIN h USING (q, n)""")
def map_radius(spark, sf):
    return spatial.map_radius(_points(spark, sf), _curves(spark, sf), "p", "q", 50.0).select("p", "q", r("dist2rail", 4), r(F.coalesce("map_radius", F.lit(-1.0)), 4, "map_radius"))


#: The spline's direction four metres behind the second vertex of each curve: seven samples, ten metres to either side.
_BENT = f"""WITH c AS (SELECT c_custkey AS q, c_custkey % 7 + 1 AS h FROM customer), l AS (SELECT *, sqrt(400 + h * h) AS n FROM c),
w AS (SELECT unnest({[round(float(v), 12) for v in slope_weights(np.array([3.0]))[0]]}) AS w, unnest(range(-3, 4)) AS i),
m AS (SELECT q, sum(w * (4 + i * 10 / 3) * 20 / n) AS dx, sum(w * abs(4 + i * 10 / 3) * -h / n) AS dy FROM l, w GROUP BY q),
b AS (SELECT q, (degrees(atan2(dy, dx)) + 180) % 180 AS angle FROM m)"""


def _behind() -> tuple[Column, Column]:
    g = F.col("geometry")
    part = lambda k: (g[1][k] + 4 * (g[2][k] - g[1][k]) / F.hypot(g[2]["x"] - g[1]["x"], g[2]["y"] - g[1]["y"]))
    return part("x"), part("y")


@query(f"{_BENT} SELECT q, round(angle, 4) AS angle FROM b")
def line_orientation(spark, sf):
    x, y = _behind()
    d = _curves(spark, sf).withColumns({"x": x, "y": y})
    return d.select("q", F.round(line_angle_at("geometry", "x", "y"), 4).alias("angle"))


@query(f"{_BENT}, g AS (SELECT q, abs(angle - q * 7 % 180) AS g FROM b) SELECT q AS id, CASE WHEN least(g, 180 - g) <= 20 THEN 'on' ELSE 'under' END AS position FROM g")
def bent_bridges_by_spline(spark, sf):
    """Bridges that bend where a railway meets them: the piece that it meets hasn't the direction that counts."""
    c, (x, y), turn = _curves(spark, sf), _behind(), F.radians(F.col("q") * 7 % 180)
    end = lambda k: F.struct((x + k * F.cos(turn)).alias("x"), (y + k * F.sin(turn)).alias("y"))
    rails = c.select(F.col("q").alias("r"), F.array(end(-30), end(30)).alias("geometry"))
    met = c.select(F.col("q").alias("id"), F.col("q").alias("r"), F.lit("under").alias("position"), x.alias("x"), y.alias("y"))
    return spatial.by_spline(met, c.withColumnRenamed("q", "id"), rails, "id", "r", parallel=20.0).select("id", "position")


@query(f"""WITH s AS (SELECT *, greatest(0, least(1, CASE WHEN pow(bx - ax, 2) + pow(by_ - ay, 2) > 0 THEN ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2)) ELSE 0 END)) AS u FROM {_PTS}, {_SEG}),
n AS (SELECT *, (p * 17 % 360)::DOUBLE AS train_bearing, ((degrees(atan2(bx - ax, by_ - ay)) % 360) + 360) % 360 % 180 AS infra_bearing FROM s WHERE sqrt(pow(x - ax - u * (bx - ax), 2) + pow(y - ay - u * (by_ - ay), 2)) <= 60),
g AS (SELECT *, least(abs(train_bearing - infra_bearing) % 180, 180 - abs(train_bearing - infra_bearing) % 180) AS gap FROM n)
SELECT p, q, train_bearing, round(infra_bearing, 6) + 0.0 AS infra_bearing, round(gap, 6) + 0.0 AS angle_diff, CASE WHEN gap < 5 THEN 'on bridge' ELSE 'under bridge' END AS status FROM g""")
def along_or_across(spark, sf):
    p = _points(spark, sf).withColumn("bearing", (F.col("p") * 17 % 360).cast("double"))
    return spatial.along_or_across(p, _lines(spark, sf), 60.0, "p", "q", "bearing").select("p", "q", "train_bearing", r("infra_bearing"), r("angle_diff"), "status")


@query(f"WITH {_FEET.partition(', f AS')[0]}, w AS (SELECT *, sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) AS w FROM sg), c AS (SELECT q, sum(w * (ax + bx) / 2) / sum(w) AS x, sum(w * (ay + by_) / 2) / sum(w) AS y FROM w GROUP BY q) SELECT round(avg(x), 4) AS x, round(avg(y), 4) AS y FROM c")
def centroid_mean(spark, sf):
    return spatial.centre(_curves(spark, sf), "q").select(r("x", 4), r("y", 4))


@query(f"""WITH d AS (SELECT s_suppkey AS p, c_custkey AS q, 2 * 6371000 * asin(least(1, sqrt(pow(sin(radians(plat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(plat)) * pow(sin(radians(plon - lon) / 2), 2)))) AS d FROM (SELECT s_suppkey, {_LL.format('s_suppkey * 13', '')} FROM supplier) CROSS JOIN (SELECT c_custkey, {_LL.format('c_custkey * 29', 'p')} FROM customer)),
n AS (SELECT p, arg_min(q, (round(d, 6), q)) AS q FROM d WHERE d <= 300 GROUP BY p)
SELECT s_suppkey AS p, CASE WHEN q IS NOT NULL AND s_nationkey <> 4 THEN 'near bridge ' || q || ' (poor GPS)' WHEN q IS NOT NULL THEN 'near bridge ' || q WHEN s_nationkey <> 4 THEN 'poor GPS' ELSE 'clear' END AS structure_status FROM supplier LEFT JOIN n ON p = s_suppkey""")
def structure_status(spark, sf):
    place = lambda k: ((51 + k % 400 / 1000).alias("lat"), (11 + k * 7 % 600 / 1000).alias("lon"))
    p = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("p"), F.col("s_nationkey").alias("quality"), *place(F.col("s_suppkey") * 13))
    q = read(spark, sf, "customer").select(F.col("c_custkey").alias("structure_id"), F.lit("bridge").alias("structure_type"), *place(F.col("c_custkey") * 29))
    return spatial.structure_status(p, q, 300.0, "p", quality="quality").select("p", "structure_status")


def _ways(spark, sf) -> DataFrame:
    """Bridges, tunnels and railways in degrees, in two regions."""
    deg = 1 / 111_320.0
    flat = lambda d, i: d.select((F.col(i) * 3 + (0 if i == "bridge" else 1)).alias("id"), F.array(*[F.struct((10 + F.col(a) * deg).alias("x"), (F.col(b) * deg).alias("y")) for a, b in (("ax", "ay"), ("bx", "by"))]).alias("geometry"), (F.col(i) % 3).cast("int").alias("layer"))
    b = flat(_grid_lines(spark, sf, "bridge"), "bridge").withColumn("kind", F.lit("bridge"))
    rl = flat(_grid_lines(spark, sf, "rail"), "rail").withColumn("kind", F.lit("railway"))
    return b.unionByName(rl).unionByName(rl.where("id % 4 = 0").withColumn("kind", F.lit("tunnel"))).withColumn("bundesland", F.when(F.col("id") % 2 == 0, "sachsen").otherwise("bayern"))


def _mercator_sql(of: str, *, layer: str) -> str:
    """Lines of _BR or _RL in web Mercator metres, by way of degrees."""
    x = lambda c: f"{geo.A} * radians(10 + {c} / 111320.0)"
    y = lambda c: f"{geo.A} * ln(tan(pi() / 4 + radians({c} / 111320.0) / 2))"
    a, b, c, d, key = ("ax", "ay", "bx", "by_", "bridge") if of is _BR else ("cx", "cy", "dx", "dy", "rail")
    return f"(SELECT {key}, {key} % 3 AS {layer}, {x(a)} AS {a}, {y(b)} AS {b}, {x(c)} AS {c}, {y(d)} AS {d} FROM {of})"


def _gap_sql(px: str, py: str, ax: str, ay: str, bx: str, by: str) -> str:
    u = f"greatest(0, least(1, (({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay})) / (pow({bx} - {ax}, 2) + pow({by} - {ay}, 2))))"
    return f"sqrt(pow({px} - {ax} - {u} * ({bx} - {ax}), 2) + pow({py} - {ay} - {u} * ({by} - {ay}), 2))"


_ENDS = (("ax", "ay", "bx", "by_"), ("cx", "cy", "dx", "dy"))
_NEAREST_ENDS = "least(" + ", ".join(_gap_sql(*one[i : i + 2], *other) for one, other in (_ENDS, _ENDS[::-1]) for i in (0, 2)) + ")"
_WAYS = f"""WITH j AS (SELECT *, (bx - ax) * (dy - cy) - (by_ - ay) * (dx - cx) AS det FROM {_mercator_sql(_BR, layer='lb')}, {_mercator_sql(_RL, layer='lr')}),
k AS (SELECT *, coalesce(((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / nullif(det, 0) BETWEEN 0 AND 1 AND ((cx - ax) * (by_ - ay) - (cy - ay) * (bx - ax)) / nullif(det, 0) BETWEEN 0 AND 1, false) AS hit FROM j),
under AS (SELECT DISTINCT bridge FROM (SELECT bridge, abs(degrees(atan2(by_ - ay, bx - ax)) - degrees(atan2(dy - cy, dx - cx))) % 180 AS g FROM k WHERE hit) WHERE least(g, 180 - g) > 10),
below AS (SELECT DISTINCT bridge FROM k WHERE lr < lb AND (hit OR {_NEAREST_ENDS} <= 10))"""


@query(f"""{_WAYS} SELECT bridge * 3 AS index, 'under' AS position, 'bridge' AS infrastructure, CASE WHEN bridge % 2 = 0 THEN 'sachsen' ELSE 'bayern' END AS bundesland FROM under
UNION ALL SELECT id, 'in', 'tunnel', CASE WHEN id % 2 = 0 THEN 'sachsen' ELSE 'bayern' END FROM (SELECT c_custkey * 3 + 1 AS id FROM customer) WHERE id % 4 = 0""")
def infrastructure_combined(spark, sf):
    return infrastructure.combined(_ways(spark, sf)).select("index", "position", "infrastructure", "bundesland")


@query(f"{_WAYS} SELECT bridge * 3 AS id, 'under' AS position FROM under")
def bridges_by_spline(spark, sf):
    """The lines are straight, so that splines along them turn as they do."""
    return infrastructure.bridges(_ways(spark, sf), rule="spline").select("id", "position")


@query(f"{_WAYS} SELECT bridge * 3 AS id, 'below' AS position FROM below")
def bridges_by_layer(spark, sf):
    return infrastructure.bridges(_ways(spark, sf), rule="layer").select("id", "position")


@query(f"""SELECT '{{"type":"Feature","properties":{{"q":' || q || '}},"geometry":{{"type":"LineString","coordinates":[' || string_agg('[' || x || ',' || y || ']', ',' ORDER BY n) || ']}}}}' AS value FROM {_VX} GROUP BY q""")
def geojson_features(spark, sf):
    return sinks.features(_curves(spark, sf))


@query(f"{EV} SELECT 'Point' AS kind, round(lon, 6) AS lon, round(lat, 6) AS lat, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS time, printf('%.1f km/h', round(v * 3.6, 1)) AS popup, 'circle' AS icon FROM e")
def timed_features(spark, sf):
    """Features, read back from their JSON."""
    made = sinks.timed_features(tracks(spark, sf), "ts", "lat", "lon", F.format_string("%.1f km/h", F.round(numeric.kmh(F.col("v")), 1)))
    j = F.from_json("value", "type string, geometry struct<type: string, coordinates: array<double>>, properties struct<time: string, popup: string, icon: string>")
    return made.select(j.alias("j")).where("j.type = 'Feature'").select(F.col("j.geometry.type").alias("kind"), r(F.col("j.geometry.coordinates")[0], 6, "lon"), r(F.col("j.geometry.coordinates")[1], 6, "lat"), "j.properties.*")


# State along a track


#: Tracks, for queries that go from step to step.
_STEPS = "e AS (SELECT user_id AS track_id, event_id, ts, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)"


def _class_sql(v: str) -> str:
    bins = sequential.SPEED_BINS
    return "CASE " + " ".join(f"WHEN {v} >= {a} AND {v} < {b} THEN {i}" for i, (a, b) in enumerate(zip(bins, bins[1:], strict=False))) + f" ELSE {len(bins) - 1} END"


_STOPS = f"""WITH RECURSIVE {_STEPS}, a AS (SELECT *, 51 + v / 1000 AS lat, 11 + event_id % 100 / 1000 AS lon, (epoch_us(ts) - epoch_us(first_value(ts) OVER {W})) / 1e6 AS t, avg(greatest(v - 30, 0) / 10) OVER {_FIVE} AS u FROM e),
b AS (SELECT *, avg(u) OVER (PARTITION BY track_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ahead, {_class_sql('u')} AS own FROM a),
c AS (SELECT *, t + CASE WHEN own = 0 THEN 300 WHEN u < 0.5 THEN 1 ELSE greatest(1, least(9999, 20 / (u + 1e-6))) END AS until, {_class_sql('ahead')} AS next FROM b),
k AS (SELECT track_id, seq, seq AS start, own, until FROM c WHERE seq = 1 UNION ALL
 SELECT track_id, seq, CASE WHEN fresh THEN seq ELSE start END, CASE WHEN fresh THEN mine ELSE own END, CASE WHEN fresh THEN lasts ELSE until END
 FROM (SELECT c.track_id, c.seq, k.start, k.own, k.until, c.own AS mine, c.until AS lasts, c.t > k.until OR (c.own <> k.own AND CASE WHEN k.own = 0 THEN c.ahead >= 0.5 ELSE c.next <> k.own END) AS fresh FROM k JOIN c ON c.track_id = k.track_id AND c.seq = k.seq + 1)),
g AS (SELECT track_id, start, any_value(k.own) AS own, max(seq) AS last, avg(lat) AS lat, avg(lon) AS lon, avg(u) AS speed FROM k JOIN c USING (track_id, seq) GROUP BY track_id, start),
m AS (SELECT track_id, start AS seq, 'STOP_START' AS segment_marker, lat, lon, speed FROM g WHERE own = 0 UNION ALL SELECT track_id, last, 'STOP_END', lat, lon, speed FROM g WHERE own = 0 UNION ALL SELECT track_id, start, 'MOVING_' || {_class_sql('speed')}, lat, lon, speed FROM g WHERE own <> 0)"""


@query(f"""{_STOPS} SELECT track_id, seq, segment_marker, round(lat, 6) AS lat_smoothed_rolling_windows, round(lon, 6) AS lon_smoothed_rolling_windows, round(speed, 6) AS speed FROM m""")
def stop_move(spark, sf):
    d = kinematics.elapsed_time(tracks(spark, sf), T).withColumn("speed", F.greatest(F.col("v") - 30, F.lit(0.0)) / 10)
    d = sequential.stop_move(d, T, "lat", "lon", "speed")
    return d.select(*KEY, "segment_marker", r("lat_smoothed_rolling_windows"), r("lon_smoothed_rolling_windows"), r("speed"))


_Q = geo.E2**0.5
#: Pieces in their new order, projected; the steps of the daily pipeline one on the other.
_CHAIN = f"""{_STOPS}, n AS (SELECT m.track_id, row_number() OVER (PARTITION BY m.track_id ORDER BY t, m.seq, segment_marker = 'STOP_END') AS seq, segment_marker, m.lat, m.lon FROM m JOIN c ON c.track_id = m.track_id AND c.seq = m.seq),
z AS (SELECT *, floor((avg(lon) OVER (PARTITION BY track_id) + 180) / 6) + 1 AS zone, coalesce({_HAV}, 0) AS d FROM n), ua AS (SELECT *, radians(lon - (zone * 6 - 183)) AS dl, sinh(atanh(sin(radians(lat))) - {_Q!r} * atanh({_Q!r} * sin(radians(lat)))) AS q FROM z),
ub AS (SELECT *, atan2(q, cos(dl)) AS xi, asinh(sin(dl) / sqrt(q * q + cos(dl) * cos(dl))) AS eta FROM ua), p AS (SELECT *, {_UTM_X} AS x, {_UTM_Y} AS y, sum(d) OVER (PARTITION BY track_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS way FROM ub)"""


@query(f"""{_CHAIN} SELECT track_id, seq, segment_marker, round(x, 2) AS x, round(y, 2) AS y, round(way, 2) AS cumulative_distance_m, 'time,rolling_windows,planar,distance,heading_dx_dy' AS steps, CASE WHEN lag(x, 3) OVER w IS NOT NULL AND lead(x, 3) OVER w IS NOT NULL THEN
 round(((degrees(atan2(avg(x) OVER f3 - avg(x) OVER b3, avg(y) OVER f3 - avg(y) OVER b3)) % 360) + 360) % 360, 3) END AS heading_dx_dy_grad FROM p
 WINDOW w AS {W}, f3 AS (PARTITION BY track_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), b3 AS (PARTITION BY track_id ORDER BY seq ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""")
def daily_chain(spark, sf):
    """Five steps of the pipeline, each on what the one before it made."""
    d = tracks(spark, sf).withColumn("speed", F.greatest(F.col("v") - 30, F.lit(0.0)) / 10)
    d = daily.run(d, lat="lat", lon="lon", exact_distance=False, steps=("time", "rolling_windows", "planar", "distance", "heading_dx_dy"))
    return d.select(*KEY, "segment_marker", r("x", 2), r("y", 2), r("cumulative_distance_m", 2), r("heading_dx_dy_grad", 3), F.array_join("steps", ",").alias("steps"))


#: Rows of a chunk in queries that cut tracks over several tasks.
SPLIT = 20


@query(ORACLE_SQL["stop_move"])
def stop_move_split(spark, sf):
    d = kinematics.elapsed_time(tracks(spark, sf), T).withColumn("speed", F.greatest(F.col("v") - 30, F.lit(0.0)) / 10)
    d = sequential.stop_move(d, T, "lat", "lon", "speed", split=SPLIT)
    return d.select(*KEY, "segment_marker", r("lat_smoothed_rolling_windows"), r("lon_smoothed_rolling_windows"), r("speed"))


@query(f"""{_STOPS}, n AS (SELECT track_id, start, (min(t) + max(t)) / 2 AS mid FROM k JOIN c USING (track_id, seq) GROUP BY track_id, start)
SELECT m.track_id, seq, regexp_replace(segment_marker, 'MOVING_.*', 'MOVING') AS segment_marker, round(mid, 6) AS time_numeric, round(speed, 6) AS speed FROM m JOIN n ON m.track_id = n.track_id AND n.start = (SELECT max(start) FROM n z WHERE z.track_id = m.track_id AND z.start <= m.seq)""")
def stop_move_plain(spark, sf):
    """Moves without classes, with the middle of each piece's time: the markers of former versions."""
    d = kinematics.elapsed_time(tracks(spark, sf), T).withColumn("speed", F.greatest(F.col("v") - 30, F.lit(0.0)) / 10)
    return sequential.stop_move(d, T, "lat", "lon", "speed", plain_markers=True, split=SPLIT).select(*KEY, "segment_marker", r("time_numeric"), r("speed"))


@query(f"""WITH RECURSIVE {_STEPS}, p AS (SELECT track_id, seq, v * 10 AS x, (event_id % 100) * 7e0 AS y FROM e),
k AS (SELECT track_id, seq, x AS lx, y AS ly, true AS keep FROM p WHERE seq = 1 UNION ALL
 SELECT track_id, seq, CASE WHEN far THEN x ELSE lx END, CASE WHEN far THEN y ELSE ly END, far FROM (SELECT p.*, lx, ly, sqrt((x - lx) * (x - lx) + (y - ly) * (y - ly)) >= 300 AS far FROM k JOIN p ON p.track_id = k.track_id AND p.seq = k.seq + 1))
SELECT track_id, seq, 300.0::DOUBLE AS min_distance FROM k WHERE keep""")
def min_spacing(spark, sf):
    return sequential.thin_by_distance(planar(spark, sf), T, "x", "y", 300.0).select(*KEY, "min_distance")


@query(ORACLE_SQL["min_spacing"])
def min_spacing_split(spark, sf):
    return sequential.thin_by_distance(planar(spark, sf), T, "x", "y", 300.0, split=SPLIT).select(*KEY, "min_distance")


@query(f"""WITH RECURSIVE e AS (SELECT user_id AS track_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
k AS (SELECT track_id, seq, v AS x, 1.1 * (1 - 1.1 / 3.1) AS p FROM e WHERE seq = 1 UNION ALL SELECT e.track_id, e.seq, x + (p + 0.1) / (p + 2.1) * (v - x), (p + 0.1) * (1 - (p + 0.1) / (p + 2.1)) FROM k JOIN e ON e.track_id = k.track_id AND e.seq = k.seq + 1)
SELECT track_id, seq, round(x, 6) AS v_kalman FROM k""")
def kalman_yaw(spark, sf):
    return sequential.kalman_smooth(tracks(spark, sf), T, "v").select(*KEY, r("v_kalman"))


#: The filter in two dimensions over p, step by step. Its covariance goes on as p11, p12, p22 and its determinant pd, as 1 - gain
#: has no digits left after a long step.
_KALMAN = """k AS (SELECT track_id, 0::BIGINT AS seq, false AS moves, NULL::DOUBLE AS since, lat AS a, 0.0::DOUBLE AS va, lon AS o, 0.0::DOUBLE AS vo, 100.0::DOUBLE AS p11, 0.0::DOUBLE AS p12, 100.0::DOUBLE AS p22, 10000.0::DOUBLE AS pd FROM p WHERE seq = 1 UNION ALL
 SELECT track_id, seq, on_, held, CASE WHEN on_ THEN qa + s11 / n * (lat - qa) ELSE mlat END, CASE WHEN on_ THEN va + s12 / n * (lat - qa) ELSE 0 END, CASE WHEN on_ THEN qo + s11 / n * (lon - qo) ELSE mlon END, CASE WHEN on_ THEN vo + s12 / n * (lon - qo) ELSE 0 END,
  CASE WHEN on_ THEN 1e-3 * s11 / n ELSE 100 END, CASE WHEN on_ THEN 1e-3 * s12 / n ELSE 0 END, CASE WHEN on_ THEN (sd + 1e-3 * s22) / n ELSE 100 END, CASE WHEN on_ THEN 1e-3 * sd / n ELSE 10000 END
 FROM (SELECT *, s11 + 1e-3 AS n, pd + 1e-5 * (p22 + s11) AS sd FROM (SELECT *, CASE WHEN coalesce(t - from_ >= 3600, false) THEN NOT moves ELSE moves END AS on_, CASE WHEN coalesce(t - from_ >= 3600, false) THEN NULL ELSE from_ END AS held,
   a + dt * va AS qa, o + dt * vo AS qo, p11 + 2 * dt * p12 + dt * dt * p22 + 1e-5 AS s11, p12 + dt * p22 AS s12, p22 + 1e-5 AS s22
  FROM (SELECT p.*, moves, a, va, o, vo, p11, p12, p22, pd, CASE WHEN (CASE WHEN moves THEN v < 40 ELSE v > 60 END) THEN coalesce(since, t) END AS from_ FROM k JOIN p ON p.track_id = k.track_id AND p.seq = k.seq + 1))))"""


@query(f"""WITH RECURSIVE {_STEPS}, p AS (SELECT track_id, seq, v, 51 + v / 1000 AS lat, 11 + event_id % 100 / 1000 AS lon, (epoch_us(ts) - epoch_us(first_value(ts) OVER {W})) / 1e6 AS t,
 (epoch_us(ts) - epoch_us(coalesce(lag(ts) OVER {W}, ts))) / 1e6 AS dt, avg(51 + v / 1000) OVER (PARTITION BY track_id ORDER BY seq ROWS 4 PRECEDING) AS mlat, avg(11 + event_id % 100 / 1000) OVER (PARTITION BY track_id ORDER BY seq ROWS 4 PRECEDING) AS mlon FROM e),
{_KALMAN}
SELECT track_id, seq, moves AS is_moving, round(a + {CLEAR6!r}, 6) AS lat_smoothed_kalman, round(o + {CLEAR6!r}, 6) AS lon_smoothed_kalman FROM k WHERE seq > 0""")
def kalman_track(spark, sf):
    d = kinematics.elapsed_time(tracks(spark, sf), T)
    d = sequential.kalman_track(d, T, "lat", "lon", "v", move=60.0, stop=40.0, hold=3600.0)
    return d.select(*KEY, "is_moving", *[r(F.col(c) + CLEAR6, 6, c) for c in ("lat_smoothed_kalman", "lon_smoothed_kalman")])


@query(ORACLE_SQL["kalman_yaw"])
def kalman_yaw_split(spark, sf):
    return sequential.kalman_smooth(tracks(spark, sf), T, "v", split=SPLIT).select(*KEY, r("v_kalman"))


@query(ORACLE_SQL["kalman_track"])
def kalman_track_split(spark, sf):
    d = kinematics.elapsed_time(tracks(spark, sf), T)
    d = sequential.kalman_track(d, T, "lat", "lon", "v", move=60.0, stop=40.0, hold=3600.0, split=SPLIT)
    return d.select(*KEY, "is_moving", *[r(F.col(c) + CLEAR6, 6, c) for c in ("lat_smoothed_kalman", "lon_smoothed_kalman")])


def _uniform_sql(step: str, particle: str, number: int) -> str:
    a, b, c, d = sequential.FACTORS
    k = f"((key * {a} + ({step}) * {b} + ({particle}) * {c} + {number * d}) % {sequential.PRIME})"
    k2 = f"({k} * {k} % {sequential.PRIME})"
    return f"((({k2} * {k2} % {sequential.PRIME}) * {k} % {sequential.PRIME} + 0.5::DOUBLE) / {sequential.PRIME})"


def _normals_sql(step: str, particle: str) -> list[str]:
    u = [_uniform_sql(step, particle, d) for d in range(4)]
    return [f"sqrt(-2 * ln({u[d]})) * {f}(2 * pi() * {u[d + 1]})" for d in (0, 2) for f in ("cos", "sin")]


_PF = [("la", "lat", 1e-4), ("lo", "lon", 1e-4), ("sp", "v", 0.1), ("ac", "acc", 0.1)]
#: A row for each particle and step: moved, weighed, and put where the evenly spaced places fall.
_PARTICLES = f"""WITH RECURSIVE {_STEPS}, p AS (SELECT track_id, seq, 51 + v / 1000 AS lat, 11 + event_id % 100 / 1000 AS lon, v, (event_id % 7 - 3) / 10 AS acc, ('0x' || md5('0:' || track_id)[1:7])::BIGINT AS key FROM e),
k AS (SELECT track_id, key, 0::BIGINT AS seq, m, {', '.join(f"{z} + sqrt(10) * {s} * {n} AS {x}" for (x, z, s), n in zip(_PF, _normals_sql('0', 'm'), strict=True))} FROM p, (SELECT unnest(range(0, 1000)) AS m) WHERE seq = 1 UNION ALL
 SELECT track_id, key, seq, unnest(range(coalesce(lag(upto) OVER w, 0), upto)) AS m, la, lo, sp, ac FROM
 (SELECT *, CASE WHEN m = 999 THEN 1000 ELSE greatest(0, ceil(mass / (sum(weight) OVER (PARTITION BY track_id)) * 1000 - {_uniform_sql('seq', '0', 4)})) END::BIGINT AS upto FROM
 (SELECT *, sum(weight) OVER (PARTITION BY track_id ORDER BY m ROWS UNBOUNDED PRECEDING) AS mass FROM (SELECT *, exp(-0.5 * (e - min(e) OVER (PARTITION BY track_id))) AS weight FROM
 (SELECT *, {' + '.join(f"pow(({x} - {z}) / {s}, 2)" for x, z, s in _PF)} AS e FROM (SELECT k.track_id, k.key, p.seq, k.m, p.lat, p.lon, p.v, p.acc, {', '.join(f"{x} + {s} * {n} AS {x}" for (x, _, s), n in zip(_PF, [y.replace('key', 'k.key') for y in _normals_sql('p.seq', 'k.m')], strict=True))}
 FROM k JOIN p ON p.track_id = k.track_id AND p.seq = k.seq + 1))))) WINDOW w AS (PARTITION BY track_id ORDER BY m))"""


@query(f"{_PARTICLES} SELECT track_id, seq, round(avg(sp), 3) AS pf_speed, round(avg(ac), 3) AS pf_acc, round(avg(la), 5) AS lat, round(avg(lo), 5) AS lon FROM k WHERE seq > 0 GROUP BY ALL")
def particle_filter(spark, sf):
    d = tracks(spark, sf).withColumn("acc", (F.col("event_id") % 7 - 3) / 10)
    d = sequential.particle_filter(d, T, "lat", "lon", "v", "acc")
    return d.select(*KEY, r("pf_speed", 3), r("pf_acc", 3), r("lat_smoothed_particule", 5, "lat"), r("lon_smoothed_particule", 5, "lon"))


_STEADY = f"""{_CURV.replace('WITH e', 'WITH RECURSIVE e', 1)}, z AS (SELECT track_id, seq, CASE WHEN abs(radius_m_h) > 11000 THEN 0 WHEN isfinite(curvature_h) THEN curvature_h END AS c, CASE WHEN abs(radius_m_h) > 11000 THEN 'Infinity'::DOUBLE ELSE radius_m_h END AS radius FROM k),
g AS (SELECT track_id, 0::BIGINT AS seq, 0::BIGINT AS start, 0::BIGINT AS n, 0.0::DOUBLE AS mean, 0.0::DOUBLE AS m2 FROM z WHERE seq = 1 UNION ALL
 SELECT track_id, seq, CASE WHEN fresh THEN seq ELSE start END, CASE WHEN c IS NULL THEN n_ ELSE n_ + 1 END, CASE WHEN c IS NULL THEN mean_ ELSE mean_ + (c - mean_) / (n_ + 1) END, CASE WHEN c IS NULL THEN m2_ ELSE m2_ + (c - mean_) * (c - mean_ - (c - mean_) / (n_ + 1)) END
 FROM (SELECT *, CASE WHEN fresh THEN 0 ELSE n END AS n_, CASE WHEN fresh THEN 0 ELSE mean END AS mean_, CASE WHEN fresh THEN 0 ELSE m2 END AS m2_ FROM
  (SELECT z.*, start, n, mean, m2, start = 0 OR (n = 0 AND c IS NULL) OR coalesce(sqrt(greatest(m2 + (c - mean) * (c - mean - (c - mean) / (n + 1)), 0) / (n + 1)) > 0.05, false) AS fresh FROM g JOIN z ON z.track_id = g.track_id AND z.seq = g.seq + 1))),
r AS (SELECT track_id, seq, start, count(*) OVER (PARTITION BY track_id, start) >= 3 AS long FROM g WHERE seq > 0), f AS (SELECT *, CASE WHEN long THEN sum(CASE WHEN long AND seq = start THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY seq ROWS UNBOUNDED PRECEDING) ELSE 0 END::BIGINT AS steady_group FROM r)"""


@query(f"{_STEADY} SELECT track_id, seq, steady_group FROM f")
def steady_curves(spark, sf):
    d = kinematics.curvature_and_radius(planar(spark, sf), T, ["h"], "s", straight_radius=11_000.0)
    return sequential.steady_curves(d, T, "curvature_h", "radius_m_h", most=0.05).select(*KEY, "steady_group")


@query(f"""{_STEADY}, o AS (SELECT track_id, steady_group, CASE WHEN abs(radius_m_h) > 11000 THEN 'Infinity'::DOUBLE ELSE radius_m_h END AS radius FROM f JOIN k USING (track_id, seq)),
n AS (SELECT track_id, steady_group, count(*) AS n, bool_or(isinf(radius)) AS endless, avg(CASE WHEN isfinite(radius) THEN radius END) AS radius FROM o GROUP BY ALL)
SELECT track_id, steady_group, n, round(CASE WHEN NOT endless THEN radius END, 3) AS steady_mean_radius FROM n WHERE steady_group > 0""")
def steady_means(spark, sf):
    """The mean radius of each steady curve; none where a row of it is straight."""
    d = kinematics.curvature_and_radius(planar(spark, sf), T, ["h"], "s", straight_radius=11_000.0)
    d = sequential.steady_curves(d, T, "curvature_h", "radius_m_h", most=0.05).where("steady_group > 0")
    m = d.groupBy("track_id", "steady_group").agg(F.count("*").alias("n"), F.min("steady_mean_radius").alias("low"), F.max("steady_mean_radius").alias("steady_mean_radius"))
    whole = numeric.finite(F.col("steady_mean_radius"))
    return m.select("track_id", "steady_group", "n", F.when(F.col("low") == F.col("steady_mean_radius"), r(whole, 3, "steady_mean_radius")).alias("steady_mean_radius"))


def _smoothed(spark, sf):
    """Tracks with several pairs of places and what was made from them, named as the steps name them."""
    d = tracks(spark, sf).withColumnsRenamed({"lat": "GPS_lat", "lon": "GPS_lon"})
    k = {"GPS_lat_smoothed_kalman": F.round(F.col("GPS_lat") + 1, 5), "GPS_lon_smoothed_kalman": F.round(F.col("GPS_lon") + 1, 5), "GPS_lat_smoothed_lost": F.lit(0.0)}
    more = {"heading_dx_dy_grad": F.col("v"), "Heading_ds": F.when(F.col("seq") % 2 == 0, F.col("v")), "yaw_rate_from_heading_dx_dy_grad": F.lit(1.0), "curvature_heading_ds": F.lit(2.0)}
    return d.withColumns(k | more)


@query(f"{EV} SELECT track_id, seq, round(lat + 1, 5) AS chosen_lat, round(lon + 1, 5) AS chosen_lon, 'kalman' AS method, round(lat, 5) AS first_lat, 2 AS pairs FROM e")
def chosen_position(spark, sf):
    """The columns of a smoothing method, and the first pair there is."""
    d = _smoothed(spark, sf)
    (lat, lon), (first, _) = filters.choose_position(d.columns, "kalman"), filters.choose_position(d.columns)
    return d.select(*KEY, r(lat, 5, "chosen_lat"), r(lon, 5, "chosen_lon"), F.lit(kinematics.smoothing_method(lat)).alias("method"), r(first, 5, "first_lat"), F.lit(len(filters.position_pairs(d.columns))).alias("pairs"))


@query(f"""{EV} SELECT 'Heading_ds' AS name, 'heading' AS what, count(*) FILTER (seq % 2 = 0) AS filled FROM e UNION ALL SELECT 'heading_dx_dy_grad', 'heading', count(v) FROM e
UNION ALL SELECT 'yaw_rate_from_heading_dx_dy_grad', 'yaw rate', count(*) FROM e UNION ALL SELECT 'curvature_heading_ds', 'curvature', count(*) FROM e UNION ALL SELECT 'curvature_heading_ds', 'heading', count(*) FROM e""")
def candidate_columns(spark, sf):
    """Columns that steps could go on from, by name, and in how many rows they are filled."""
    d = _smoothed(spark, sf)
    found = [(n, what) for what, f in (("heading", filters.heading_columns), ("yaw rate", filters.yaw_rate_columns), ("curvature", filters.curvature_columns)) for n in f(d.columns)]
    one = d.agg(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(what).alias("what"), F.count(n).alias("filled")) for n, what in found]).alias("a"))
    return one.select(F.explode("a").alias("a")).select("a.*")


def _long_enough(d: DataFrame, c: daily.Config) -> DataFrame:
    def kernel(columns: dict[str, np.ndarray]) -> tuple:
        if len(columns["seq"]) < 65:
            raise ValueError("too few rows")
        return None, {}

    return sequential.per_track(d, c.track, ["seq"], kernel, [], errors=(daily.FAILED, "length"))


@query("""SELECT user_id AS track_id, count(*) AS rows_in, CASE WHEN count(*) >= 65 THEN count(*) ELSE 0 END AS rows_out, CASE WHEN count(*) < 65 THEN 'length' END AS step, CASE WHEN count(*) < 65 THEN 'ValueError(''too few rows'')' END AS error FROM events GROUP BY user_id""")
def daily_outcomes(spark, sf):
    """What became of each track, in a pipeline with a step of its own that fails on short ones."""
    daily.STEPS["length"] = _long_enough
    c = daily.Config(lat="lat", lon="lon", speed="v", steps=("time", "length", "planar"))
    return daily.outcomes(tracks(spark, sf), c)


@query(f"""WITH RECURSIVE {_STEPS}, p AS (SELECT track_id, seq, v * 10 AS x, (event_id % 100) * 7.0 AS y FROM e),
w AS (SELECT track_id, seq, list(x) OVER w AS xs, list(y) OVER w AS ys, count(*) OVER w AS n FROM p WINDOW w AS (PARTITION BY track_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
u AS (SELECT track_id, seq, list_transform(xs, lambda q: q - list_avg(xs)) AS u, list_transform(ys, lambda q: q - list_avg(ys)) AS v FROM w WHERE n = 5),
z AS (SELECT *, list_transform(u, lambda q, i: q * q + v[i] * v[i]) AS z, list_sum(list_transform(u, lambda q: q * q)) AS suu, list_sum(list_transform(v, lambda q: q * q)) AS svv, list_sum(list_transform(u, lambda q, i: q * v[i])) AS suv FROM u),
c AS (SELECT *, suu * svv - suv * suv AS det, list_sum(list_transform(u, lambda q, i: q * z[i])) AS suz, list_sum(list_transform(v, lambda q, i: q * z[i])) AS svz FROM z),
m AS (SELECT *, (suz * svv - svz * suv) / (2 * det) AS cx, (svz * suu - suz * suv) / (2 * det) AS cy FROM c WHERE det > 1e-12 * pow(suu + svv, 2)), o AS (SELECT *, sqrt(cx * cx + cy * cy + list_avg(z)) AS r FROM m),
a AS (SELECT track_id, seq, r, list_avg(list_transform(u, lambda q, i: abs(sqrt(pow(q - cx, 2) + pow(v[i] - cy, 2)) - r))) AS res FROM o),
f AS (SELECT track_id, seq + 2 AS place, r, row_number() OVER (PARTITION BY track_id ORDER BY seq) AS k FROM a WHERE res <= 200 AND r BETWEEN 10 AND 12000),
g AS (SELECT track_id, k, place, r, 1::BIGINT AS number, 1::BIGINT AS n, r AS mean FROM f WHERE k = 1 UNION ALL
 SELECT f.track_id, f.k, f.place, f.r, CASE WHEN abs(f.r - mean) <= 50 THEN number ELSE number + 1 END, CASE WHEN abs(f.r - mean) <= 50 THEN n + 1 ELSE 1 END, CASE WHEN abs(f.r - mean) <= 50 THEN mean + (f.r - mean) / (n + 1) ELSE f.r END FROM g JOIN f ON f.track_id = g.track_id AND f.k = g.k + 1),
b AS (SELECT track_id, number, min(place) AS lo, max(place) AS hi, avg(r) AS r FROM g GROUP BY ALL)
SELECT p.track_id, seq, coalesce(number, -1)::BIGINT AS circle_group, round(coalesce(b.r, -1), 3) AS radius_m_circle FROM p LEFT JOIN b ON b.track_id = p.track_id AND seq BETWEEN lo AND hi""")
def circle_fit(spark, sf):
    return sequential.circle_fit(planar(spark, sf), T, size=5, most_residual=200.0, low=10.0, high=12_000.0).select(*KEY, F.coalesce("circle_group", F.lit(-1).cast("long")).alias("circle_group"), r(F.coalesce("radius_m_circle", F.lit(-1.0)), 3, "radius_m_circle"))


_KS = f"{PL}, ks AS (SELECT track_id, seq, s, CASE WHEN event_id % 6 = 0 THEN 0.0 ELSE (v - 50) / 1e5 END::DOUBLE AS k FROM p)"
#: Curvature over distance as lists of a track, with running sums that begin with 0.
_LISTS = f"""{_KS}, v AS (SELECT track_id, seq, s, CASE WHEN isfinite(k) THEN k END AS y FROM ks), a AS (SELECT track_id, list(coalesce(y, 999.0) ORDER BY seq) AS y, count(*) AS n FROM v GROUP BY track_id)"""
#: The best pieces from the track's start to each possible end (multiples of five, and the last row), by the ends before it.
_PELT = f"""{_LISTS.replace('WITH e', 'WITH RECURSIVE e', 1)}, l AS (SELECT track_id, n, list_append(range(0, n, 5), n) AS ends, list_prepend(0.0, list_transform(range(1, n + 1), lambda i: list_sum(y[1:i]))) AS s1,
 list_prepend(0.0, list_transform(range(1, n + 1), lambda i: list_sum(list_transform(y[1:i], lambda q: q * q)))) AS s2 FROM a WHERE n > 1),
z AS (SELECT track_id, 1 AS k, [-1e-7::DOUBLE] AS best, [0::BIGINT] AS back FROM l UNION ALL
 SELECT track_id, k + 1, list_append(best, list_min(costs)), list_append(back, ends[list_position(costs, list_min(costs))]) FROM
 (SELECT z.*, l.ends, list_transform(range(1, k + 1), lambda i: CASE WHEN ends[k + 1] - ends[i] < 2 THEN 'Infinity'::DOUBLE ELSE best[i] + (s2[ends[k + 1] + 1] - s2[ends[i] + 1]) - (s1[ends[k + 1] + 1] - s1[ends[i] + 1]) * (s1[ends[k + 1] + 1] - s1[ends[i] + 1]) / (ends[k + 1] - ends[i]) + 1e-7 END) AS costs
  FROM z JOIN l USING (track_id) WHERE k < len(ends))),
t AS (SELECT track_id, n AS j, back, ends FROM z JOIN l USING (track_id) WHERE k = len(ends) UNION ALL SELECT track_id, back[list_position(ends, j)], back, ends FROM t WHERE back[list_position(ends, j)] > 0),
b AS (SELECT track_id, j, coalesce(lag(j) OVER (PARTITION BY track_id ORDER BY j), 0) AS i, row_number() OVER (PARTITION BY track_id ORDER BY j) - 1 AS m FROM t),
g AS (SELECT track_id, i, j, m, list_avg(y[i + 1:j]) AS mean FROM b JOIN a USING (track_id))"""


@query(f"""{_PELT} SELECT v.track_id, seq, coalesce(m, 0) AS segment_id, CASE WHEN m IS NULL THEN 'zu klein' WHEN abs(mean) < 5e-5 THEN 'gerade Linie' ELSE 'Kurve' END AS segment_class, round(CASE WHEN abs(mean) >= 5e-5 THEN 1 / abs(mean) END, 2) AS mittelradius
FROM v LEFT JOIN g ON v.track_id = g.track_id AND seq > i AND seq <= j""")
def pelt_segments(spark, sf):
    return sequential.segment_change_points(_curved(spark, sf), T, "k", penalty=1e-7).select(*KEY, "segment_id", "segment_class", r("mittelradius", 2))


#: Least squared error of so many lines up to each row, by the row that the last one begins at; rows without curvature are left out.
_LEFT = """greatest(0, y2[j + 1] - y2[i + 1] - pow(y1[j + 1] - y1[i + 1], 2) / (j - i) - CASE WHEN x[j] > x[i + 1] AND x2[j + 1] - x2[i + 1] - pow(x1[j + 1] - x1[i + 1], 2) / (j - i) > 0
 THEN pow(xy[j + 1] - xy[i + 1] - (x1[j + 1] - x1[i + 1]) * (y1[j + 1] - y1[i + 1]) / (j - i), 2) / (x2[j + 1] - x2[i + 1] - pow(x1[j + 1] - x1[i + 1], 2) / (j - i)) ELSE 0 END)"""
#: No more than rounding leaves is none, so that lines through all their rows are equal, and the first of them is taken. So is
#: the first of sums that only rounding tells apart.
_ERROR = f"CASE WHEN j - i > 2 AND {_LEFT} > {sequential.NO_ERROR!r} * y2[n + 1] THEN {_LEFT} ELSE 0 END"
_SUM = "list_prepend(0.0, list_transform(range(1, n + 1), lambda i: list_sum({0}[1:i])))"
_PIECES = f"""{_KS.replace('WITH e', 'WITH RECURSIVE e', 1)}, v AS (SELECT track_id, seq, s AS x, k AS y FROM ks WHERE isfinite(s) AND isfinite(k)), c AS (SELECT *, x - avg(x) OVER w AS u, y - avg(y) OVER w AS q FROM v WINDOW w AS (PARTITION BY track_id)),
a AS (SELECT track_id, count(*) AS n, list(x ORDER BY seq) AS x, list(y ORDER BY seq) AS y, list(u ORDER BY seq) AS a1, list(q ORDER BY seq) AS a2, list(u * u ORDER BY seq) AS a3, list(u * q ORDER BY seq) AS a4, list(q * q ORDER BY seq) AS a5 FROM c GROUP BY track_id),
l AS (SELECT track_id, n, x, y, {_SUM.format('a1')} AS x1, {_SUM.format('a2')} AS y1, {_SUM.format('a3')} AS x2, {_SUM.format('a4')} AS xy, {_SUM.format('a5')} AS y2 FROM a WHERE n > 1),
e2 AS (SELECT track_id, n, {sequential.NO_ERROR!r} * y2[n + 1] AS none, list_transform(range(1, n + 1), lambda j: list_transform(range(0, j), lambda i: {_ERROR})) AS err FROM l),
z AS (SELECT track_id, 0 AS k, list_prepend(0.0, list_transform(range(1, n + 1), lambda j: 'Infinity'::DOUBLE)) AS cost, [[0::BIGINT]] AS back FROM e2 UNION ALL
 SELECT track_id, k + 1, list_prepend('Infinity'::DOUBLE, low), list_append(back, list_transform(sums, lambda w, j: list_position(list_transform(w, lambda q: q <= low[j] + none), true) - 1)) FROM
 (SELECT *, list_transform(sums, lambda w: list_min(w)) AS low FROM (SELECT z.*, none, list_transform(err, lambda w: list_transform(w, lambda q, i: q + cost[i])) AS sums FROM z JOIN e2 USING (track_id) WHERE k < least(5, n)))),
t AS (SELECT track_id, k, n AS j, back FROM z JOIN e2 USING (track_id) WHERE k = least(5, n) UNION ALL SELECT track_id, k - 1, back[k + 1][j], back FROM t WHERE k > 0),
b AS (SELECT track_id, k - 1 AS segment_index, back[k + 1][j] AS i, j FROM t WHERE k > 0),
g AS (SELECT track_id, segment_index, x[i + 1] AS x0, x[j] AS x9, list_avg(x[i + 1:j]) AS mx, list_avg(y[i + 1:j]) AS my, x[i + 1:j] AS px, y[i + 1:j] AS py FROM b JOIN l USING (track_id)),
h AS (SELECT *, CASE WHEN x9 > x0 THEN list_sum(list_transform(px, lambda q, i: (q - mx) * (py[i] - my))) / list_sum(list_transform(px, lambda q: pow(q - mx, 2))) ELSE 0 END AS slope FROM g)"""


@query(f"""{_PIECES} SELECT track_id, segment_index::INT AS segment_index, round(x0, 3) AS start_distance, round(x9, 3) AS end_distance,
CASE WHEN abs(slope) >= 5e-4 THEN 'transition' WHEN abs(my + slope * ((x0 + x9) / 2 - mx)) < 5e-5 THEN 'straight' ELSE 'curve' END AS segment_type FROM h""")
def piecewise_segments(spark, sf):
    return sequential.segment_piecewise(_curved(spark, sf), T, "k", "s").select("track_id", "segment_index", r("start_distance", 3), r("end_distance", 3), "segment_type")


#: Of two lines that meet, for each place that they may meet at: the best values at the first place, there, and at the last, one
#: eliminated after the other from the sum of squares.
_JOINED = f"""{_KS}, v AS (SELECT track_id, s AS x, k - avg(k) OVER (PARTITION BY track_id) AS y, min(s) OVER (PARTITION BY track_id) AS x0, max(s) OVER (PARTITION BY track_id) AS x9 FROM ks),
q AS (SELECT DISTINCT track_id, x AS q FROM v WHERE x > x0 AND x < x9),
r AS (SELECT track_id, q, y, CASE WHEN x = x0 THEN 0 WHEN x <= q THEN 1 ELSE 2 END AS part, CASE WHEN x <= q THEN (x - x0) / (q - x0) ELSE (x - q) / (x9 - q) END AS r, x0, x9 FROM v JOIN q USING (track_id)),
m AS (SELECT track_id, q, x0, x9, count(*) FILTER (part = 0) AS a0, sum(y) FILTER (part = 0) AS b0, sum(y * y) AS c0, {', '.join(f"coalesce(sum({e}) FILTER (part = {k}), 0) AS {n}{k}" for k in (1, 2) for n, e in (('a', 'pow(1 - r, 2)'), ('b', 'r * r'), ('c', 'r * (1 - r)'), ('d', 'y * (1 - r)'), ('e', 'y * r')))} FROM r GROUP BY ALL),
h AS (SELECT *, b1 - c1 * c1 / (a0 + a1) AS a, e1 - c1 * (b0 + d1) / (a0 + a1) AS b FROM m),
w AS (SELECT *, (e2 - c2 * (b + d2) / (a + a2)) / (b2 - c2 * c2 / (a + a2)) AS y9, c0 - pow(b0 + d1, 2) / (a0 + a1) - pow(b + d2, 2) / (a + a2) - pow(e2 - c2 * (b + d2) / (a + a2), 2) / (b2 - c2 * c2 / (a + a2)) AS error FROM h),
z AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY error, q) = 1), t AS (SELECT *, (b + d2 - c2 * y9) / (a + a2) AS y1 FROM z), o AS (SELECT *, (b0 + d1 - c1 * y1) / (a0 + a1) AS y0 FROM t)"""


@query(f"""{_JOINED} SELECT track_id, 0 AS segment_index, round(x0, 3) AS start_distance, round(q, 3) AS end_distance, round((y1 - y0) / (q - x0) * 1e6, 3) AS slope FROM o UNION ALL SELECT track_id, 1, round(q, 3), round(x9, 3), round((y9 - y1) / (x9 - q) * 1e6, 3) FROM o""")
def piecewise_joined(spark, sf):
    """Two lines that meet; the places of all rows are tried by the SQL."""
    d = sequential.segment_piecewise(_curved(spark, sf), T, "k", "s", count=2, joined=True)
    return d.select("track_id", "segment_index", r("start_distance", 3), r("end_distance", 3), r(F.col("slope") * 1e6, 3, "slope"))


#: The spline's second derivatives by elimination up and down each track, then a polygon of a hundred places a step.
_WAY = f"""{EV.replace('WITH e', 'WITH RECURSIVE e', 1)}, p AS (SELECT track_id, seq, v, 6371000.0 * radians(lon - first_value(lon) OVER {W}) * cos(radians(avg(lat) OVER (PARTITION BY track_id))) AS x, 6371000.0 * radians(lat - first_value(lat) OVER {W}) AS y, count(*) OVER (PARTITION BY track_id) AS n FROM e),
q AS (SELECT *, 6 * (lead(x) OVER {W} - 2 * x + lag(x) OVER {W}) AS rx, 6 * (lead(y) OVER {W} - 2 * y + lag(y) OVER {W}) AS ry FROM p),
f AS (SELECT track_id, 1::BIGINT AS seq, 0.0::DOUBLE AS c, 0.0::DOUBLE AS dx, 0.0::DOUBLE AS dy FROM q WHERE seq = 1 UNION ALL SELECT q.track_id, q.seq, 1 / (4 - c), (rx - dx) / (4 - c), (ry - dy) / (4 - c) FROM f JOIN q ON q.track_id = f.track_id AND q.seq = f.seq + 1 WHERE q.seq < n),
g AS (SELECT track_id, seq, 0.0::DOUBLE AS mx, 0.0::DOUBLE AS my FROM q WHERE seq = n UNION ALL SELECT g.track_id, g.seq - 1, CASE WHEN g.seq = 2 THEN 0 ELSE dx - c * mx END, CASE WHEN g.seq = 2 THEN 0 ELSE dy - c * my END FROM g JOIN f ON f.track_id = g.track_id AND f.seq = g.seq - 1),
h AS (SELECT track_id, seq, v, x, y, mx, my, lead(x) OVER {W} AS x1, lead(y) OVER {W} AS y1, lead(mx) OVER {W} AS mx1, lead(my) OVER {W} AS my1, lead(v) OVER {W} AS v1 FROM q JOIN g USING (track_id, seq)),
u AS (SELECT track_id, seq, j, {{0}} AS sx, {{1}} AS sy FROM (SELECT *, unnest(range(0, 100)) AS j, unnest(range(0, 100)) / 99 AS t FROM h WHERE x1 IS NOT NULL)),
w AS (SELECT track_id, seq, sum(d) AS ds FROM (SELECT track_id, seq, sqrt(pow(sx - lag(sx) OVER z, 2) + pow(sy - lag(sy) OVER z, 2)) AS d FROM u WINDOW z AS (PARTITION BY track_id, seq ORDER BY j)) GROUP BY ALL),
o AS (SELECT track_id, seq, radians(v1 - v) AS turn, radians(v1 - v) - lag(radians(v1 - v)) OVER {W} AS dd FROM h WHERE v1 IS NOT NULL),
k AS (SELECT track_id, seq, turn + coalesce(sum(CASE WHEN abs(dd) < pi() THEN 0 ELSE ((dd + pi()) % (2 * pi()) + 2 * pi()) % (2 * pi()) - pi() - dd END) OVER (PARTITION BY track_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 0) AS turn FROM o)""".format(
    *[f"(m{a} * pow(1 - t, 3) + m{a}1 * pow(t, 3)) / 6 + ({a} - m{a} / 6) * (1 - t) + ({a}1 - m{a}1 / 6) * t" for a in "xy"])


@query(f"""{_WAY} SELECT h.track_id, h.seq, round(ds, 2) AS spline_distance, round(CASE WHEN ds > 0 THEN turn / ds WHEN ds = 0 THEN 0 END, 5) AS curvature_spline FROM h LEFT JOIN w ON w.track_id = h.track_id AND w.seq = h.seq LEFT JOIN k ON k.track_id = h.track_id AND k.seq = h.seq""")
def spline_curvature(spark, sf):
    return sequential.spline_curvature(tracks(spark, sf).withColumn("yaw", F.col("v")), T, "lat", "lon", "yaw").select(*KEY, r("spline_distance", 2), r("curvature_spline", 5))


# Whole plans and products


@query()
def daily_pipeline(spark, sf):
    d = tracks(spark, sf).withColumn("speed", F.col("v") / 10)
    d = daily.run(d, lat="lat", lon="lon")
    return d.select(*KEY, "segment_marker", r("x", 2), r("y", 2), r("cumulative_distance_m", 2), "segment_type", "segment_id", F.array_join("steps", ",").alias("steps"))


@query(f"""{EV}, d AS (SELECT *, ({_HAV}) / nullif((epoch_us(ts) - epoch_us(lag(ts) OVER {W})) / 1e6, 0) AS speed FROM e), f AS (SELECT track_id, seq, lat, lon FROM d WHERE speed IS NULL OR speed < 0.5),
c AS (SELECT f.lat, f.lon FROM f JOIN f o ON sqrt(pow(f.lat - o.lat, 2) + pow(f.lon - o.lon, 2)) <= 2000.0 / 111000 GROUP BY f.track_id, f.seq, f.lat, f.lon HAVING count(*) >= 4)
SELECT DISTINCT f.track_id, f.seq FROM f JOIN c ON sqrt(pow(f.lat - c.lat, 2) + pow(f.lon - c.lon, 2)) <= 2000.0 / 111000""")
def outliers_removed(spark, sf):
    return daily.without_outliers(tracks(spark, sf), daily.Config(lat="lat", lon="lon"), "event_id", most_speed=0.5, eps_m=2000.0, least=4).select(*KEY)


@query(f"{EV} SELECT track_id, ts, signal, value FROM (SELECT track_id, ts, 'lat' AS signal, lat AS value FROM e UNION ALL SELECT track_id, ts, 'v', v FROM e)")
def chart_signals(spark, sf):
    return products.signals(tracks(spark, sf), T, "ts", "lat", "v")


@query(f"{EV} SELECT track_id, arg_min(lat, seq) AS first_lat, arg_min(lon, seq) AS first_lon, arg_max(lat, seq) AS last_lat, arg_max(lon, seq) AS last_lon FROM e GROUP BY 1")
def ends_layer(spark, sf):
    return products.ends_layer(tracks(spark, sf), T, "lat", "lon")


@query(f"{EV}, l AS (SELECT *, kind = 'error' AS b, lag(kind = 'error') OVER {W} AS lag_ FROM e), g AS (SELECT *, {_RUN.format('b')} AS run FROM l), m AS (SELECT *, row_number() OVER (PARTITION BY track_id, run ORDER BY seq) AS i, count(*) OVER (PARTITION BY track_id, run) AS n FROM g WHERE b) SELECT track_id, seq FROM m WHERE i = n // 2 + 1")
def blocked_layer(spark, sf):
    return products.blocked_layer(tracks(spark, sf).withColumn("gps_blocked", F.col("kind") == "error"), T).select(*KEY)


@query(f"""{_FULL}, h AS (SELECT *, lag(mean_radius) OVER {W} AS lag_r FROM a), q AS (SELECT *, sum(CASE WHEN lag_r IS NOT DISTINCT FROM mean_radius AND seq > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY track_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM h)
SELECT track_id, round(median(x), 3) AS x, round(median(y), 3) AS y, round(any_value(mean_radius), 2) AS mean_radius FROM q WHERE abs(mean_radius) BETWEEN 400 AND 30000 AND segment_type = 'steady_curve' GROUP BY track_id, run""")
def radius_markers(spark, sf):
    d = segmentation.segment(_curved(spark, sf), T, "k", "s", tie_fix=False)
    return products.radius_markers(d, T).select("track_id", r("x", 3), r("y", 3), r("mean_radius", 2))


@query(f"{PL} SELECT track_id, seq, x, y, round(10 * cos(radians(90 - h)), 6) + 0.0 AS dx, round(10 * sin(radians(90 - h)), 6) + 0.0 AS dy FROM p WHERE (seq - 1) % 20 = 0")
def heading_quiver(spark, sf):
    return products.quiver(planar(spark, sf), T, "h").select(*KEY, "x", "y", r("dx"), r("dy"))


@query(f"""{PL}, k AS (SELECT track_id, s AS x, avg(t) AS y FROM p GROUP BY ALL), q AS (SELECT track_id, unnest(range(0, floor(max(s))::BIGINT + 1, 500))::DOUBLE AS x FROM p GROUP BY track_id),
l AS (SELECT q.*, (SELECT max(x) FROM k WHERE k.track_id = q.track_id AND k.x <= q.x) AS xa, (SELECT min(x) FROM k WHERE k.track_id = q.track_id AND k.x >= q.x) AS xb FROM q)
SELECT l.track_id, l.x AS cumulative_distance_m, round(coalesce(u.y + (w.y - u.y) * (l.x - xa) / nullif(xb - xa, 0), u.y, w.y), 3) AS time FROM l LEFT JOIN k u ON u.track_id = l.track_id AND u.x = xa LEFT JOIN k w ON w.track_id = l.track_id AND w.x = xb""")
def time_ticks(spark, sf):
    d = planar(spark, sf).withColumnRenamed("t", "time").withColumn("cumulative_distance_m", F.col("s"))
    ticks = d.groupBy("track_id").agg(F.max("s").alias("m")).select("track_id", F.explode(F.transform(F.sequence(F.lit(0), F.floor("m").cast("int"), F.lit(500)), lambda k: k.cast("double"))).alias("cumulative_distance_m"))
    return products.time_ticks(d, ticks, T, time="time").select("track_id", "cumulative_distance_m", r("time", 3))
