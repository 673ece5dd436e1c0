"""Operators on small tracks made by hand, against plain formulas."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from trackforge.core import Track, nan_to_null
from trackforge.functions import geo, numeric, orientation
from trackforge.operators import filters, kinematics, profile, resample, segmentation, sequential, smoothing, spatial
from trackforge.plans import daily

T = Track()


def track(spark, rows, names, one="a"):
    return spark.createDataFrame([(one, i + 1, *r) for i, r in enumerate(rows)], ["track_id", "seq", *names])


def column(df, name):
    return [r[name] for r in df.orderBy("track_id", "seq").collect()]


def circle(spark, radius, n=60, step=1.0, turn=1):
    a = np.arange(n) * step / radius
    rows = [(float(radius * (1 - math.cos(x)) * turn), float(radius * math.sin(x)), float(radius * x)) for x in a]
    return track(spark, rows, ["x", "y", "s"])


@pytest.mark.parametrize("turn", [1, -1])
def test_circle_has_the_curvature_of_its_radius(spark, turn):
    d = kinematics.heading_ds(circle(spark, 500.0, turn=turn), T, s="s", to="h")
    d = kinematics.curvature_and_radius(d, T, ["h"], "s")
    k = column(d, "curvature_h")[3:-3]
    assert np.allclose(k, turn / 500.0, rtol=1e-3)
    assert np.allclose(column(d, "radius_m_h")[3:-3], turn * 500.0, rtol=1e-3)


def test_straight_line_has_no_curvature(spark):
    d = track(spark, [(float(i), 2.0 * i, math.sqrt(5) * i) for i in range(12)], ["x", "y", "s"])
    d = kinematics.heading_dx_dy(d, T, to="h")
    h = column(d, "h")
    assert h[:3] == [None] * 3 and h[-3:] == [None] * 3
    assert np.allclose(h[3:-3], math.degrees(math.atan2(1, 2)))
    k = kinematics.curvature_and_radius(d, T, ["h"], "s")
    assert column(k, "curvature_h")[5] == 0 and column(k, "radius_m_h")[5] == math.inf


def test_clothoid_is_a_transition(spark):
    d = track(spark, [(1e-3 + 2e-5 * i, float(i)) for i in range(30)], ["k", "s"])
    kinds = column(segmentation.segment(d, T, "k", "s"), "segment_type")
    assert set(kinds[1:-1]) == {"transition"}
    flat = track(spark, [(0.002, float(i)) for i in range(30)] + [(0.0, 30.0 + i) for i in range(30)], ["k", "s"])
    out = segmentation.segment(flat, T, "k", "s")
    assert column(out, "segment_type")[5] == "steady_curve" and column(out, "segment_type")[45] == "straight"
    assert column(out, "mean_radius")[45] == math.inf


def test_gradient_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x = np.cumsum(rng.random(40) + 0.1)
    y = rng.random(40)
    d = track(spark, [(float(a), float(b)) for a, b in zip(x, y)], ["x", "y"]).withColumn("g", kinematics.gradient_of(T, F.col("y"), F.col("x")))
    assert np.allclose(column(d, "g"), np.gradient(y, x), atol=1e-9)


def test_ties_become_strictly_increasing(spark):
    s = column(kinematics.strictly_increasing(track(spark, [(1.0,), (1.0,), (1.0,), (2.0,)], ["s"]), T, "s"), "s")
    assert all(b > a for a, b in zip(s, s[1:])) and abs(s[1] - 1 - 1e-6) < 1e-9


def test_wrapping(spark):
    d = spark.createDataFrame([(-190.0,), (180.0,), (-180.0,), (359.0,)], ["d"])
    assert [r[0] for r in d.select(numeric.wrap_deg(F.col("d"))).collect()] == [170.0, -180.0, -180.0, -1.0]


def test_yaw_rate_at_stops_and_after(spark):
    rows = [(0.0, 350.0, "MOVING_1"), (1.0, 10.0, "STOP_START"), (1.0, 30.0, "STOP_END"), (2.0, 40.0, "STOP_START"), (3.0, 50.0, "MOVING_1")]
    d = kinematics.yaw_rate(track(spark, rows, ["elapsed_time_s", "h", "segment_marker"]), T, ["h"])
    assert column(d, "seq") == [1, 2, 3, 5]
    assert column(d, "yaw_rate_from_h") == [None, 0.0, 0.0, 10.0]


def test_division_rules(spark):
    d = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (4.0, 2.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in d.select(numeric.ieee_div(F.col("a"), F.col("b"))).collect()] == [math.inf, -math.inf, None, 2.0, None]


def test_nan_is_null_on_the_way_in(spark):
    d = nan_to_null(spark.createDataFrame([(float("nan"), 1), (math.inf, 2)], "a double, b long"))
    assert [r.a for r in d.orderBy("b").collect()] == [None, math.inf]


def test_utm_and_geodesic(spark):
    d = spark.createDataFrame([(11.0, 51.0, 32), (9.0, 0.0, 32), (-70.0, -33.0, 19)], "lon double, lat double, z int")
    x, y = geo.to_utm(F.col("lon"), F.col("lat"), F.col("z"), F.col("lat") >= 0)
    got = d.select(x, y).collect()
    assert abs(got[1][0] - 500_000) < 1e-6 and abs(got[1][1]) < 1e-6
    assert abs(got[0][0] - 640_336.0) < 100 and 5_650_000 < got[0][1] < 5_653_000
    assert 6_300_000 < got[2][1] < 6_400_000
    m = geo.geodesic(*(np.array([v]) for v in (0.0, 0.0, 0.0, 1.0)))
    assert abs(m[0] - 111_319.4908) < 1e-3
    m = geo.geodesic(*(np.array([v]) for v in (51.0, 11.0, 51.0, 11.0)))
    assert m[0] == 0
    back = d.select(*geo.from_mercator(*geo.to_mercator(F.col("lon"), F.col("lat")))).collect()
    assert all(abs(a[0] - b[0]) < 1e-9 and abs(a[1] - b[1]) < 1e-9 for a, b in zip(back, [(11.0, 51.0), (9.0, 0.0), (-70.0, -33.0)]))


def test_one_zone_per_track(spark):
    d = kinematics.to_planar(track(spark, [(51.0, 11.9), (51.0, 12.3)], ["GPS_lat", "GPS_lon"]), T)
    assert set(column(d, "projection_epsg")) == {"EPSG:32633"}
    assert kinematics.smoothing_method("GPS_lat_smoothed_kalman") == "kalman" and kinematics.smoothing_method("GPS_lat") == "raw"


def test_savgol_equals_a_polynomial_fit(spark):
    v = [1.0, 4.0, 2.0, 8.0, 5.0, 7.0, 1.0, 0.0]
    got = column(smoothing.savgol(track(spark, [(x,) for x in v], ["v"]), T, "v", 5, 2), "v_savgol")
    for i in range(8):
        a = min(max(i - 2, 0), 3)
        want = np.polyval(np.polyfit(np.arange(5), v[a : a + 5], 2), i - a)
        assert abs(got[i] - want) < 1e-9
    assert column(smoothing.savgol(track(spark, [(1.0,), (2.0,)], ["v"]), T, "v"), "v_savgol") == [None, None]


def test_gaussian_mirrors_the_ends(spark):
    v = np.random.default_rng(0).random(9)
    got = column(smoothing.gaussian(track(spark, [(float(x),) for x in v], ["v"]), T, "v"), "v_smoothed_gaussian")
    w = np.exp(-0.5 * (np.arange(-8, 9) / 2.0) ** 2)
    pad = np.pad(v, 8, mode="symmetric")
    assert np.allclose(got, np.convolve(pad, w / w.sum(), "valid"))


def test_interpolation_and_asof(spark):
    d = track(spark, [(None,), (1.0,), (None,), (None,), (4.0,), (None,)], ["v"])
    assert column(smoothing.interpolate(d, T, "v"), "v") == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]
    known = spark.createDataFrame([("a", 0.0, 10.0), ("a", 10.0, 20.0)], "track_id string, x double, y double")
    asked = spark.createDataFrame([("a", -1.0, 1), ("a", 2.5, 2), ("a", 10.0, 3), ("a", 99.0, 4), ("b", 1.0, 5)], "track_id string, x double, i int")
    got = {r.i: r.y for r in resample.asof_interpolate(known, asked, "track_id", "x", "y").collect()}
    assert got == {1: 10.0, 2: 12.5, 3: 20.0, 4: 20.0, 5: None}


def test_runs(spark):
    d = track(spark, [("x",), ("x",), (None,), (None,), ("x",)], ["k"])
    assert column(segmentation.run_id(d, T, "k"), "segment_id") == [1, 1, 2, 2, 3]
    assert column(segmentation.run_id(d, T, "k", null_breaks=True), "segment_id") == [1, 1, 2, 3, 4]
    assert column(segmentation.middle_rows(segmentation.run_id(d, T, "k"), T, "segment_id"), "seq") == [2, 4, 5]


def test_quantile_trim(spark):
    d = spark.createDataFrame([(float(i),) for i in range(101)] + [(None,)], "v double")
    assert filters.quantile_trim(d, "v", 0.1, 0.9).count() == 81


def test_column_choice():
    c = ["GPS_lat", "GPS_lon", "GPS_lat_smoothed_kalman", "GPS_lon_smoothed_kalman", "heading_a", "yaw_rate_from_heading_a"]
    assert filters.choose_position(c) == ("GPS_lat", "GPS_lon")
    assert filters.choose_position(c, "none") == ("GPS_lat", "GPS_lon")
    assert filters.choose_position(c, "kalman")[0] == "GPS_lat_smoothed_kalman"
    assert filters.heading_columns(c) == ["heading_a"]
    with pytest.raises(KeyError):
        filters.choose_position(c, "particule")


def test_stop_and_go(spark):
    speed = [0.0] * 20 + [12.0] * 20 + [0.0] * 20
    d = track(spark, [(float(i), 51.0 + i * 1e-5, 11.0, v) for i, v in enumerate(speed)], ["elapsed_time_s", "GPS_lat", "GPS_lon", "speed"])
    out = sequential.stop_move(d, T)
    rows = out.collect()
    marks = [r.segment_marker for r in sorted(rows, key=lambda r: (r.seq, r.segment_marker == "STOP_END"))]
    assert marks.count("STOP_START") == marks.count("STOP_END") >= 2
    assert any(m.startswith("MOVING_3") for m in marks)
    cut = sequential.pieces(np.arange(60.0), np.array(speed))
    assert cut[0][0] == 0 and cut[-1][1] == 60 and all(a[1] == b[0] for a, b in zip(cut, cut[1:]))
    assert len(rows) == sum(2 if s else 1 for *_, s in sequential.pieces(np.arange(60.0), np.array(column(smoothing.rolling_mean(d, T, "speed"), "speed_smoothed"))))


def test_speed_classes():
    assert [sequential.speed_class(v, (0, 0.5, 5)) for v in (0.0, 0.5, 5.0, -1.0, float("nan"))] == [0, 1, 2, 2, 2]


def test_change_points_are_the_best_ones():
    rng = np.random.default_rng(3)
    v = np.concatenate([np.zeros(10), np.ones(10) * 3, np.ones(10)]) + rng.normal(0, 0.1, 30)
    got = sequential.change_points(v, 0.5, jump=1)

    def cost(cuts):
        a, total = 0, 0.0
        for b in cuts:
            total += ((v[a:b] - v[a:b].mean()) ** 2).sum() + 0.5
            a = b
        return total

    best = min(([*c, 30] for c in [[], *[[i] for i in range(2, 29)], *[[i, j] for i in range(2, 27) for j in range(i + 2, 29)]]), key=cost)
    assert got == best == [10, 20, 30]


def test_circle_fit_far_from_the_origin():
    a = np.linspace(0, 0.02, 20)
    r, res = sequential.fit_circles(650_000 + 1000 * np.cos(a), 5_600_000 + 1000 * np.sin(a), 20)
    assert abs(r[0] - 1000) < 1 and res[0] < 1e-3


def test_steady_runs_and_kalman():
    assert sequential.steady_runs(np.array([1, 1, 1, 9, 9, 9, 5.0]), 0.1, 3).tolist() == [1, 1, 1, 2, 2, 2, 0]
    assert sequential.steady_runs(np.array([]), 0.1, 3).tolist() == []
    assert np.allclose(sequential.kalman_1d(np.full(5, 3.0)), 3.0)
    assert sequential.moving_state(np.arange(6.0), np.array([0, 5, 5, 5, 5, 5.0]), 1, 0.5, 2).tolist() == [False, False, False, True, True, True]


def test_spline_is_exact_on_lines():
    f = sequential.cubic_spline(np.arange(4.0), np.column_stack([np.arange(4.0) * 2, np.arange(4.0)]))
    assert np.allclose(f(np.array([0.5, 2.25])), [[1.0, 0.5], [4.5, 2.25]])


@pytest.mark.parametrize("radius", [5.0, 40.0])
def test_grid_join_equals_brute_force(spark, radius):
    rng = np.random.default_rng(5)
    p, q = rng.random((80, 2)) * 200 - 100, rng.random((40, 4)) * 200 - 100
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "p long, x double, y double")
    segs = spark.createDataFrame([(i, 0, *map(float, r)) for i, r in enumerate(q)], "q long, n int, ax double, ay double, bx double, by double")

    def dist(a, s):
        d = np.array([s[2] - s[0], s[3] - s[1]])
        u = np.clip(np.dot(a - s[:2], d) / np.dot(d, d), 0, 1)
        return np.hypot(*(a - s[:2] - u * d))

    want = {(i, j) for i in range(80) for j in range(40) if dist(p[i], q[j]) <= radius}
    got = spatial.near_pairs(points, segs, radius, "p", "q")
    assert {(r.p, r.q) for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    near = {r.p: r.q for r in spatial.nearest(points, segs, "p", "q", radius).collect()}
    assert near == {i: int(np.argmin([dist(p[i], s) for s in q])) for i in range(80)}
    blocked = {r.p: r.gps_blocked for r in spatial.flag_near(points, segs, radius, "p").collect()}
    assert blocked == {i: any((i, j) in want for j in range(40)) for i in range(80)}


def test_lines_near_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    a, b = rng.random((30, 4)) * 100, rng.random((30, 4)) * 100
    make = lambda v, k: spark.createDataFrame([(i, 0, *map(float, r)) for i, r in enumerate(v)], f"{k} long, n int, ax double, ay double, bx double, by double")
    pairs = [(r.a_i, r.b_j) for r in spatial.lines_near(make(a, "i"), make(b, "j"), 3.0, "i", "j").collect()]
    u = np.linspace(0, 1, 400)
    close = set()
    for i in range(30):
        pa = np.column_stack([a[i, 0] + u * (a[i, 2] - a[i, 0]), a[i, 1] + u * (a[i, 3] - a[i, 1])])
        for j in range(30):
            pb = np.column_stack([b[j, 0] + u * (b[j, 2] - b[j, 0]), b[j, 1] + u * (b[j, 3] - b[j, 1])])
            if np.hypot(pa[:, None, 0] - pb[None, :, 0], pa[:, None, 1] - pb[None, :, 1]).min() <= 2.9:
                close.add((i, j))
    assert len(pairs) == len(set(pairs)) and close <= set(pairs)


def test_noise(spark):
    rows = [(i, 0.1 * i, 0.0) for i in range(5)] + [(9, 50.0, 50.0), (10, 0.65, 0.0)]
    d = spark.createDataFrame(rows, "i long, x double, y double")
    assert sorted(r.i for r in spatial.without_noise(d, "i", "x", "y", 0.3, 4).collect()) == [0, 1, 2, 3, 4, 10]


@pytest.mark.parametrize("n", [0, 1, 2, 6])
def test_short_tracks(spark, n):
    rows = [(float(i), 51.0 + i * 1e-4, 11.0, 1.0, float(i), 0.0) for i in range(n)]
    d = spark.createDataFrame([("a", i + 1, *r) for i, r in enumerate(rows)], "track_id string, seq int, elapsed_time_s double, GPS_lat double, GPS_lon double, speed double, x double, y double")
    for f in (lambda d: kinematics.traveled_distance(d, T), lambda d: sequential.stop_move(d, T), lambda d: sequential.circle_fit(d, T), lambda d: sequential.spline_curvature(d, T, "GPS_lat", "GPS_lon", "speed"), lambda d: segmentation.segment(d, T, "speed", "x"), lambda d: sequential.segment_piecewise(d, T, "speed", "x"), lambda d: sequential.segment_change_points(d, T, "speed"), lambda d: sequential.particle_filter(d, T, "GPS_lat", "GPS_lon", "speed", particles=10)):
        assert f(d).count() >= 0


def test_piecewise_breaks_of_long_tracks():
    """Every row can be a break, however long the track."""
    x = np.arange(3000.0)
    y = np.where(x < 1003, 0.0, np.where(x < 1018, 2.0, -0.001 * x))
    assert sequential.best_pieces(x, y, 3) == [0, 1003, 1018, 3000]
    rng = np.random.default_rng(5)
    x = np.cumsum(rng.uniform(0.5, 2, 450))
    y = np.where(x < x[211], 0.01 * x, 3.0) + rng.normal(0, 0.3, 450)

    def error(i, j):
        return ((y[i:j] - np.polyval(np.polyfit(x[i:j], y[i:j], 1), x[i:j])) ** 2).sum() if j - i > 2 else 0.0

    best = min(error(0, i) + error(i, 450) for i in range(1, 450))
    cuts = sequential.best_pieces(x, y, 2)
    assert np.isclose(sum(error(i, j) for i, j in zip(cuts, cuts[1:])), best)
    y = rng.normal(0, 1, 450)  # without any line, too
    best = min(error(0, i) + error(i, 450) for i in range(1, 450))
    cuts = sequential.best_pieces(x, y, 2)
    assert np.isclose(sum(error(i, j) for i, j in zip(cuts, cuts[1:])), best)


def test_queries_run_at_the_operators_own_size(monkeypatch):
    from trackforge import queries

    given = {}
    frame = type("Frame", (), {"select": lambda self, *c: self, "withColumn": lambda self, *c: self})()
    monkeypatch.setattr(queries, "tracks", lambda *a: frame)
    monkeypatch.setattr(queries, "r", lambda *a: None)
    monkeypatch.setattr(queries.F, "col", lambda *a: 0)
    monkeypatch.setattr(kinematics, "elapsed_time", lambda d, t: d)
    for name in ("particle_filter", "spline_curvature"):
        monkeypatch.setattr(sequential, name, lambda *a, name=name, **k: given.setdefault(name, k) and frame or frame)
        queries.QUERIES[name](None, None)
    assert given == {"particle_filter": {}, "spline_curvature": {}}


def test_steady_runs_are_those_of_a_plain_version():
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 60, 200):
        for _ in range(30):
            v = np.cumsum(rng.normal(size=n)) * rng.choice([0.01, 1.0])
            v[rng.random(n) < 0.15] = np.nan
            want, number, start = np.zeros(n, int), 0, 0
            for i in range(n):
                own = v[start : i + 1]
                own = own[~np.isnan(own)]
                if len(own) and own.std() <= 0.3 + 1e-12:
                    continue
                if i - start >= 3:
                    number += 1
                    want[start:i] = number
                start = i
            if n - start >= 3 and not np.isnan(v[start:]).all():
                want[start:] = number + 1
            assert sequential.steady_runs(v, 0.3, 3).tolist() == want.tolist()


def test_circles_are_those_of_least_squares():
    rng = np.random.default_rng(4)
    x, y = np.cumsum(rng.normal(3, 1, 80)), np.cumsum(rng.normal(0, 1, 80))
    r, res = sequential.fit_circles(x, y, 9)
    for i in range(72):
        u, v = x[i : i + 9], y[i : i + 9]
        a, b, c = np.linalg.lstsq(np.column_stack([u, v, np.ones(9)]), u * u + v * v, rcond=None)[0]
        want = np.sqrt(c + a * a / 4 + b * b / 4)
        assert np.isclose(r[i], want) and np.isclose(res[i], np.abs(np.hypot(u - a / 2, v - b / 2) - want).mean())


def test_spline_solves_its_whole_system():
    rng = np.random.default_rng(5)
    for n in (2, 3, 4, 50):
        t, y = np.cumsum(rng.uniform(0.5, 2, n)), rng.normal(size=(n, 2))
        f, h = sequential.cubic_spline(t, y), 1e-4
        assert np.allclose(f(t), y)
        bend = lambda q: (f(q + h) - 2 * f(q) + f(q - h)) / h**2
        assert np.allclose(bend(t[:1] + h), 0, atol=0.05) and np.allclose(bend(t[-1:] - h), 0, atol=0.05)
        inner = t[1:-1]
        slope = lambda q, s: (f(q + s * h) - f(q)) / (s * h)
        assert np.allclose(slope(inner, 1), slope(inner, -1), atol=0.02)


def test_failing_track_is_left_out(spark):
    d = spark.createDataFrame([(t, i, float(i), t) for t in ("a", "b") for i in range(4)], "track_id string, seq int, x double, kind string")

    def kernel(c):
        if c["x"].sum() and c["bad"][0]:
            raise ValueError("no")
        return None, {"y": c["x"] + 1}

    d = d.withColumn("bad", (F.col("track_id") == "b").cast("int"))
    out = sequential.per_track(d, Track(), ["x", "bad"], kernel, [("y", T_.DoubleType())], skip_failing=True)
    assert [(r.track_id, r.y) for r in out.orderBy("seq").collect()] == [("a", i + 1.0) for i in range(4)]
    with pytest.raises(Exception, match="no"):
        sequential.per_track(d, Track(), ["x", "bad"], kernel, [("y", T_.DoubleType())]).collect()


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(6)
    a, b = np.round(rng.normal(size=3000) * 10.0 ** rng.integers(-9, 9, 3000), 12), rng.integers(0, 4, 3000) * 1.0
    d = spark.createDataFrame([(float(x), float(y), None, float("inf") if i % 2 else float("nan")) for i, (x, y) in enumerate(zip(a, b, strict=True))], "a double, b double, c double, d double")
    q = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = profile.quantiles(d, {"a": q, "b": q, "c": [0.5], "d": [0.5]})
    assert np.allclose(got["a"], np.quantile(a, q), rtol=1e-12) and np.allclose(got["b"], np.quantile(b, q)) and got["c"] == got["d"] == [None]


def test_quantiles_take_six_passes_whatever_the_values(spark, monkeypatch):
    rng = np.random.default_rng(8)
    v = np.concatenate([2.0 ** np.arange(-600, 600), -(2.0 ** np.arange(-1074, 900, 3)), 1 + rng.random(900) * 2.0**-40, [0.0, 5e-324, -5e-324, 1.7e308, -1.7e308]])
    d = spark.createDataFrame([(float(x),) for x in rng.permutation(v)], "v double")
    passes, real = [], profile._histogram
    monkeypatch.setattr(profile, "_histogram", lambda *a: passes.append(1) or real(*a))
    q = [0.0, 0.01, 0.25, 0.4, 0.5, 0.75, 0.99, 1.0]
    got = profile.quantiles(d, {"v": q})["v"]
    s = np.sort(v)
    low, high = (s[f((len(s) - 1) * np.array(q)).astype(int)] for f in (np.floor, np.ceil))
    assert len(passes) <= 6 and all(a <= x <= b for a, x, b in zip(low, got, high, strict=True))
    exact = profile.quantiles(d, {"v": [k / (len(v) - 1) for k in range(0, len(v), 97)]})["v"]
    assert all(x in s[k : k + 2] or x in s[max(k - 1, 0) : k + 1] or abs(x - s[k]) <= 1e-9 * abs(s[k]) for x, k in zip(exact, range(0, len(v), 97), strict=True))


def test_meeting_places_of_lines(spark):
    line = "id string, geometry array<struct<x: double, y: double>>"
    a = spark.createDataFrame([("a", [(0.0, 0.0), (10.0, 0.0), (20.0, 0.0)])], line)
    b = spark.createDataFrame([("share", [(5.0, 0.0), (15.0, 0.0)]), ("cross", [(4.0, -5.0), (4.0, 5.0)]), ("vertex", [(10.0, -5.0), (10.0, 5.0)]), ("twice", [(2.0, -1.0), (2.0, 1.0), (6.0, 1.0), (6.0, -1.0)]), ("far", [(0.0, 3.0), (9.0, 3.0)])], line)
    pairs = spatial.lines_near(spatial.segments(a), spatial.segments(b), 5.0, "id", "id")
    pairs = pairs.withColumnsRenamed({"a_id": "a_p", "b_id": "b_q"})
    got = {r.q: (r.position, r.x, r.y) for r in spatial.by_parallelism(pairs, "p", "q").collect()}
    assert got == {"share": ("on", 10.0, 0.0), "cross": ("under", 4.0, 0.0), "vertex": ("under", 10.0, 0.0), "twice": ("under", 4.0, 0.0), "far": ("unknown", None, None)}


def test_a_place_without_numbers_has_no_line(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0), (3, float("nan"), 1.0), (4, float("inf"), 0.0)], "p int, x double, y double")
    s = spark.createDataFrame([(9, 0, 1.0, 0.0, 2.0, 0.0)], "q int, n int, ax double, ay double, bx double, by double")
    assert [(r.p, r.q, r.distance) for r in spatial.nearest(p, s, "p", "q", 0.1).collect()] == [(1, 9, 1.0)]


def test_daily_files_are_named_by_track_and_steps(spark, tmp_path):
    rows = [("d1", i, f"2024-01-01 00:00:{i:02d}.000000" if i != 3 else "never", 51 + i / 1e4, 11.0, 3.0) for i in range(30)]
    d = spark.createDataFrame(rows, "track_id string, seq int, ts string, lat double, lon double, speed double")
    c = daily.Config(lat="lat", lon="lon", steps=("time", "planar", "distance"), exact_distance=False)
    out = daily.run(d, c)
    assert out.count() == 29
    daily.save(out, str(tmp_path / "out"), c)
    assert [p.name for p in (tmp_path / "out").iterdir() if p.is_dir()] == ["file=d1_time_planar_distance"]


@pytest.mark.parametrize("ties", [False, True])
def test_nearest_from_far_away(spark, ties):
    rng = np.random.default_rng(9)
    ends = rng.uniform(-3000, 3000, (300, 2)).round()
    ends = np.concatenate([ends, ends + rng.uniform(-90, 90, (300, 2)).round()], 1)
    ends = np.concatenate([ends, ends[:3]])
    places = np.concatenate([rng.uniform(-3000, 3000, (60, 2)), rng.uniform(-9, 9, (5, 2)) * 1e5, [[0, 0], [0, 0], [7e6, -7e6], [2e8, 0]]])
    s = spark.createDataFrame([(i, *map(float, e)) for i, e in enumerate(ends)], "q int, ax double, ay double, bx double, by double")
    p = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(places)], "p int, x double, y double")
    want = []
    for i, (x, y) in enumerate(places):
        a, way = ends[:, :2], ends[:, 2:] - ends[:, :2]
        n = (way**2).sum(1)
        u = np.clip((([x, y] - a) * way).sum(1) / np.where(n > 0, n, 1), 0, 1)
        d = np.hypot(*(np.array([x, y]) - a - u[:, None] * way).T)
        if d.min() <= 1e8:
            best = np.flatnonzero(d <= d.min() * (1 + 1e-14))
            want += [(i, int(k), round(d.min(), 3)) for k in (best if ties else best[:1])]
    for radius in (20.0, 1e4):
        got = sorted((r.p, r.q, round(r.distance, 3)) for r in spatial.nearest(p, s, "p", "q", radius, ties=ties).collect())
        assert got == want
    assert spatial.nearest(p, s.limit(0), "p", "q", 20.0, ties=ties).count() == 0


def test_spline_slopes_and_angles_of_many_lines():
    at = np.linspace(0, 6, 7)
    for c in ([1, 0, 0, 0], [0.3, -2, 1, 4], [-0.1, 0.5, 0, 1]):  # a cubic is its own spline
        for u in (0.0, 0.4, 3.0, 5.9, 6.0):
            assert np.isclose(orientation.slope_weights(np.array([u]))[0] @ np.polyval(c, at), np.polyval(np.polyder(c), u))
    lines = [[(0, 0), (50, 0)], [(0, 0), (0, 40), (0, 40), (0, 90)], [(1, 1), (1, 1)], [(0, 0)], [], [(0, 0), (-30, -30)], [(0, 0), (1, 1)]]
    offsets = np.concatenate([[0], np.cumsum([len(g) for g in lines])])
    flat = np.array([p for g in lines for p in g], float)
    got = orientation.angles(flat[:, 0], flat[:, 1], offsets, np.array([3.0, 5, 1, 0, 0, -2, np.nan]), np.zeros(7))
    assert np.allclose(got, [0, 90, np.nan, np.nan, np.nan, 45, np.nan], equal_nan=True)


def test_noise_of_a_standing_train(spark):
    rng = np.random.default_rng(3)
    places = np.concatenate([rng.normal(size=(300, 2)) * 0.2, rng.uniform(-9, 9, (150, 2)), np.repeat([[50.0, 50.0]], 4, 0), [[51.0, 50.0], [60.0, 60.0]]])
    d = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(places)], "i int, x double, y double")
    for eps, least in ((1.0, 4), (0.5, 3), (1.0, 1)):
        near = np.hypot(*(places[:, None] - places[None]).transpose(2, 0, 1)) <= eps
        core = near.sum(1) >= least
        want = {i for i in range(len(places)) if core[i] or (near[i] & core).any()}
        assert {r.i for r in spatial.without_noise(d, "i", "x", "y", eps, least).collect()} == want


def test_joined_pieces_are_the_best(spark):
    import itertools

    rng = np.random.default_rng(12)
    for n, count in ((2, 1), (9, 1), (11, 2), (12, 3), (13, 4), (5, 9)):
        x = np.cumsum(rng.choice([0.0, 1.0, 2.5], n, p=[0.2, 0.4, 0.4])) + 1e4
        y = np.cumsum(rng.normal(size=n))
        places = np.unique(x)
        best = (np.inf, None)
        k = min(count, len(places) - 1)
        for inner in itertools.combinations(range(1, len(places) - 1), max(k - 1, 0)):
            knots = places[[0, *inner, len(places) - 1]] if k else places
            base = np.stack([np.interp(x, knots, np.eye(len(knots))[i]) for i in range(len(knots))], 1)
            fit = np.linalg.lstsq(base, y, rcond=None)[0]
            best = min(best, (float(((base @ fit - y) ** 2).sum()), tuple(knots), tuple(fit)), key=lambda b: b[0])
        kx, ky, error = sequential.joined_pieces(x, y, count)
        assert np.isclose(error, best[0], atol=1e-9) and np.allclose(np.interp(x, kx, ky), np.interp(x, best[1], best[2]), atol=1e-5) or np.isclose(error, best[0], atol=1e-12)
