"""Values at the limits of classes, and ties, are decided alike by the queries and their SQL."""

from datetime import datetime, timedelta
from decimal import Decimal
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import types as ST

from trackforge import io_queries, queries  # noqa: F401
from trackforge.operators import sequential
from trackforge.operators.runs import Spaced
from trackforge.sources.shared import scope

ROW = ST.StructType([ST.StructField(n, k) for n, k in (("event_id", ST.LongType()), ("ts", ST.TimestampNTZType()), ("user_id", ST.LongType()), ("event_type", ST.StringType()), ("value", ST.DoubleType()), ("props", ST.StringType()))])


@pytest.fixture
def equal(spark, tmp_path):
    """Whether a query and its SQL give the same cells over events with such values (event_id, value of one track)."""

    def check(name: str, *tracks: list[tuple[int, float]]) -> list[tuple]:
        rows = [(e, datetime(2024, 1, 1) + timedelta(minutes=i), k, "view", v, "{}") for k, t in enumerate(tracks) for i, (e, v) in enumerate(t)]
        spark.createDataFrame(rows, ROW).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "events.parquet"))
        with duckdb.connect() as c:
            c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
            want = c.execute(queries.ORACLE_SQL[name])
            columns, want = [d[0] for d in want.description], [tuple(float(v) if isinstance(v, Decimal) else v for v in r) for r in want.fetchall()]
        got = [tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).select(*columns).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))
        return got

    return check


def test_no_speed_gives_no_curvature(equal):
    assert any(r[2] is None for r in equal("curvature_from_rates", [(1, 5.0), (2, 0.0), (4, 0.0), (5, 3.0)]))


RNG = np.random.default_rng(5)
#: Means of three curvatures that are the limit of a straight, whatever the three are.
AT_LIMIT = [[(6 * i + 1 + k, round(60 + float(d), 2)) for k, d in enumerate((a, b, -a - b))] for i, (a, b) in enumerate(RNG.integers(-2000, 2000, (60, 2)) / 100)]


@pytest.mark.parametrize("name", ["segment_curves", "segment_curves_full", "means_without_infinity", "radius_marks", "radius_markers"])
def test_curvature_at_the_limit_of_straights(equal, name):
    equal(name, *AT_LIMIT)


@pytest.mark.parametrize("name", ["kalman_track", "kalman_track_split"])
def test_halves_of_a_digit(equal, name):
    equal(name, *[[(7 * i + k, round(float(v), 2)) for k, v in enumerate(RNG.integers(0, 4000, 4) / 100)] for i in range(60)])


def exact_filter(xy: np.ndarray, dt: np.ndarray, on: np.ndarray) -> np.ndarray:
    """kalman_2d by the formulas of textbooks, in fractions."""
    q, r, p0, x = Fraction(1e-5), Fraction(1e-3), Fraction(100), [[Fraction(z), Fraction(0)] for z in xy[0].tolist()]
    p11, p12, p22, out = p0, Fraction(0), p0, []
    for i, d in enumerate(map(Fraction, dt.tolist())):
        z = [Fraction(v) for v in xy[i].tolist()]
        if on[i]:
            s11, s12, s22 = p11 + 2 * d * p12 + d * d * p22 + q, p12 + d * p22, p22 + q
            g, h = s11 / (s11 + r), s12 / (s11 + r)
            x = [[a + d * u + g * (v - a - d * u), u + h * (v - a - d * u)] for (a, u), v in zip(x, z, strict=True)]
            p11, p12, p22 = (1 - g) * s11, (1 - g) * s12, s22 - h * s12
        else:
            seen = xy[max(0, i - 4) : i + 1].tolist()
            x, p11, p12, p22 = [[sum(map(Fraction, c)) / len(seen), Fraction(0)] for c in zip(*seen, strict=True)], p0, Fraction(0), p0
        out.append([float(a) for a, _ in x])
    return np.array(out)


def test_filter_after_long_steps(spark):
    """Rows that follow hours after others, then seconds: what is left of the covariance isn't what rounding leaves."""
    rng, rows, want = np.random.default_rng(7), [], []
    for k in range(12):
        n = 45
        time = np.cumsum(rng.choice([0.5, 3.0, 20.0, 4000.0, 40_000.0, 200_000.0], n))
        xy, v = np.column_stack([51 + rng.exponential(50, n) / 1000, 11 + rng.integers(0, 100, n) / 1000]), rng.choice([10.0, 50.0, 90.0], n, p=[0.4, 0.2, 0.4])
        time -= time[0]
        want += exact_filter(xy, np.diff(time, prepend=time[:1]), sequential.moving_state(time, v, 60.0, 40.0, 3600.0)).tolist()
        rows += [(k, i, float(time[i]), float(v[i]), *xy[i].tolist()) for i in range(n)]
    d = spark.createDataFrame(rows, "track_id int, seq int, elapsed_time_s double, speed double, lat double, lon double").repartition(3)
    with scope():
        for split in (None, 5):
            got = sequential.kalman_track(d, queries.T, "lat", "lon", "speed", move=60.0, stop=40.0, hold=3600.0, split=split).orderBy("track_id", "seq").collect()
            assert 100 < sum(r["is_moving"] for r in got) < len(got) - 100
            assert np.abs(np.array([[r["lat_smoothed_kalman"], r["lon_smoothed_kalman"]] for r in got]) - want).max() < 1e-12


def test_spacing_at_its_limit():
    """The search in chunks and SQL take the same rows where the distance is the least one but for rounding."""
    a = RNG.integers(0, 10_000, (20_000, 2)) / 10.0
    b = a + np.array([179.7, 240.3]) * (300 / np.hypot(179.7, 240.3))
    far = np.sqrt((b[:, 0] - a[:, 0]) * (b[:, 0] - a[:, 0]) + (b[:, 1] - a[:, 1]) * (b[:, 1] - a[:, 1])) >= 300
    assert 0 < far.sum() < len(far)
    got = [Spaced(np.array([p[0], q[0]]), np.array([p[1], q[1]]), 300.0).next[0] == 1 for p, q in zip(a, b, strict=True)]
    assert got == far.tolist()


def test_change_points_of_tracks_with_one_row_more():
    """The last row alone is no piece, so that the end before it drops no start."""
    for n in (11, 16, 21, 26):
        for _ in range(60):
            v = np.round(RNG.normal(0, 1, n), 2) + np.repeat(RNG.normal(0, 2, n // 5 + 1), 5)[:n]
            assert sequential.change_points(v, 1.0) == _all_ends(v, 1.0)


def _all_ends(v: np.ndarray, penalty: float) -> list[int]:
    n = len(v)
    ends = [0, *range(5, n, 5), n]
    best, cuts = {0: -penalty}, {0: []}
    for j in ends[1:]:
        cost = [(best[i] + ((v[i:j] - v[i:j].mean()) ** 2).sum() + penalty, i) for i in ends if i in best and j - i >= 2]
        if cost:
            best[j], i = min(cost)
            cuts[j] = [*cuts[i], j]
    return cuts[n]


def test_pieces_of_two_rows_have_no_error(equal):
    """Lines through all rows in more than one way: the first way is taken."""
    for _ in range(40):
        x, y = np.cumsum(RNG.integers(1, 900, 8) / 100), RNG.integers(-500, 500, 8) / 1e7
        got = sequential.best_pieces(x, y, 5)
        assert got == sequential.best_pieces(x + 1e4 / 3, y, 5)
    equal("piecewise_segments", *[[(7 * i + k + 1, round(float(v), 2)) for k, v in enumerate(RNG.integers(1, 6000, 8) / 100)] for i in range(40)])


def _exact_pieces(x: list[float], y: list[float], count: int) -> list[int]:
    """The best pieces by exact arithmetic; of equal sums the first."""
    x, y, n = [Fraction(v) for v in x], [Fraction(v) for v in y], len(x)

    def error(i: int, j: int) -> Fraction:
        mx, my = sum(x[i:j]) / (j - i), sum(y[i:j]) / (j - i)
        xx, xy = sum((a - mx) ** 2 for a in x[i:j]), sum((a - mx) * (b - my) for a, b in zip(x[i:j], y[i:j], strict=True))
        return Fraction(0) if j - i == 2 else sum((b - my) ** 2 for b in y[i:j]) - (xy * xy / xx if xx else 0)

    best = {0: (Fraction(0), [0])}
    for _ in range(count):
        best = {j: min((best[i][0] + error(i, j), i, best[i][1]) for i in range(j) if i in best) for j in range(1, n + 1) if min(best) < j}
        best = {j: (cost, [*cuts, j]) for j, (cost, _, cuts) in best.items()}
    return best[n][1]


def test_equal_sums_of_pieces_begin_early():
    """Rows at one place, then two at the next one: the first of these is on a line with the former, or with the latter."""
    rng = np.random.default_rng(11)
    for _ in range(60):
        x = np.repeat(np.round(np.cumsum(rng.uniform(5, 200, 6)), 2), [1, 2, 3, 1, 4, 2])
        y = np.round(rng.normal(0, 40, len(x)), 2) / 1e5
        assert sequential.best_pieces(x, y, 4) == _exact_pieces(x.tolist(), y.tolist(), 4)
