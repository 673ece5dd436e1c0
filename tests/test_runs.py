"""Tracks cut over several tasks give the rows of whole tracks."""

import numpy as np
import pytest

from trackforge.core import Track
from trackforge.operators import sequential
from trackforge.operators.runs import Spaced
from trackforge.sources.shared import folder, scope

T = Track()


def same_rows(got, want):
    assert got.columns == want.columns
    a, b = (sorted(map(tuple, d.collect()), key=lambda r: (str(r[0]), r[1], str(r))) for d in (got, want))
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(abs(u - v) < 1e-9 * max(1, abs(v)) if isinstance(u, float) and isinstance(v, float) else u == v for u, v in zip(x, y, strict=True)), (x, y)


def log(spark, rng):
    rows = []
    for track, n in (("a", 150), ("b", 1), (None, 37), ("still", 60)):
        v = np.abs(np.cumsum(rng.normal(size=n)) * 2) * (rng.random(n) > 0.2 if track != "still" else 0)
        time = np.cumsum(rng.choice([0.0, 1.0, 2.0, 60.0], n, p=[0.1, 0.6, 0.25, 0.05]))
        place = np.cumsum(v)
        rows += [(track, int(i * 3), float(time[i]), None if rng.random() < 0.03 else float(v[i]), 51 + float(place[i]), 11.0 if rng.random() > 0.01 else None, "x%d" % i) for i in range(n)]
    return spark.createDataFrame(rows, "track_id string, seq long, elapsed_time_s double, speed double, lat double, lon double, note string").repartition(3)


@pytest.mark.parametrize("split, plain", [(2, False), (50, True)])
def test_split_tracks(spark, split, plain):
    d = log(spark, np.random.default_rng(split))
    with scope():
        got = sequential.stop_move(d, T, "lat", "lon", split=split, plain_markers=plain)
        want = sequential.stop_move(d, T, "lat", "lon", plain_markers=plain)
        same_rows(got, want)
        got = sequential.thin_by_distance(d, T, "lat", "elapsed_time_s", 40.0, split=split)
        same_rows(got, sequential.thin_by_distance(d, T, "lat", "elapsed_time_s", 40.0))
        none = sequential.stop_move(d.limit(0), T, "lat", "lon", split=split)
        assert none.count() == 0


@pytest.mark.parametrize("split", [7])
def test_split_filters(spark, split):
    rng = np.random.default_rng(split)
    rows = []
    for track, n in (("a", 200), (None, 40), ("one", 1)):
        time, v = np.cumsum(rng.choice([0.5, 1.0, 4.0], n)), np.abs(2 * np.sin(np.arange(n) / 9) + rng.normal(size=n) / 9)
        rows += [(track, i, float(time[i]), float(v[i]), 51 + float(rng.normal()) / 1e3 + i / 1e4, 11 + float(rng.normal()) / 1e3, None if rng.random() < 0.2 else float(rng.normal())) for i in range(n)]
    d = spark.createDataFrame(rows, "track_id string, seq long, elapsed_time_s double, speed double, lat double, lon double, yaw double").repartition(3)
    with scope():
        got, want = (sequential.kalman_smooth(d, T, "yaw", split=s) for s in (split, None))
        same_rows(got, want)
        got, want = (sequential.kalman_track(d, T, "lat", "lon", "speed", split=s) for s in (split, None))
        same_rows(got, want)
        assert 50 < got.where("is_moving").count() < 220


def test_first_far_row():
    rng = np.random.default_rng(4)
    for trial in range(60):
        n = int(rng.integers(1, 70))
        x, y = np.cumsum(rng.normal(size=n) * rng.choice([0.1, 5])), np.cumsum(rng.normal(size=n))
        if trial % 4 == 0:
            x[rng.integers(0, n)] = np.nan
        got = Spaced(x, y, 4.0).next.tolist()
        assert got == [next((j for j in range(i + 1, n) if np.hypot(x[j] - x[i], y[j] - y[i]) >= 4), n) for i in range(n)]


def test_rows_between_others_go_their_own_way(spark):
    """Rows of a chunk that end in the same place, with rows between them that end elsewhere, earlier or nowhere."""
    rng = np.random.default_rng(8)
    rows = [(k, i, float(x), float(y)) for k in range(40) for i, (x, y) in enumerate(rng.integers(0, 500, (60, 2)))]
    d = spark.createDataFrame(rows, "track_id int, seq int, x double, y double").repartition(3)
    with scope():
        got, want = (sequential.thin_by_distance(d, T, "x", "y", 380.0, split=s) for s in (5, None))
        same_rows(got, want)


def test_tables_go_with_their_scope(spark):
    from pathlib import Path

    place = Path(folder(spark, "x").removeprefix("file:")).parent
    before = set(place.iterdir())
    with scope():
        assert sequential.thin_by_distance(log(spark, np.random.default_rng(1)), T, "lat", "elapsed_time_s", 40.0, split=20).count()
    assert set(place.iterdir()) == before
