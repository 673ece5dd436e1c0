"""Operators whose state depends on where the last piece ended: one pass over each track, in Arrow
through applyInArrow. Everything that a window can express is done before, natively; only the columns
that a kernel computes with become numpy arrays, the others stay in Arrow.

A track must fit into one worker; tracks are days of one vehicle, and more data means more tracks. For longer
ones, stop_move and thin_by_distance take ``split``: tracks are cut into chunks of so many rows (see runs), with
the same rows as a result.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackforge.core import Track
from trackforge.operators import runs, scans
from trackforge.operators.smoothing import rolling_mean

#: Of columns as float arrays: (rows of the result by number, or None for all; new columns, NaN as null).
Kernel = Callable[[dict[str, np.ndarray]], tuple[np.ndarray | None, dict[str, object]]]
_D = T.DoubleType()
_ARROW = {"double": pa.float64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}


def per_track(df: DataFrame, t: Track, columns: list[str], kernel: Kernel, added: list[tuple[str, T.DataType]], *, keep: list[str] | None = None, skip_failing: bool = False, errors: tuple[str, str] | None = None) -> DataFrame:
    """kernel on each track's rows in order of seq. The result has the rows' columns (or those to keep)
    and the added ones, which replace columns of their names.

    skip_failing: a track whose kernel fails is left out, with a line on the worker's stderr. errors: (column, step): it
    keeps its rows instead, with nulls in what is added and "step: error" in the column; a track that has failed
    before is passed on so, too.
    """
    new = dict(added)
    fields = [f for f in df.schema.fields if f.name not in new and (keep is None or f.name in keep or errors and f.name == errors[0])] + [T.StructField(n, k) for n, k in added]
    if errors and errors[0] not in df.columns:
        fields.append(T.StructField(errors[0], T.StringType()))

    def run(table: pa.Table) -> pa.Table:
        seq = table.column(t.seq).to_numpy()
        if len(seq) > 1 and (seq[1:] < seq[:-1]).any():
            table = table.take(np.argsort(seq, kind="stable"))
        failed = table.column(errors[0])[0].as_py() if errors and errors[0] in table.column_names else None
        try:
            rows, made = (None, {n: [None] * table.num_rows for n in new}) if failed else kernel({c: table.column(c).cast(pa.float64()).to_numpy() for c in columns})
        except Exception as e:
            if errors:
                failed, rows, made = f"{errors[1]}: {e!r}", None, {n: [None] * table.num_rows for n in new}
            elif not skip_failing:
                raise
            else:
                print(f"track {table.column(t.track)[0]}: {e!r}", file=sys.stderr)
                rows, made = np.zeros(0, np.int64), {n: [] for n in new}
        out = table if rows is None else table.take(pa.array(rows, pa.int64()))
        if errors:
            made = {**made, errors[0]: [failed] * out.num_rows}
        arrays = [pa.array(made[f.name], pa.string()) if errors and f.name == errors[0] else pa.array(made[f.name], _ARROW[new[f.name].simpleString()], from_pandas=True) if f.name in new else out.column(f.name) for f in fields]
        return pa.Table.from_arrays(arrays, [f.name for f in fields])

    return df.groupBy(t.track).applyInArrow(run, T.StructType(fields))


# Stops and moves

#: Speed classes in m/s, the look-ahead in rows, the speed that ends a stop.
SPEED_BINS = (0.0, 0.5, 5.0, 10.0, 20.0, 30.0, 40.0)
LOOK_AHEAD, MOVING_SPEED, WINDOW_WAY = 10, 0.5, 20.0


def speed_classes(v: np.ndarray, bins: tuple[float, ...]) -> np.ndarray:
    """i where bins[i] <= v < bins[i + 1]; the last class otherwise, below the bins and for NaN too."""
    i = np.searchsorted(bins, v, side="right") - 1
    return np.where((i >= 0) & (i < len(bins) - 1) & (v == v), i, len(bins) - 1)


def speed_class(v: float, bins: tuple[float, ...]) -> int:
    return int(speed_classes(np.array([v]), bins)[0])


def pieces(time: np.ndarray, speed: np.ndarray, bins: tuple[float, ...] = SPEED_BINS, max_stop: float = 300.0) -> list[tuple[int, int, bool]]:
    """(first row, row after the last, whether it is a stop) of each piece of a track. A piece ends
    when its class does and the mean of the next rows agrees, or when it has lasted long enough."""
    n, out, i = len(time), [], 0
    padded = np.concatenate([speed, np.zeros(LOOK_AHEAD)])
    ahead = sum(padded[k : k + n] for k in range(LOOK_AHEAD)) / np.minimum(LOOK_AHEAD, n - np.arange(n))
    own_class, next_class, moves = speed_classes(speed, bins).tolist(), speed_classes(ahead, bins).tolist(), (ahead >= MOVING_SPEED).tolist()
    lasts = np.where(speed < MOVING_SPEED, 1.0, np.clip(WINDOW_WAY / (speed + 1e-6), 1.0, 9999.0)).tolist()
    time = time.tolist()
    while i < n:
        own, j = own_class[i], i + 1
        stop = own == 0
        until = time[i] + (max_stop if stop else lasts[i])
        while j < n and time[j] <= until:
            if own_class[j] != own and (moves[j] if stop else next_class[j] != own):
                break
            j += 1
        out.append((i, j, stop))
        i = j
    return out


class Stops(runs.Chunk):
    """The pieces of a chunk: columns time and speed, with two rows before and eleven after it."""

    BEFORE, AFTER = 2, 2 + LOOK_AHEAD - 1

    def __init__(self, c: dict[str, np.ndarray], before: int, after: int, time: str, speed: str, bins: tuple[float, ...], max_stop: float):
        self.columns, self.own = c, slice(before, len(c[time]) - after)
        self.n = n = len(c[time]) - before - after
        known, total, count = ~np.isnan(c[speed]), np.zeros(len(c[speed])), np.zeros(len(c[speed]))
        for k in range(-2, 3):  # the centred mean of five, null if none is known
            at = slice(max(0, -k), len(total) - max(0, k))
            of = slice(max(0, k), len(total) - max(0, -k))
            total[at] += np.where(known[of], c[speed][of], 0.0)
            count[at] += known[of]
        with np.errstate(invalid="ignore"):
            mean = (total / count)[before:]
        self.mean = mean[:n]
        v = np.nan_to_num(mean)
        padded = np.concatenate([v, np.zeros(LOOK_AHEAD)])
        ahead = sum(padded[k : k + n] for k in range(LOOK_AHEAD)) / np.minimum(LOOK_AHEAD, len(v) - np.arange(n))
        self.cls, next_cls, v = speed_classes(v[:n], bins), speed_classes(ahead, bins), v[:n]
        self.time = c[time][self.own]
        self.until = self.time + np.where(self.cls == 0, max_stop, np.where(v < MOVING_SPEED, 1.0, np.clip(WINDOW_WAY / (v + 1e-6), 1.0, 9999.0)))
        lost = np.isnan(self.time)  # a row without time ends every piece
        self.clock = np.maximum.accumulate(np.where(lost, -np.inf, self.time)) if n else self.time
        self.breaks = [np.flatnonzero(((self.cls != k) & ((ahead >= MOVING_SPEED) if k == 0 else (next_cls != k))) | lost) for k in range(len(bins))]
        self.next = self._ends(self.cls, self.until, np.arange(n) + 1)

    def _ends(self, cls: np.ndarray, until: np.ndarray, start: np.ndarray) -> np.ndarray:
        out = np.maximum(np.searchsorted(self.clock, until, side="right"), start)
        out = np.where(np.isnan(until), start, out)
        for k, at in enumerate(self.breaks):
            rows = np.flatnonzero(cls == k)
            out[rows] = np.minimum(out[rows], np.append(at, self.n)[np.searchsorted(at, start[rows])])
        return np.minimum(out, self.n)

    def states(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([self.cls[rows], self.until[rows]], 1)

    def enter(self, states: np.ndarray) -> np.ndarray:
        return self._ends(states[:, 0].astype(np.int64), states[:, 1], np.zeros(len(states), np.int64))


def _split_stops(df: DataFrame, t: Track, lat: str, lon: str, speed: str, time: str, bins: tuple[float, ...], max_stop: float, split: int) -> DataFrame:
    """A row for each piece: _track, first, last (seq), stop, means, and first and last time."""
    columns = [time, speed, lat, lon]
    table = runs.chunks(df, t, columns, split, Stops.BEFORE, Stops.AFTER)

    def make(c: dict[str, np.ndarray], before: int, after: int) -> Stops:
        return Stops(c, before, after, time, speed, bins, max_stop)

    def parts(c: Stops, starts: np.ndarray, chunk: int, going: int) -> dict[str, np.ndarray]:
        run = runs.number_of(starts, c.n, chunk, going)
        first = np.flatnonzero(np.diff(run, prepend=-2) != 0)
        end = np.append(first[1:], c.n)
        of = lambda x: np.append(np.add.reduceat(x, first), np.zeros(len(first)))  # noqa: E731  sums at the first row of a part, zeros at its last
        rows = np.append(first, end - 1)
        stop = np.where(np.isin(rows, starts), c.cls[rows] == 0, False)
        return {"rows": rows, "run": run[rows], "n": of(np.ones(c.n)), "stop": stop, "v": of(c.mean), **{x: of(c.columns[y][c.own]) for x, y in (("a", lat), ("b", lon))}, "time": c.time[rows]}

    added = [("run", T.LongType()), ("n", _D), ("stop", T.BooleanType()), ("v", _D), ("a", _D), ("b", _D), ("time", _D)]
    # a sum with a value missing is null for the whole piece, as its mean is
    whole = lambda c: F.when(F.count(c) == F.count("*"), F.sum(c) / F.sum("n")).alias(c)
    out = runs.over_chunks(table, runs.entries(table, columns, make), columns, make, parts, added).groupBy("track", "run")
    return out.agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.max("stop").alias("stop"), *map(whole, ("v", "a", "b")), F.min_by("time", "seq").alias("t0"), F.max_by("time", "seq").alias("t1")).withColumnRenamed("track", "_track")


def stop_move(df: DataFrame, t: Track, lat: str = "GPS_lat", lon: str = "GPS_lon", speed: str = "speed", time: str = "elapsed_time_s", *, bins: tuple[float, ...] = SPEED_BINS, max_stop: float = 300.0, plain_markers: bool = False, skip_failing: bool = False, errors: tuple[str, str] | None = None, split: int | None = None) -> DataFrame:
    """A track as stops (two rows, STOP_START and STOP_END) and moves (one row, MOVING_<class>), with mean
    place and speed; the other columns are those of a piece's first row (of STOP_END: its last).

    plain_markers: moves are MOVING, and time_numeric is the middle of the piece. skip_failing, errors: see per_track. split: rows of a chunk, for tracks that
    are too long for one task; time must not decrease then.
    """
    a, b = f"{lat}_smoothed_rolling_windows", f"{lon}_smoothed_rolling_windows"
    added = [(speed, _D), (a, _D), (b, _D), ("segment_marker", T.StringType())] + ([("time_numeric", _D)] if plain_markers else [])
    order = [*[c for c in df.columns if c not in {n for n, _ in added} - {speed}], *[n for n, _ in added if n != speed]]
    if split:
        p = _split_stops(df, t, lat, lon, speed, time, bins, max_stop, split)
        kind = F.lit(f"MOVING_{len(bins) - 1}")
        for i, (low, high) in enumerate(zip(bins, bins[1:], strict=False)):
            kind = F.when((F.col("v") >= low) & (F.col("v") < high), F.lit(f"MOVING_{i}")).otherwise(kind)
        mark = lambda at, name: F.struct(F.col(at).alias("seq"), name.alias("marker"))
        rows = F.when(F.col("stop"), F.array(mark("first", F.lit("STOP_START")), mark("last", F.lit("STOP_END")))).otherwise(F.array(mark("first", F.lit("MOVING") if plain_markers else kind)))
        p = p.select("_track", F.explode(rows).alias("_m"), F.col("v").alias("_v"), F.col("a").alias("_a"), F.col("b").alias("_b"), ((F.col("t0") + F.col("t1")) / 2).alias("_t"))
        made = {speed: F.col("_v"), a: F.col("_a"), b: F.col("_b"), "segment_marker": F.col("_m.marker"), "time_numeric": F.col("_t")}
        return df.join(p, F.col(t.track).eqNullSafe(F.col("_track")) & (F.col(t.seq) == F.col("_m.seq"))).withColumns({n: made[n] for n, _ in added}).select(*order)
    d = rolling_mean(df, t, speed, 5, to="_v")

    def kernel(c: dict[str, np.ndarray]) -> tuple:
        v, s = c["_v"], c[time]
        first, end, stop = (np.array(x) for x in zip(*pieces(s, np.nan_to_num(v), bins, max_stop), strict=True))
        mean = lambda x: np.add.reduceat(x, first) / (end - first)
        copies = 1 + stop
        of = np.repeat(np.arange(len(first)), copies)
        last = np.append(of[1:] != of[:-1], True) & stop[of]
        moving = ["MOVING"] * len(first) if plain_markers else [f"MOVING_{k}" for k in speed_classes(mean(v), bins).tolist()]
        marks = [("STOP_END" if z else "STOP_START") if stop[k] else moving[k] for k, z in zip(of.tolist(), last.tolist(), strict=True)]
        made = {a: mean(c[lat])[of], b: mean(c[lon])[of], speed: mean(v)[of], "segment_marker": marks}
        if plain_markers:
            made["time_numeric"] = ((s[first] + s[end - 1]) / 2)[of]
        return np.where(last, end[of] - 1, first[of]), made

    return per_track(d, t, ["_v", time, lat, lon], kernel, added, keep=df.columns, skip_failing=skip_failing, errors=errors).select(*order, *([errors[0]] if errors and errors[0] not in order else []))


def thin_by_distance(df: DataFrame, t: Track, x: str, y: str, least: float, *, split: int | None = None) -> DataFrame:
    """Rows at least ``least`` from the last row kept; min_distance says so. split: rows of a chunk, for tracks that are too
    long for one task."""
    if split:
        make = lambda c, before, after: runs.Spaced(c[x], c[y], least)
        table = runs.chunks(df, t, [x, y], split, 0, 0)
        kept = runs.over_chunks(table, runs.entries(table, [x, y], make), [x, y], make, lambda c, starts, *_: {"rows": starts}, [])
        kept = kept.select(F.col("track").alias("_track"), F.col("seq").alias("_seq"))
        return df.join(kept, F.col(t.track).eqNullSafe(F.col("_track")) & (F.col(t.seq) == F.col("_seq")), "left_semi").withColumn("min_distance", F.lit(float(least)))

    def kernel(c: dict[str, np.ndarray]) -> tuple:
        keep, last = [], None
        for i, p in enumerate(zip(c[x].tolist(), c[y].tolist(), strict=True)):
            if last is None or math.sqrt((p[0] - last[0]) * (p[0] - last[0]) + (p[1] - last[1]) * (p[1] - last[1])) >= least:
                keep.append(i)
                last = p
        return np.array(keep), {"min_distance": np.full(len(keep), float(least))}

    return per_track(df, t, [x, y], kernel, [("min_distance", _D)])


# Curves


def steady_runs(v: np.ndarray, most: float, shortest: int) -> np.ndarray:
    """Number of each row's run of little spread (0: none): a run grows while its standard deviation
    stays within ``most``. NaN adds nothing, and a run doesn't begin with more than one. Running sums,
    so a run of n rows costs n steps."""
    out, number, start, n, mean, m2 = np.zeros(len(v), np.int64), 0, 0, 0, 0.0, 0.0

    def close(end: int) -> None:
        nonlocal number
        if end - start >= shortest:
            number += 1
            out[start:end] = number

    for j, x in enumerate(v.tolist()):
        if x != x:
            if n == 0:
                start = j
            continue
        d = x - mean
        if n and (max(m2 + d * (d - d / (n + 1)), 0.0) / (n + 1)) ** 0.5 > most:
            close(j)
            start, n, mean, m2, d = j, 0, 0.0, 0.0, x
        m2 += d * (d - d / (n + 1))
        mean += d / (n + 1)
        n += 1
    close(len(v)) if n else None
    return out


def steady_curves(df: DataFrame, t: Track, curvature: str, radius: str, *, most: float = 1e-4, shortest: int = 3) -> DataFrame:
    """steady_group (0: none), and its steady_mean_radius and steady_mean_curvature."""

    def kernel(c: dict[str, np.ndarray]) -> tuple:
        k = c[curvature]
        g = steady_runs(np.where(np.isfinite(k), k, np.nan), most, shortest)

        def mean(x: np.ndarray) -> np.ndarray:  # of a group's values that are there
            known = ~np.isnan(x)
            with np.errstate(invalid="ignore"):
                return (np.bincount(g[known], x[known], g.max(initial=0) + 1) / np.bincount(g[known], minlength=g.max(initial=0) + 1))[g]

        return None, {"steady_group": g, "steady_mean_radius": mean(c[radius]), "steady_mean_curvature": mean(k)}

    return per_track(df, t, [curvature, radius], kernel, [("steady_group", T.LongType()), ("steady_mean_radius", _D), ("steady_mean_curvature", _D)])


def fit_circles(x: np.ndarray, y: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(radius, mean absolute residual) of the least-squares circle of every ``size`` rows. Points
    are centred on their window first: map coordinates are large and arcs short."""
    from numpy.lib.stride_tricks import sliding_window_view

    if len(x) < size:
        return np.zeros(0), np.zeros(0)
    u, v = (w - w.mean(1, keepdims=True) for w in (sliding_window_view(x, size), sliding_window_view(y, size)))
    z = u * u + v * v
    suu, svv, suv, suz, svz = ((a * b).sum(1) for a, b in ((u, u), (v, v), (u, v), (u, z), (v, z)))
    det = suu * svv - suv * suv
    with np.errstate(divide="ignore", invalid="ignore"):
        cx, cy = (suz * svv - svz * suv) / (2 * det), (svz * suu - suz * suv) / (2 * det)
        r = np.sqrt(cx * cx + cy * cy + z.mean(1))
        res = np.abs(np.hypot(u - cx[:, None], v - cy[:, None]) - r[:, None]).mean(1)
    line = det <= 1e-12 * (suu + svv) ** 2
    return np.where(line, np.inf, r), np.where(line, np.inf, res)


def circle_groups(radius: np.ndarray, close: float) -> np.ndarray:
    """Number of each window's group (0: no valid circle): a window joins the group before it if its
    radius is within ``close`` of the group's mean so far."""
    out, number, n, mean = np.zeros(len(radius), np.int64), 0, 0, 0.0
    for i, r in enumerate(radius):
        if r != r:
            continue
        if n and abs(r - mean) <= close:
            mean += (r - mean) / (n + 1)
            n += 1
        else:
            number, n, mean = number + 1, 1, r
        out[i] = number
    return out


def circle_fit(df: DataFrame, t: Track, x: str = "x", y: str = "y", *, size: int = 20, most_residual: float = 1.0, low: float = 300.0, high: float = 12_000.0, close: float = 50.0) -> DataFrame:
    """circle_group and radius_m_circle: between the middles of the first and last window of a group of
    fitting circles, the group's number and mean radius; null elsewhere."""

    def kernel(c: dict[str, np.ndarray]) -> tuple:
        r, res = fit_circles(c[x], c[y], size)
        g = circle_groups(np.where((res <= most_residual) & (r >= low) & (r <= high), r, np.nan), close)
        group, radius = np.full(len(c[x]), np.nan), np.full(len(c[x]), np.nan)
        for k in range(1, g.max(initial=0) + 1):
            at = np.flatnonzero(g == k)
            a, b = at[0] + size // 2, at[-1] + size // 2
            group[a : b + 1], radius[a : b + 1] = k, r[at].mean()
        return None, {"circle_group": [None if k != k else int(k) for k in group.tolist()], "radius_m_circle": radius}

    return per_track(df, t, [x, y], kernel, [("circle_group", T.LongType()), ("radius_m_circle", _D)])


#: A piece's squared error below so much of the whole sum of squares is none: it is what rounding leaves. So is all of
#: a piece of two rows.
NO_ERROR = 1e-12


def best_pieces(x: np.ndarray, y: np.ndarray, count: int, most_points: int = 400) -> list[int]:
    """Row numbers of the breaks of the piecewise line of ``count`` pieces with least squared error,
    by dynamic programming over all rows, in memory that grows with rows times pieces.

    Beyond ``most_points`` rows, as many evenly spread places first give a bound: no piece of the best
    line has a larger error than the whole of another line, and errors only grow with a piece."""
    n = len(x)
    s = lambda v: np.concatenate([[0.0], np.cumsum(v)])
    x0, y0 = x - x.mean(), y - y.mean()
    sums = np.stack([s(x0), s(y0), s(x0 * x0), s(x0 * y0), s(y0 * y0)])
    least, moves = NO_ERROR * sums[4, -1], np.append(np.flatnonzero(np.diff(x)) + 1, n)
    same = moves[np.searchsorted(moves, np.arange(n), side="right")]  # the row up to which all are at one place

    def solve(at: np.ndarray, bound: float) -> tuple[float, list[int]]:
        sx, sy, sxx, sxy, syy = sums[:, at]

        def error(lo: int, j: int) -> np.ndarray:
            i = slice(lo, j)
            m = at[j] - at[i]
            dx, dy = sx[j] - sx[i], sy[j] - sy[i]
            vxx, vxy, vyy = sxx[j] - sxx[i] - dx * dx / m, sxy[j] - sxy[i] - dx * dy / m, syy[j] - syy[i] - dy * dy / m
            sloped = (at[j] > same[at[i]]) & (vxx > 0)  # rounding leaves some at one place, too
            e = vyy - np.where(sloped, vxy * vxy / np.where(sloped, vxx, 1), 0)
            return np.where((m > 2) & (e > least), e, 0.0)

        p = len(at) - 1
        k = min(count, p)
        cost, back, lo = np.full((k + 1, p + 1), np.inf), np.zeros((k + 1, p + 1), np.int32), 0
        cost[0, 0] = 0
        for j in range(1, p + 1):
            e = error(lo, j)
            skip = int((e <= bound).argmax())
            lo, e = lo + skip, e[skip:]
            c = cost[:k, lo:j] + e
            cost[1:, j] = c.min(1)
            back[1:, j] = (c <= cost[1:, j, None] + least).argmax(1) + lo  # the first but for rounding
        cuts, j = [n], p
        for i in range(k, 0, -1):
            j = int(back[i, j])
            cuts.append(int(at[j]))
        return float(cost[k, p]), cuts[::-1]

    if n <= most_points or count >= most_points:
        return solve(np.arange(n + 1), np.inf)[1]
    bound, _ = solve(np.unique(np.linspace(0, n, most_points + 1).astype(int)), np.inf)
    return solve(np.arange(n + 1), bound + 1e-9 * float(sums[4, -1]))[1]  # the addend is for rounding


def lowest(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which parabolas a y^2 - 2 b y + c are lowest somewhere, from left to right."""
    if len(a) == 1:
        return np.zeros(1, np.int64)
    cur, y, out = int(np.lexsort((c, b, a))[0]), -np.inf, []
    while True:
        out.append(cur)
        da, db, dc = a - a[cur], b - b[cur], c - c[cur]
        with np.errstate(invalid="ignore", divide="ignore"):
            root = np.sqrt(db * db - da * dc)
            at = np.where(da != 0, (db - root) / da, np.where(db > 0, dc / (2 * db), np.nan))  # where each falls below this one
        at = np.where(at > y + 1e-12 * (1 + abs(y) if np.isfinite(y) else 0), at, np.inf)
        at[cur] = np.inf
        nearest = float(np.nanmin(at)) if len(at) else np.inf
        if not np.isfinite(nearest) or len(out) > 2 * len(a):
            return np.unique(out)
        cur, y = int(np.nanargmin(at)), nearest


def joined_pieces(x: np.ndarray, y: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(x and y of the knots, squared error) of the line of ``count`` pieces that meet, at places of rows, with the
    least error; x must not decrease. Dynamic programming over the value at a knot: the least error up to it is the
    lowest of some parabolas of that value, and those that are lowest nowhere are dropped. Steps grow with the
    square of the rows."""
    ends = np.append(np.flatnonzero(np.diff(x)), len(x) - 1)  # the last row of each place
    p, middle = x[ends], y.mean()
    v = y - middle
    s = lambda w: np.concatenate([[0.0], np.cumsum(w)])[ends + 1]
    n1, sx, sxx, sv, sxv, svv = (s(w) for w in (np.ones(len(x)), x - x[0], (x - x[0]) ** 2, v, v * (x - x[0]), v * v))
    p0, k = p - x[0], min(count, len(p) - 1)

    def piece(i: np.ndarray, j: int | np.ndarray) -> tuple[np.ndarray, ...]:
        """Coefficients of the error of rows after place i up to place j by the values at both."""
        m, q, u = n1[j] - n1[i], p0[i], p0[j] - p0[i]
        d1, d2 = sx[j] - sx[i] - m * q, sxx[j] - sxx[i] - 2 * q * (sx[j] - sx[i]) + m * q * q
        e0, e1 = sv[j] - sv[i], sxv[j] - sxv[i] - q * (sv[j] - sv[i])
        r1, r2, vr = d1 / u, d2 / (u * u), e1 / u
        return m - 2 * r1 + r2, r2, r1 - r2, e0 - vr, vr, svv[j] - svv[i]

    first = (np.array([n1[0]]), np.array([sv[0]]), np.array([svv[0]]), np.array([-1]), np.array([-1]))
    levels: list[list[tuple | None]] = [[first] + [None] * (len(p) - 1)]
    if k > 1:  # the first piece begins at the first place, wherever it ends: one parabola for each end
        (a, b, c, none, _), (aa, bb, cc, dd, ee, ff) = first, piece(np.zeros(1, np.int64), np.arange(1, len(p)))
        new = np.stack([bb - cc * cc / (a + aa), ee - cc * (b + dd) / (a + aa), c + ff - (b + dd) ** 2 / (a + aa)])
        levels.append([None, *[(*new[:, j : j + 1], none + 1, none + 1) for j in range(len(p) - 1)]])
    for level in range(len(levels), k + 1):
        above, own = levels[-1], [None] * len(p)
        for j in range(1, len(p)) if level < k else (len(p) - 1,):  # the last piece ends at the last place
            old = [(i, q) for i, q in enumerate(above[:j]) if q is not None]
            if not old:
                continue
            i = np.concatenate([np.full(len(q[0]), i) for i, q in old])
            which = np.concatenate([np.arange(len(q[0])) for _, q in old])
            a, b, c = (np.concatenate([q[t] for _, q in old]) for t in range(3))
            aa, bb, cc, dd, ee, ff = piece(i, j)
            new = bb - cc * cc / (a + aa), ee - cc * (b + dd) / (a + aa), c + ff - (b + dd) ** 2 / (a + aa)
            keep = lowest(*new)
            own[j] = tuple(t[keep] for t in (*new, i, which))
        levels.append(own)
    if k == 0:
        return p, np.array([v.mean() + middle]), float(((v - v.mean()) ** 2).sum())
    a, b, c, i, which = levels[k][-1]
    best = int((c - b * b / a).argmin())
    error, value, j = float(max((c - b * b / a)[best], 0.0)), float(b[best] / a[best]), len(p) - 1
    at, values = [j], [value]
    for level in range(k, 0, -1):
        _, _, _, i, which = levels[level][j]
        j2, best2 = int(i[best]), int(which[best])
        aa, _, cc, dd, _, _ = piece(np.array([j2]), j)
        a, b = levels[level - 1][j2][0][best2], levels[level - 1][j2][1][best2]
        value = float((b + dd[0] - cc[0] * value) / (a + aa[0]))
        j, best = j2, best2
        at.append(j)
        values.append(value)
    return p[at[::-1]], np.array(values[::-1]) + middle, error


def segment_piecewise(df: DataFrame, t: Track, curvature: str, distance: str = "cumulative_distance_m", *, count: int = 5, flat: float = 5e-4, straight: float = 5e-5, joined: bool = False) -> DataFrame:
    """A table of pieces of the curvature over the distance: segment_index, start_distance,
    end_distance, slope, intercept, mean_curvature_est (on the line, in the middle), segment_type
    (straight, curve, transition). joined: the lines meet at their breaks, as a curvature does that doesn't jump;
    that takes steps in proportion to the square of a track's rows."""
    added = [("segment_index", T.IntegerType()), *[(c, _D) for c in ("start_distance", "end_distance", "slope", "intercept", "mean_curvature_est")], ("segment_type", T.StringType())]

    def kernel(c: dict[str, np.ndarray]) -> tuple:
        ok = np.isfinite(c[distance]) & np.isfinite(c[curvature])
        x, y, out = c[distance][ok], c[curvature][ok], []
        kind_of = lambda slope, mid: "transition" if abs(slope) >= flat else "straight" if abs(mid) < straight else "curve"
        if joined and len(x) > 1:
            order = np.argsort(x, kind="stable")
            kx, ky, _ = joined_pieces(x[order], y[order], count)
            for k, slope in enumerate(np.diff(ky) / np.diff(kx)):
                mid = (ky[k] + ky[k + 1]) / 2
                out.append((k, kx[k], kx[k + 1], slope, ky[k] - slope * kx[k], mid, kind_of(slope, mid)))
        cuts = best_pieces(x, y, count) if len(x) > 1 and not joined else []
        for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
            px, py = x[i:j], y[i:j]
            slope = float(np.polyfit(px - px.mean(), py, 1)[0]) if len(px) > 1 and np.ptp(px) > 0 else 0.0
            intercept = float(py.mean() - slope * px.mean())
            mid = slope * (px[0] + px[-1]) / 2 + intercept
            out.append((k, px[0], px[-1], slope, intercept, mid, kind_of(slope, mid)))
        columns = zip(*out, strict=True) if out else [[]] * len(added)
        return np.zeros(len(out), np.int64), dict(zip([n for n, _ in added], columns, strict=True))

    return per_track(df, t, [distance, curvature], kernel, added, keep=[t.track])


def change_points(v: np.ndarray, penalty: float, shortest: int = 2, jump: int = 5) -> list[int]:
    """Ends of the pieces with least sum of squared deviations plus a penalty each, found exactly
    among multiples of ``jump``, dropping starts that can't be best any more."""
    n = len(v)
    s1, s2 = np.concatenate([[0.0], np.cumsum(v)]), np.concatenate([[0.0], np.cumsum(v * v)])
    best, back, starts = {0: -penalty}, {}, [0]
    ends = [*range(jump, n, jump), n]
    for j, following in zip(ends, [*ends[1:], n], strict=True):
        ok = [i for i in starts if j - i >= shortest]
        if not ok:
            continue
        i = np.array(ok)
        c = np.array([best[k] for k in ok]) + (s2[j] - s2[i]) - (s1[j] - s1[i]) ** 2 / (j - i) + penalty
        k = int(c.argmin())
        best[j], back[j] = float(c[k]), ok[k]
        spare = 1e-9 * (penalty + float(s2[-1]))  # rounding drops none that is as good
        keep = {a for a, cost in zip(ok, c.tolist(), strict=True) if cost - penalty <= best[j] + spare}
        # a start is worse than j for all ends that a piece from j can have; one that is too near has only the others
        starts = [a for a in starts if a in keep or j - a < shortest or following - j < shortest] + [j]
    out, j = [], n
    while j in back:
        out.append(j)
        j = back[j]
    return out[::-1] or [n]


#: Names of classes in logs of former versions.
SHORT, STRAIGHT, BENT = "zu klein", "gerade Linie", "Kurve"


def segment_change_points(df: DataFrame, t: Track, curvature: str, *, penalty: float = 1e-3, straight: float = 5e-5, signed: bool = False) -> DataFrame:
    """segment_id, segment_class (zu klein for tracks of one row, gerade Linie, Kurve) and mittelradius of pieces of
    even curvature. signed: a piece is straight by its signed mean, so every left bend is."""

    def kernel(c: dict[str, np.ndarray]) -> tuple:
        k = np.where(np.isfinite(c[curvature]), c[curvature], 999.0)
        number, kind, radius = np.zeros(len(k), np.int64), np.full(len(k), SHORT, object), np.full(len(k), np.nan)
        i = 0
        for m, j in enumerate(change_points(k, penalty) if len(k) > 1 else []):
            mean = k[i:j].mean()
            line = (mean if signed else abs(mean)) < straight
            number[i:j], kind[i:j] = m, STRAIGHT if line else BENT
            radius[i:j] = np.nan if line else 1 / abs(mean) if mean else np.inf
            i = j
        return None, {"segment_id": number, "segment_class": kind, "mittelradius": radius}

    return per_track(df, t, [curvature], kernel, [("segment_id", T.LongType()), ("segment_class", T.StringType()), ("mittelradius", _D)])


# Filters with state


def kalman_1d(z: np.ndarray, q: float = 0.1, r: float = 2.0, p: float = 1.0, x: float | None = None) -> np.ndarray:
    """A random walk seen with noise; NaN is a step without a sight. x: where it starts, at the first sight by default."""
    out, x = np.empty(len(z)), next((v for v in z.tolist() if v == v), 0.0) if x is None else x
    for i, v in enumerate(z.tolist()):
        p += q
        if v == v:
            g = p / (p + r)
            x, p = x + g * (v - x), (1 - g) * p
        out[i] = x
    return out


def kalman_smooth(df: DataFrame, t: Track, column: str, *, q: float = 0.1, r: float = 2.0, to: str | None = None, split: int | None = None) -> DataFrame:
    """split: rows of a chunk, for tracks that are too long for one task."""
    name = to or f"{column}_kalman"
    if split:

        def summary(c: dict[str, np.ndarray], before: int, extra: tuple) -> np.ndarray:
            known = c[column][~np.isnan(c[column])]
            return np.append(scans.walk_steps(c[column], q, r).product().flat(), known[0] if len(known) else np.nan)

        def finish(c: dict[str, np.ndarray], before: int, extra: tuple) -> dict:
            (x, p), = extra
            return {name: kalman_1d(c[column], q, r, float(p), float(x))}

        return scans.filtered(df, t, [column], split, 0, [(summary, scans.walk_states)], finish, [(name, _D)]).select(*[c for c in df.columns if c != name], name)
    return per_track(df, t, [column], lambda c: (None, {name: kalman_1d(c[column], q, r)}), [(name, _D)])


def kalman_2d(xy: np.ndarray, dt: np.ndarray, on: np.ndarray, q: float = 1e-5, r: float = 1e-3, p0: float = 100.0, window: int = 5, state: tuple[np.ndarray, np.ndarray] | None = None, before: int = 0) -> np.ndarray:
    """Places from a constant-velocity filter where on; elsewhere the mean of the last ``window``
    sights, from which the filter goes on. state: places and speeds, and the covariance (see scans) to start with; before:
    sights in front of the first step."""
    out = np.empty_like(xy[before:])
    if not len(xy):
        return out
    x, u, cov = xy[0], np.zeros(2), scans.fresh(p0)
    if state:
        (x, u), cov = state
    (x, y), (u, v) = x.tolist(), u.tolist()
    g = scans.gains(dt, on, q, r, p0, tuple(float(c) for c in cov)).tolist()
    for i, (a, b) in enumerate(xy[before:].tolist()):
        if on[i]:
            (g1, g2, *_), d = g[i], float(dt[i])
            x, y = x + d * u, y + d * v
            x, y, u, v = x + g1 * (a - x), y + g1 * (b - y), u + g2 * (a - x), v + g2 * (b - y)
        else:
            (x, y), u, v = xy[max(0, before + i + 1 - window) : before + i + 1].mean(0).tolist(), 0.0, 0.0
        out[i] = x, y
    return out


def moving_state(time: np.ndarray, speed: np.ndarray, move: float, stop: float, hold: float) -> np.ndarray:
    """Whether a vehicle moves: it starts after ``hold`` seconds faster than move, and stops after as
    long slower than stop."""
    out, state, since = np.zeros(len(time), bool), False, None
    for i in range(len(time)):
        turning = speed[i] < stop if state else speed[i] > move
        since = (time[i] if since is None else since) if turning else None
        if since is not None and time[i] - since >= hold:
            state, since = not state, None
        out[i] = state
    return out


def kalman_track(df: DataFrame, t: Track, lat: str, lon: str, speed: str, time: str = "elapsed_time_s", *, move: float = 1.0, stop: float = 0.5, hold: float = 3.0, window: int = 5, q: float = 1e-5, r: float = 1e-3, split: int | None = None) -> DataFrame:
    """is_moving, and smoothed places: a Kalman filter while moving, a mean while standing. Every
    row keeps its own place in the order. split: rows of a chunk, for tracks that are too long for one task; times
    and places must be there then."""
    a, b = f"{lat}_smoothed_kalman", f"{lon}_smoothed_kalman"
    if split:
        added, p0 = [("is_moving", T.BooleanType()), (a, _D), (b, _D)], 100.0
        step = lambda c, before: np.diff(c[time], prepend=c[time][:1])[before:]
        both = lambda c: np.column_stack([c[lat], c[lon]])

        def make(c: dict[str, np.ndarray], before: int, after: int) -> scans.Moving:
            return scans.Moving(c[time][before:], c[speed][before:], move, stop, hold)

        def covariances(c: dict[str, np.ndarray], before: int, extra: tuple) -> np.ndarray:
            return scans.covariance_product(scans.covariance_steps(step(c, before), extra[0].moves(*extra[1:3]), q, r, p0))

        def places(c: dict[str, np.ndarray], before: int, extra: tuple) -> np.ndarray:
            xy, n, on = both(c), len(c[time]), extra[0].moves(*extra[1:3])
            total = np.concatenate([np.zeros((1, 2)), np.cumsum(xy - xy[0], 0)])
            low = np.maximum(np.arange(before, n) + 1 - window, 0)
            rest = xy[0] + (total[before + 1 :] - total[low]) / (np.arange(before, n) + 1 - low)[:, None]
            dt = step(c, before)
            return scans.place_map(xy[before:], dt, on, rest, scans.gains(dt, on, q, r, p0, tuple(extra[3].tolist())))

        def finish(c: dict[str, np.ndarray], before: int, extra: tuple) -> dict:
            moving, nodes, going, cov, x = extra
            on = moving.moves(nodes, going)
            xy = kalman_2d(both(c), step(c, before), on, q, r, p0, window, (x.reshape(2, 2), cov), before)
            return {"is_moving": on, a: xy[:, 0], b: xy[:, 1]}

        passes = [(covariances, lambda flat: scans.covariance_states(flat, p0)), (places, scans.place_states)]
        out = scans.filtered(df, t, [time, speed, lat, lon], split, window - 1, passes, finish, added, make)
        return out.select(*[c for c in df.columns if c not in {n for n, _ in added}], *[n for n, _ in added])

    def kernel(c: dict[str, np.ndarray]) -> tuple:
        s = c[time]
        on = moving_state(s, c[speed], move, stop, hold)
        xy = kalman_2d(np.column_stack([c[lat], c[lon]]), np.diff(s, prepend=s[:1]), on, q, r, window=window)
        return None, {"is_moving": on, a: xy[:, 0], b: xy[:, 1]}

    return per_track(df, t, [time, speed, lat, lon], kernel, [("is_moving", T.BooleanType()), (a, _D), (b, _D)])


#: Of the counter: a prime, and factors of key, step, particle and number, below it. Steps drawn at once.
PRIME, FACTORS = 2_147_483_647, (1_103_515_245, 1_664_525_917, 742_938_285, 950_706_376)
DRAWN = 4


def _folded(k: np.ndarray, times: int) -> np.ndarray:
    """k modulo the prime, 2^31 - 1, in place by shifts; the prime may stand for 0."""
    for _ in range(times):
        high = k >> 31
        k &= PRIME
        k += high
    return k


def uniforms(key: int, step: int | np.ndarray, particle: np.ndarray, number: int | np.ndarray) -> np.ndarray:
    """Random numbers in (0, 1) from a counter, the same wherever they are drawn: the fifth power, a permutation
    of the numbers below the prime, of a sum that every counter changes."""
    k = _folded((key * FACTORS[0] + step * FACTORS[1] + number * FACTORS[3]) % PRIME + particle * FACTORS[2] % PRIME, 1)
    power = _folded(k * k, 2)
    power *= power
    _folded(power, 2)
    power *= k
    _folded(power, 2)
    power[power == PRIME] = 0
    return (power + 0.5) / PRIME


def normals(key: int, steps: np.ndarray, n: int) -> np.ndarray:
    """For each step 4 x n from pairs of uniform numbers."""
    u = uniforms(key, steps[:, None, None], np.arange(n, dtype=np.int64), np.arange(4)[:, None])
    size, turn = np.sqrt(-2 * np.log(u[:, ::2])), 2 * np.pi * u[:, 1::2]
    out = np.empty_like(u)
    out[:, ::2], out[:, 1::2] = size * np.cos(turn), size * np.sin(turn)
    return out


def particle_filter(df: DataFrame, t: Track, lat: str, lon: str, speed: str, acceleration: str | None = None, *, particles: int = 1000, noise: tuple[float, ...] = (1e-4, 1e-4, 0.1, 0.1), sight: tuple[float, ...] = (1e-4, 1e-4, 0.1, 0.1), seed: int = 0) -> DataFrame:
    """Smoothed places, pf_speed and pf_acc: the mean of particles (lat, lon, speed, acceleration) on a
    random walk, weighted by what is seen and then resampled systematically. noise, sight: standard
    deviations of a step and of a sight. Without an acceleration column none is seen, and it starts at
    0. Random numbers are a function of the track, the seed, the step and the particle, so results repeat wherever
    a track is worked on."""
    a, b = f"{lat}_smoothed_particule", f"{lon}_smoothed_particule"
    seen = [lat, lon, speed] + ([acceleration] if acceleration else [])
    k, step, spread = len(seen), np.array(noise)[:, None], np.array(sight)[:, None]

    def kernel(c: dict[str, np.ndarray]) -> tuple:
        key = int(c["_key"][0])
        z = np.column_stack([c[x] for x in seen])[:, :, None]
        x = np.zeros((4, 1))
        x[:k] = z[0]
        x = x + np.sqrt(10) * spread * normals(key, np.zeros(1, np.int64), particles)[0]
        out = np.empty((len(z), 4))
        shift = uniforms(key, np.arange(1, len(z) + 1), np.zeros(1, np.int64), 4)
        for i in range(len(z)):
            if i % DRAWN == 0:
                moves = step * normals(key, np.arange(i + 1, min(i + DRAWN, len(z)) + 1), particles)
            x = x + moves[i % DRAWN]
            e = (((x[:k] - z[i]) / spread[:k]) ** 2).sum(0)
            w = np.cumsum(np.exp(-0.5 * (e - e.min())))
            upto = np.maximum(np.ceil(w / w[-1] * particles - shift[i]), 0).astype(int)  # of the evenly spaced places, how many lie below each weight's end
            upto[-1] = particles
            x = np.take(x, np.bincount(upto, minlength=particles)[:particles].cumsum(), axis=1)
            out[i] = x.mean(1)
        return None, {a: out[:, 0], b: out[:, 1], "pf_speed": out[:, 2], "pf_acc": out[:, 3]}

    key = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(t.track).cast("string"), F.lit("")))), 1, 7), 16, 10).cast("long")
    return per_track(df.withColumn("_key", key), t, [*seen, "_key"], kernel, [(a, _D), (b, _D), ("pf_speed", _D), ("pf_acc", _D)], keep=df.columns)


# Way along a spline


def cubic_spline(t: np.ndarray, y: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """The interpolating cubic spline through all places with no bend at its ends; a line for two. Its
    tridiagonal system is eliminated in one pass up and one down, so n places cost n steps."""
    n, h = len(t), np.diff(t)
    m = np.zeros_like(y, float)
    if n > 2:
        slope = np.diff(y, axis=0) / h[:, None]
        rhs, steps = (6 * np.diff(slope, axis=0)).tolist(), h.tolist()
        c, d = [0.0] * (n - 2), [[0.0] * y.shape[1]] * (n - 2)
        before, above = 0.0, [0.0] * y.shape[1]
        for i in range(n - 2):
            pivot = 2 * (steps[i] + steps[i + 1]) - steps[i] * before
            above = [(b - steps[i] * a) / pivot for a, b in zip(above, rhs[i], strict=True)]
            before = steps[i + 1] / pivot
            c[i], d[i] = before, above
        below = [0.0] * y.shape[1]
        for i in range(n - 3, -1, -1):
            below = [a - c[i] * b for a, b in zip(d[i], below, strict=True)]
            m[i + 1] = below

    def at(q: np.ndarray) -> np.ndarray:
        k = np.clip(np.searchsorted(t, q, side="right") - 1, 0, n - 2)
        u, w, g = (t[k + 1] - q)[:, None], (q - t[k])[:, None], h[k][:, None]
        return m[k] * u**3 / (6 * g) + m[k + 1] * w**3 / (6 * g) + (y[k] / g - m[k] * g / 6) * u + (y[k + 1] / g - m[k + 1] * g / 6) * w

    return at


def spline_steps(lat: np.ndarray, lon: np.ndarray, samples: int = 100, at_once: int = 10_000) -> np.ndarray:
    """Metres from each row to the next along the cubic spline through all places (local plane), as a
    polygon of so many samples a step; at_once: steps sampled at once."""
    n = len(lat)
    if n < 2:
        return np.zeros(0)
    x = 6_371_000.0 * np.radians(lon - lon[0]) * np.cos(np.radians(lat.mean()))
    f = cubic_spline(np.arange(n, dtype=float), np.column_stack([x, 6_371_000.0 * np.radians(lat - lat[0])]))
    inner, out = np.linspace(0, 1, samples), []
    for a in range(0, n - 1, at_once):
        starts = np.arange(a, min(a + at_once, n - 1), dtype=float)
        q = f((starts[:, None] + inner).ravel()).reshape(len(starts), samples, 2)
        out.append(np.hypot(*np.moveaxis(np.diff(q, axis=1), 2, 0)).sum(1))
    return np.concatenate(out)


def spline_curvature(df: DataFrame, t: Track, lat: str, lon: str, yaw: str, *, samples: int = 100) -> DataFrame:
    """spline_distance (metres to the next row) and curvature_spline: the unwrapped change of a yaw angle
    over it (0 without way); null in the last row."""

    def kernel(c: dict[str, np.ndarray]) -> tuple:
        ds = spline_steps(c[lat], c[lon], samples)
        turn = np.unwrap(np.diff(np.radians(c[yaw])))
        k = np.divide(turn, ds, out=np.zeros_like(ds), where=ds > 0)
        return None, {"spline_distance": [*ds, None], "curvature_spline": [*k, None]}

    return per_track(df, t, [lat, lon, yaw], kernel, [("spline_distance", _D), ("curvature_spline", _D)])
