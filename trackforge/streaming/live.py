"""The same semantics on streams: tumbling means with a watermark, and stops and moves per track as
their pieces close."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trackforge.operators.resample import bucket_mean
from trackforge.operators.sequential import LOOK_AHEAD, SPEED_BINS, pieces, speed_class


def live_means(stream: DataFrame, track: str, ts: str, step: str, late: str, *columns: str) -> DataFrame:
    """bucket_mean() of a stream; rows later than ``late`` are dropped and closed buckets come out."""
    return bucket_mean(stream.withWatermark(ts, late), track, ts, step, *columns)


_PIECE = "{} {}, start double, finish double, segment_marker string, lat double, lon double, speed double, rows long"
_STATE = "time array<double>, lat array<double>, lon array<double>, speed array<double>"


def _close(track: object, buf: list[np.ndarray], ripe: int, end: bool, max_stop: float) -> tuple[list[tuple], list[np.ndarray]]:
    """The pieces of the first ``ripe`` rows that can't change any more, and the rows after them. end: none will follow."""
    time, lat, lon, speed = (x[:ripe] for x in buf)
    out, upto = [], 0
    for i, j, stop in pieces(time, speed, SPEED_BINS, max_stop) if ripe else []:
        if not end and j + LOOK_AHEAD > ripe:
            break
        v = float(speed[i:j].mean())
        out.append((track, time[i], time[j - 1], "STOP" if stop else f"MOVING_{speed_class(v, SPEED_BINS)}", lat[i:j].mean(), lon[i:j].mean(), v, j - i))
        upto = j
    return out, [x[upto:] for x in buf]


def live_stops(stream: DataFrame, *, track: str = "track_id", ts: str = "ts", late: str = "10 seconds", idle: float = 600.0, max_stop: float = 300.0) -> DataFrame:
    """Pieces of stop and move of each track, as soon as they can't change any more: when LOOK_AHEAD rows past
    their end are older than the watermark, or ``idle`` seconds of it have passed since the track's last row. Start and finish
    are seconds since 1970. stream: track, ts (a timestamp), lat, lon, speed, in any order within ``late``; rows that are
    later still are dropped. The result is that of whole tracks in order. Speeds are taken as they are.

    A track's state is its rows since the last closed piece, in order of time. Timers are of event time, so a stream
    that is read again gives the same pieces.
    """
    names = (ts, "lat", "lon", "speed")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buf = [np.array(x, float) for x in state.get] if state.exists else [np.zeros(0)] * 4
        now = state.getCurrentWatermarkMs() / 1000
        if not state.hasTimedOut:
            for f in frames:
                f = f.assign(**{ts: f[ts].astype("datetime64[us]").astype("int64") / 1e6})
                buf = [np.concatenate([b, f[c].to_numpy(float)]) for b, c in zip(buf, names, strict=True)]
            order = np.argsort(buf[0], kind="stable")
            buf = [b[order] for b in buf]
        over = bool(len(buf[0])) and state.hasTimedOut and buf[0][-1] + idle <= now
        ripe = len(buf[0]) if over else int(np.searchsorted(buf[0], now))
        rows, buf = _close(key[0], buf, ripe, over, max_stop)
        if len(buf[0]):
            state.update(tuple(b.tolist() for b in buf))
            state.setTimeoutTimestamp(int(max(buf[0][-1] + idle, now + 0.001) * 1000) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(rows, columns=[track, "start", "finish", "segment_marker", "lat", "lon", "speed", "rows"])

    d = stream.select(track, ts, "lat", "lon", "speed").withWatermark(ts, late)
    return d.groupBy(track).applyInPandasWithState(step, _PIECE.format(track, dict(stream.dtypes)[track]), _STATE, "append", GroupStateTimeout.EventTimeTimeout)
