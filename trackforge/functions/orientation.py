"""Direction of a line at a place, from a spline through samples along it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Metres to either side of the place, and how many samples.
REACH, SAMPLES = 10.0, 7


def bends(n: int) -> np.ndarray:
    """n x n: second derivatives, at n evenly spaced places a unit apart, of the cubic spline through values there.
    Its first two pieces are one cubic, and so are its last two."""
    a, b = np.zeros((n, n)), np.zeros((n, n))
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = 1 / 6, 4 / 6, 1 / 6
        b[i, i - 1 : i + 2] = 1, -2, 1
    a[0, :3] = a[-1, -3:] = 1, -2, 1  # the third derivative doesn't jump at the second place
    return np.linalg.solve(a, b)


def slope_weights(u: np.ndarray, n: int = SAMPLES) -> np.ndarray:
    """len(u) x n: the spline's slope at places u (in steps, from 0 to n - 1) as weights of its values."""
    k = np.clip(np.floor(u).astype(int), 0, n - 2)
    t, m, one = (u - k)[:, None], bends(n), np.eye(n)
    return one[k + 1] - one[k] + ((3 * t * t - 1) * m[k + 1] - (3 * (1 - t) ** 2 - 1) * m[k]) / 6


def angles(x: np.ndarray, y: np.ndarray, offsets: np.ndarray, px: np.ndarray, py: np.ndarray, reach: float = REACH, samples: int = SAMPLES) -> np.ndarray:
    """Degrees in [0, 180) of each line at its place (px, py): vertices of all lines one after another, line i from
    offsets[i] to offsets[i + 1]. Lines without length have none (NaN)."""
    n = len(px)
    out = np.full(n, np.nan)
    line = np.repeat(np.arange(n), np.diff(offsets))
    a = np.flatnonzero(line[1:] == line[:-1])  # pieces begin here
    dx, dy = x[a + 1] - x[a], y[a + 1] - y[a]
    size = np.hypot(dx, dy)
    good = size > 0
    a, dx, dy, size, own = a[good], dx[good], dy[good], size[good], line[a[good]]
    if not len(a):
        return out
    u = np.clip(((px[own] - x[a]) * dx + (py[own] - y[a]) * dy) / (size * size), 0, 1)
    away = np.hypot(px[own] - x[a] - u * dx, py[own] - y[a] - u * dy)
    begin = np.flatnonzero(np.diff(own, prepend=-1))  # the first piece of each line that has any
    lines = own[begin]
    best = np.lexsort((np.arange(len(own)), np.where(np.isnan(away), np.inf, away), own))[begin]
    upto = np.cumsum(size)
    start = upto - size
    low, high = start[begin], upto[np.append(begin[1:], len(own)) - 1]
    at = start[best] + u[best] * size[best]
    left, right = np.maximum(at - reach, low), np.minimum(at + reach, high)
    q = left[:, None] + (right - left)[:, None] * np.linspace(0, 1, samples)
    piece = np.clip(np.searchsorted(upto, q), begin[:, None], np.append(begin[1:], len(own))[:, None] - 1)
    t = np.clip((q - start[piece]) / size[piece], 0, 1)
    step = (right - left) / (samples - 1)
    w = slope_weights(np.nan_to_num(np.clip((at - left) / np.where(step > 0, step, 1), 0, samples - 1)), samples)
    sx, sy = ((w * (v[a[piece]] + t * d[piece])).sum(1) for v, d in ((x, dx), (y, dy)))
    angle = np.degrees(np.arctan2(sy, sx)) % 180.0
    out[lines] = np.where((right - left >= 1e-6) & ~np.isnan(px[lines] + py[lines]), np.where(angle == 180.0, 0.0, angle), np.nan)
    return out


@F.arrow_udf(DoubleType())
def line_angle_at(geometry: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
    """Direction of each line (array of struct<x, y>) at a place; null without either."""
    size = np.nan_to_num(pc.list_value_length(geometry).to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = geometry.flatten()
    vx, vy = (flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y"))
    found = angles(vx, vy, np.concatenate([[0], np.cumsum(size)]), *(v.to_numpy(zero_copy_only=False).astype(float) for v in (x, y)))
    return pa.array(found, from_pandas=True)
