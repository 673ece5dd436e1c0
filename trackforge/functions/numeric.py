"""Column functions for numbers and angles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def ieee_div(a: Column, b: Column) -> Column:
    """a / b with a signed infinity for b = 0 and null for 0 / 0, under ANSI mode too."""
    return F.when(b != 0, a / b).when(a > 0, INF).when(a < 0, -INF)


def is_inf(c: Column) -> Column:
    return F.abs(c) == INF


def finite(c: Column) -> Column:
    """c, or null where it is infinite or NaN."""
    return F.when(~F.isnan(c) & ~is_inf(c), c)


def replace_inf(c: Column, plus: float | None = None, minus: float | None = None) -> Column:
    """c with other values (null by default) in place of the infinities."""
    return F.when(c == INF, F.lit(plus)).when(c == -INF, F.lit(minus)).otherwise(c)


def wrap_deg(d: Column) -> Column:
    """An angle difference in [-180, 180)."""
    return F.pmod(d + 180.0, F.lit(360.0)) - 180.0


def compass(dx: Column, dy: Column) -> Column:
    """Heading of a step, clockwise from north, in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))


def undirected_gap(a: Column, b: Column) -> Column:
    """Angle between two lines without direction, in [0, 90]."""
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(d, 180.0 - d)


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.when(c < lo, lo).when(c > hi, hi).otherwise(c)


def min_max_scale(c: Column, lo: Column, hi: Column, flat: float = 0.5) -> Column:
    """Where c lies between lo and hi, 0 to 1; ``flat`` if they are equal."""
    return F.when(hi > lo, (c - lo) / (hi - lo)).when(c.isNotNull(), F.lit(flat))


def symmetric_scale(c: Column, largest: Column) -> Column:
    """Where c lies between -largest and largest, 0 to 1; 0.5 if largest is 0."""
    return F.when(largest > 0, (c + largest) / (2 * largest)).when(c.isNotNull(), F.lit(0.5))


def vertices_radius(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Radius of the circle through three points; infinite if they are in line, null if one is."""
    a, b, c = F.hypot(bx - cx, by - cy), F.hypot(ax - cx, ay - cy), F.hypot(ax - bx, ay - by)
    s = (a + b + c) / 2
    area = F.sqrt(F.greatest(s * (s - a) * (s - b) * (s - c), F.lit(0.0)))
    return F.when(s.isNotNull(), F.when(area > 0, a * b * c / (4 * area)).when(area == 0, INF))  # greatest() passes over nulls


def compass_to_math(deg: Column) -> Column:
    """Radians counter-clockwise from east of a compass angle."""
    return F.radians(90.0 - deg)


def arrow(deg: Column, length: float = 10.0) -> tuple[Column, Column]:
    """(dx, dy) of an arrow in the direction of a compass angle."""
    a = compass_to_math(deg)
    return length * F.cos(a), length * F.sin(a)


def kmh(ms: Column) -> Column:
    return ms * 3.6


def try_number(c: Column) -> Column:
    """c as a number, null where it isn't one."""
    return F.nanvl(c.cast("string").try_cast("double"), F.lit(None).cast("double"))


TAU = 2 * math.pi
