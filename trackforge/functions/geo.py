"""Geodesy as Column functions; the exact geodesic is a vectorised UDF."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

EARTH_M = 6_371_000.0
#: WGS84
A, FLAT = 6_378_137.0, 1 / 298.257223563
N3 = FLAT / (2 - FLAT)  # third flattening
E2 = FLAT * (2 - FLAT)
UTM_SCALE, UTM_EAST, UTM_SOUTH = 0.9996, 500_000.0, 10_000_000.0

#: Krüger's series to order 6 in the third flattening, from conformal to rectifying coordinates.
_KRUEGER = (
    (1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800),
    (13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360),
    (61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440),
    (49561 / 161280, -179 / 168, 6601661 / 7257600),
    (34729 / 80640, -3418889 / 1995840),
    (212378941 / 319334400,),
)
ALPHA = tuple(sum(c * N3 ** (k + 1 + i) for i, c in enumerate(row)) for k, row in enumerate(_KRUEGER))
RECTIFYING = A / (1 + N3) * (1 + N3**2 / 4 + N3**4 / 64 + N3**6 / 256)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_M) -> Column:
    """Great-circle distance in metres."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.when(h.isNotNull(), 2 * radius * F.asin(F.least(F.sqrt(h), F.lit(1.0))))  # least() passes over nulls


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial great-circle bearing from point 1 to point 2, in [-180, 180]."""
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.degrees(F.atan2(F.sin(dl) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)))


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Spherical web Mercator (x, y)."""
    return A * F.radians(lon), A * F.log(F.tan(math.pi / 4 + F.radians(lat) / 2))


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """(lon, lat) in degrees."""
    return F.degrees(x / A), F.degrees(2 * F.atan(F.exp(y / A)) - math.pi / 2)


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180.0) / 6.0) + 1).cast("int")


def to_utm(lon: Column, lat: Column, zone: Column, north: Column) -> tuple[Column, Column]:
    """Transverse Mercator (x, y) in a UTM zone."""
    e = math.sqrt(E2)
    dl, s = F.radians(lon - (zone * 6 - 183)), F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi0, eta0 = F.atan2(t, F.cos(dl)), F.asinh(F.sin(dl) / F.sqrt(t * t + F.cos(dl) * F.cos(dl)))
    xi, eta = xi0, eta0
    for k, a in enumerate(ALPHA, 1):
        xi = xi + a * F.sin(2 * k * xi0) * F.cosh(2 * k * eta0)
        eta = eta + a * F.cos(2 * k * xi0) * F.sinh(2 * k * eta0)
    scale = UTM_SCALE * RECTIFYING
    return UTM_EAST + scale * eta, scale * xi + F.when(north, 0.0).otherwise(UTM_SOUTH)


def geodesic(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """Vincenty's inverse on WGS84, in metres; nearly antipodal points, where it doesn't settle, get
    the great circle. NaN in, NaN out."""
    b = A * (1 - FLAT)
    u1, u2 = (np.arctan((1 - FLAT) * np.tan(np.radians(x))) for x in (lat1, lat2))
    dl = np.radians(lon2 - lon1)
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam, out = dl.copy(), np.full(len(dl), np.nan)
    with np.errstate(all="ignore"):
        for _ in range(100):
            sl, cl = np.sin(lam), np.cos(lam)
            ss = np.sqrt((c2 * sl) ** 2 + (c1 * s2 - s1 * c2 * cl) ** 2)
            cs = s1 * s2 + c1 * c2 * cl
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss == 0, 0.0, c1 * c2 * sl / ss)
            c2a = 1 - sa * sa
            cm = np.where(c2a == 0, 0.0, cs - 2 * s1 * s2 / c2a)
            c = FLAT / 16 * c2a * (4 + FLAT * (4 - 3 * c2a))
            new = dl + (1 - c) * FLAT * sa * (sigma + c * ss * (cm + c * cs * (2 * cm * cm - 1)))
            done = ~(np.abs(new - lam) > 1e-12)
            lam = new
            if done.all():
                break
        us = c2a * (A * A - b * b) / (b * b)
        big = 1 + us / 16384 * (4096 + us * (-768 + us * (320 - 175 * us)))
        small = us / 1024 * (256 + us * (-128 + us * (74 - 47 * us)))
        ds = small * ss * (cm + small / 4 * (cs * (2 * cm * cm - 1) - small / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))
        out = np.where(ss == 0, 0.0, b * big * (sigma - ds))
        h = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(dl / 2) ** 2
        far = 2 * EARTH_M * np.arcsin(np.minimum(1, np.sqrt(h)))
    out = np.where(done, out, far)
    return np.where(np.isnan(lat1 + lat2 + lon1 + lon2), np.nan, out)


@F.pandas_udf(DoubleType())
def geodesic_m(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    return pd.Series(geodesic(*(x.to_numpy(float) for x in (lat1, lon1, lat2, lon2)))).replace({np.nan: None})
