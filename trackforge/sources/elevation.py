"""Elevation of places: from a grid of heights by a join, or from a service in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def from_grid(points: DataFrame, grid: DataFrame, cell: float, *, lat: str = "GPS_lat", lon: str = "GPS_lon") -> DataFrame:
    """points with elevation: that of the grid's cell (iy, ix, elevation), null outside."""
    at = lambda c: F.floor(F.col(c) / cell).cast("long")
    g = grid.select(F.col("iy").cast("long").alias("_iy"), F.col("ix").cast("long").alias("_ix"), "elevation")
    return points.withColumns({"_iy": at(lat), "_ix": at(lon)}).join(g, ["_iy", "_ix"], "left").drop("_iy", "_ix")


def from_service(points: DataFrame, ask: Callable[[list[tuple[float, float]]], list[float | None]], *, lat: str = "GPS_lat", lon: str = "GPS_lon", batch: int = 280, threads: int = 10) -> DataFrame:
    """points with elevation from ask(), which gets at most ``batch`` (lat, lon) at once. A batch that
    fails, or gets another number of answers, has nulls; rows keep their order."""
    schema = T.StructType([*points.schema.fields, T.StructField("elevation", T.DoubleType())])

    def one(places: list) -> list:
        try:
            got = list(ask(places))
        except Exception:  # the service's errors are its own; the batch is without answer
            got = []
        return got if len(got) == len(places) else [None] * len(places)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for p in frames:
                places = list(zip(p[lat].tolist(), p[lon].tolist(), strict=True))
                parts = pool.map(one, [places[i : i + batch] for i in range(0, len(places), batch)])
                yield p.assign(elevation=pd.Series([v for part in parts for v in part], index=p.index, dtype="float64"))

    return points.mapInPandas(run, schema)
