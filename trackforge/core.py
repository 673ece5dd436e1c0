"""What a track is, and the rules on null, NaN and infinity that every operator keeps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


@dataclass(frozen=True)
class Track:
    """Rows of one ``track`` are ordered by ``seq``. Spark has no row order, so both are needed."""

    track: str = "track_id"
    seq: str = "seq"

    @property
    def w(self) -> WindowSpec:
        return Window.partitionBy(self.track).orderBy(self.seq)

    @property
    def whole(self) -> WindowSpec:
        return Window.partitionBy(self.track)

    def back(self, n: int, m: int = 0) -> WindowSpec:
        return self.w.rowsBetween(n, m)

    @property
    def upto(self) -> WindowSpec:
        return self.w.rowsBetween(Window.unboundedPreceding, 0)


def with_seq(df: DataFrame, track: str, *order: str, to: str = "seq") -> DataFrame:
    """Number the rows of each track from 1 in the order given; the last columns break ties."""
    return df.withColumn(to, F.row_number().over(Window.partitionBy(track).orderBy(*order)))


def nan_to_null(df: DataFrame, *columns: str) -> DataFrame:
    """NaN becomes null once, on the way in: Spark's aggregates and comparisons count NaN as a number."""
    floats = [c for c, kind in df.dtypes if kind in ("double", "float") and (not columns or c in columns)]
    return df.withColumns({c: F.nanvl(F.col(f"`{c}`"), F.lit(None).cast("double")) for c in floats})
