"""Statistics of a table. Each is one aggregation, however many columns there are."""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackforge.functions.numeric import is_inf

NUMERIC = ("double", "float", "bigint", "int", "smallint", "tinyint")


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, k in df.dtypes if k in NUMERIC or k.startswith("decimal")]


def _long(df: DataFrame, stats: dict[str, dict[str, Column]]) -> DataFrame:
    """One row per column from one aggregation. stats: column -> name -> aggregate."""
    names = list(next(iter(stats.values()))) if stats else []
    one = df.agg(*[F.struct(*[a.alias(n) for n, a in s.items()]).alias(f"_{i}") for i, s in enumerate(stats.values())])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"_{i}.{n}").alias(n) for n in names]) for i, c in enumerate(stats)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def null_and_zero_counts(df: DataFrame) -> DataFrame:
    """column, rows, nulls, zeros (null for columns that aren't numbers)."""
    numbers = set(numeric_columns(df))
    stat = lambda c: {"rows": F.count(F.lit(1)), "nulls": F.count_if(F.col(c).isNull()), "zeros": F.count_if(F.col(c) == 0) if c in numbers else F.max(F.lit(None).cast("long"))}
    return _long(df, {c: stat(c) for c in df.columns})


BINS = 2048  # that a range is cut into in each pass of a selection


def _number(c: str) -> Column:
    """A column's values as doubles, without infinities and NaN."""
    v = F.col(c).cast("double")
    return F.when(~is_inf(v) & ~F.isnan(v), v)


def quantiles(df: DataFrame, wanted: dict[str, list[float]]) -> dict[str, list[float | None]]:
    """Exact interpolated quantiles of columns, by radix selection from the top of a double down. The first pass
    counts values by sign and power of two; each later one cuts the ranges in question into BINS and keeps the
    bin with the rank asked for, until its smallest and largest values are one. 52 bits of a fraction take five
    of these, so there are six passes at most, whatever the values. Counts are added up within tasks; only
    bounds of bins come to the driver. The columns are made once and held while it lasts."""
    held = df.select(*[_number(c).alias(f"v{i}") for i, c in enumerate(wanted)]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _select(held, wanted)
    finally:
        held.unpersist()


def _histogram(held: DataFrame, bins: list[Column]) -> dict[int, list]:
    """For each column of bins (structs of i, bin, v), its bins in order, with counts and bounds."""
    p = F.explode(F.array(*bins)).alias("p")
    rows = held.select(p).where("p is not null").groupBy("p.i", "p.bin").agg(F.count(F.lit(1)).alias("n"), F.min("p.v").alias("lo"), F.max("p.v").alias("hi")).collect()
    out: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["i"], r["bin"])):
        out.setdefault(r["i"], []).append(r)
    return out


def _select(held: DataFrame, wanted: dict[str, list[float]]) -> dict[str, list[float | None]]:
    def power(i: int) -> Column:
        v = F.col(f"v{i}")
        size = (F.floor(F.log2(F.abs(v))) + 1076).cast("int")  # doubles begin at 2 ** -1074
        return F.when(v.isNotNull(), F.struct(F.lit(i).alias("i"), F.when(v > 0, size).when(v < 0, -size).otherwise(0).alias("bin"), v.alias("v")))

    def place(i: int, c: int, lo: float, hi: float) -> Column:
        v = F.col(f"v{c}")
        bin_ = F.least(F.floor((v - lo) / (hi / BINS - lo / BINS)), F.lit(BINS - 1)).cast("int")
        return F.when(v.between(lo, hi), F.struct(F.lit(i).alias("i"), F.when(v == hi, BINS).otherwise(bin_).alias("bin"), v.alias("v")))

    def narrowed(bins: list, rank: int, at: int) -> tuple[float, float, int]:
        for r in bins:
            if rank < at + r["n"]:
                return r["lo"], r["hi"], at
            at += r["n"]
        raise AssertionError("a rank beyond the counts")

    number_of = {c: i for i, c in enumerate(wanted)}
    first = _histogram(held, [power(i) for i in number_of.values()])
    counts = {c: sum(r["n"] for r in first.get(i, [])) for c, i in number_of.items()}
    found: dict[tuple[str, int], float] = {}
    open_: dict[tuple[str, int], tuple[float, float, int]] = {}  # (column, rank) -> range, and how many values are below it
    for c, qs in wanted.items():
        for q in qs if counts[c] else ():
            for rank in {math.floor((counts[c] - 1) * q), math.ceil((counts[c] - 1) * q)}:
                open_[c, rank] = narrowed(first[number_of[c]], rank, 0)
    while open_:
        for key in [k for k, (lo, hi, _) in open_.items() if lo == hi]:
            found[key] = open_.pop(key)[0]
        ranges = sorted({(c, lo, hi, below) for (c, _), (lo, hi, below) in open_.items()})
        if not ranges:
            break
        bins = _histogram(held, [place(i, number_of[c], lo, hi) for i, (c, lo, hi, _) in enumerate(ranges)])
        at = {x: i for i, x in enumerate(ranges)}
        for (c, rank), (lo, hi, below) in list(open_.items()):
            open_[c, rank] = narrowed(bins[at[c, lo, hi, below]], rank, below)
    out = {}
    for c, qs in wanted.items():
        n = counts[c]
        at = lambda q, n=n, c=c: ((n - 1) * q - math.floor((n - 1) * q), found[c, math.floor((n - 1) * q)], found[c, math.ceil((n - 1) * q)])
        out[c] = [None if not n else a + u * (b - a) for u, a, b in map(at, qs if n else ())] or [None] * len(qs)
    return out


def describe(df: DataFrame, *columns: str) -> DataFrame:
    """column, count, mean, std (of a sample), min, q25, q50, q75, max, without infinities. Quartiles
    are exact; they are looked for at once, the rest when the table is read."""
    names = list(columns or numeric_columns(df))
    found = quantiles(df, {c: [0.25, 0.5, 0.75] for c in names})

    def stat(c: str) -> dict[str, Column]:
        v = _number(c)
        q = [F.max(F.lit(x).cast("double")) for x in found[c]]
        return {"count": F.count(v), "mean": F.avg(v), "std": F.stddev_samp(v), "min": F.min(v), "q25": q[0], "q50": q[1], "q75": q[2], "max": F.max(v)}

    return _long(df, {c: stat(c) for c in names})


def time_span(df: DataFrame, ts: str) -> DataFrame:
    return df.agg(F.count(ts).alias("non_null"), F.min(ts).alias("first_time"), F.max(ts).alias("last_time"))


def entries_per_day(df: DataFrame, ts: str) -> DataFrame:
    """day, entries; busiest day first."""
    return df.where(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("entries")).orderBy(F.desc("entries"), "day")


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def joint_range(df: DataFrame, *columns: str) -> DataFrame:
    """lo, hi: smallest and largest value of all the columns together."""
    least = F.least if len(columns) > 1 else lambda c: c
    most = F.greatest if len(columns) > 1 else lambda c: c
    return df.agg(least(*[F.min(c) for c in columns]).alias("lo"), most(*[F.max(c) for c in columns]).alias("hi"))


def padded_range(df: DataFrame, column: str, share: float = 0.1) -> DataFrame:
    """lo, hi: a column's range with a share of its width added on both sides."""
    return df.agg(F.min(column).alias("a"), F.max(column).alias("b")).select((F.col("a") - share * (F.col("b") - F.col("a"))).alias("lo"), (F.col("b") + share * (F.col("b") - F.col("a"))).alias("hi"))


def report(df: DataFrame, ts: str | None = None) -> DataFrame:
    """All statistics as a table: item (rows, nulls, zeros, and those of describe(); with ts, entries), of (a
    column, or a day), value."""
    tall = lambda d, key, *names: d.unpivot([key], [F.col(n).cast("double").alias(n) for n in names], "item", "value").select("item", F.col(key).cast("string").alias("of"), "value")
    parts = [tall(null_and_zero_counts(df), "column", "rows", "nulls", "zeros")]
    if numeric_columns(df):
        parts.append(tall(describe(df), "column", "count", "mean", "std", "min", "q25", "q50", "q75", "max"))
    if ts:
        parts.append(tall(entries_per_day(df, ts), "day", "entries"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("value").isNotNull())


def provenance(df: DataFrame, seq: str = "seq") -> dict:
    """The smoothing method and spacing that a processed log names in its first row."""
    have = [c for c in ("selected_smoothing_method", "min_distance") if c in df.columns]
    row = df.agg(*[F.min_by(c, seq).alias(c) for c in have]).first().asDict() if have else {}
    return {"selected_smoothing_method": row.get("selected_smoothing_method") or "default_smoothing_method", "min_distance": row.get("min_distance") or 0}
