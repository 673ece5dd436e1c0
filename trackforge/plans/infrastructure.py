"""Bridges, tunnels and the railways at them, from ways to one table; all regions in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackforge.operators import spatial


def _lines(ways: DataFrame, kind: str) -> DataFrame:
    return ways.where(F.col("kind") == kind)


def _shapes(lines: DataFrame, *also: str) -> DataFrame:
    """id (the smallest), geometry: one line of each geometry (and of each value of the columns ``also``)."""
    return lines.groupBy("geometry", *also).agg(F.min("id").alias("id"))


def bridges(ways: DataFrame, radius: float = 10.0, *, rule: str = "orientation") -> DataFrame:
    """id, geometry, position: bridges with a railway under (by the orientation of the crossing segments, or
    by that of splines along both lines) or below (by layer) them. ways: id, kind, layer, geometry in degrees."""
    also = ["layer"] if rule == "layer" else []
    b, r = (spatial.to_mercator_lines(_shapes(_lines(ways, kind), *also)) for kind in ("bridge", "railway"))
    bs = spatial.segments(b.withColumnRenamed("id", "bridge"), "bridge", "geometry", *also)
    rs = spatial.segments(r.withColumnRenamed("id", "rail"), "rail", "geometry", *also)
    pairs = spatial.lines_near(bs, rs, radius, "bridge", "rail", cell=200.0)
    if rule == "orientation":
        kept = spatial.any_under(spatial.by_parallelism(pairs, "bridge", "rail"), "bridge").where("position = 'under'")
    elif rule == "spline":
        of = lambda d, name: d.select(F.col("id").alias(name), "geometry")
        kept = spatial.any_under(spatial.by_spline(spatial.by_parallelism(pairs, "bridge", "rail"), of(b, "bridge"), of(r, "rail"), "bridge", "rail"), "bridge").where("position = 'under'")
    elif rule == "layer":
        kept = pairs.select(F.col("a_bridge").alias("bridge"), spatial.level_position(F.col("b_layer"), F.col("a_layer")).alias("position")).where("position = 'below'").distinct()
    else:
        raise ValueError(f"rule must be orientation, spline or layer, not {rule}")
    found = _shapes(_lines(ways, "bridge"), *also).join(kept, F.col("id") == F.col("bridge")).select("geometry", *also, "position")
    same = [F.col(f"w.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("geometry", *also)]
    return _lines(ways, "bridge").alias("w").join(found.alias("f"), same).select("w.id", "w.geometry", "position")


def tunnels(ways: DataFrame, radius: float = 5.0) -> DataFrame:
    """id, geometry, position ("in"): tunnels with a railway within the radius."""
    t, r = (spatial.to_mercator_lines(_shapes(_lines(ways, kind))) for kind in ("tunnel", "railway"))
    ts = spatial.segments(t.withColumnRenamed("id", "tunnel"), "tunnel", "geometry")
    rs = spatial.segments(r.withColumnRenamed("id", "rail"), "rail", "geometry")
    hit = spatial.lines_near(ts, rs, radius, "tunnel", "rail", cell=200.0).select(F.col("a_tunnel").alias("tunnel")).distinct()
    found = _shapes(_lines(ways, "tunnel")).join(hit, F.col("id") == F.col("tunnel"), "left_semi").select("geometry")
    return _lines(ways, "tunnel").join(found, "geometry", "left_semi").select("id", "geometry", F.lit("in").alias("position"))


def combined(ways: DataFrame, *, region: str | None = None) -> DataFrame:
    """index, position, geometry, infrastructure, and bundesland if the ways have one (or it is given)."""
    b = bridges(ways).withColumn("infrastructure", F.lit("bridge"))
    both = b.unionByName(tunnels(ways).withColumn("infrastructure", F.lit("tunnel"))).withColumnRenamed("id", "index")
    if region:
        return both.withColumn("bundesland", F.lit(region))
    if "bundesland" in ways.columns:
        return both.join(ways.select(F.col("id").alias("index"), "bundesland").distinct(), "index")
    return both
