"""Lines from GeoJSON, shapefiles, OSM extracts and Overpass replies.

Shapefiles and PBF extracts are Python data sources (modules shapefile and pbf), on local paths or any that
pyarrow's file systems open; everything else is Spark's JSON reader. Lines are array<struct<x, y>> with x the longitude.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackforge.sources import ranges
from trackforge.sources.pbf import PbfSource
from trackforge.sources.shapefile import ShapefileSource
from trackforge.sources.shared import exists

LINE = "array<struct<x:double,y:double>>"


def read_geojson(spark: SparkSession, path: str, properties: str = "map<string,string>", *, split: int | None = None) -> DataFrame:
    """properties, kind, geometry (a point is a line of one vertex), part (from 0): one row per line; a
    MultiLineString is several rows. split: bytes of a task. Spark's reader of whole JSON files would read a file anew for
    each of its coordinates."""
    feature = f"type string, properties {properties}, geometry struct<type:string,coordinates:string>"
    return _lines_of(ranges.features(spark, path, split or ranges.RANGE).select(F.from_json("value", feature).alias("f")).where("f.type = 'Feature'"))


def _lines_of(d: DataFrame) -> DataFrame:
    kind, c = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    lines = F.when(kind.isin("MultiLineString", "Polygon"), F.from_json(c, "array<array<array<double>>>")).when(kind == "LineString", F.array(F.from_json(c, "array<array<double>>"))).when(kind == "Point", F.array(F.array(F.from_json(c, "array<double>"))))
    d = d.select(F.monotonically_increasing_id().alias("feature_id"), "f.properties", kind.alias("kind"), F.posexplode(lines).alias("part", "l"))
    point = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    return d.select("feature_id", "properties", "kind", "part", F.transform("l", point).alias("geometry"))



def read_features(spark: SparkSession, path: str, properties: str = "map<string,string>") -> DataFrame:
    """As read_geojson(), from files of one feature a line, which Spark can split."""
    schema = f"type string, properties {properties}, geometry struct<type:string,coordinates:string>"
    return _lines_of(spark.read.schema(schema).json(path).select(F.struct("*").alias("f")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ShapefileSource)
    spark.dataSource.register(PbfSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def lines_of_ways(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """ways (id, refs, others) with geometry from nodes (id, lon, lat): unknown nodes are passed over, and
    ways with fewer than two known ones go."""
    r = ways.select("id", F.posexplode("refs").alias("pos", "node"))
    j = r.join(nodes.select(F.col("id").alias("node"), "lon", "lat"), "node").where("lon is not null and lat is not null")
    g = j.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("lon").alias("x"), F.col("lat").alias("y")))).alias("g")).where("size(g) >= 2")
    return ways.drop("refs").join(g.select("id", F.transform("g", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("geometry")), "id")


def layer(tags: F.Column) -> F.Column:
    return F.coalesce(F.try_element_at(tags, F.lit("layer")).try_cast("int"), F.lit(0))


def infrastructure_ways(ways: DataFrame) -> DataFrame:
    """ways with kind (bridge, railway, tunnel) and layer: once for each kind a way is of."""
    tag = lambda k: F.try_element_at(F.col("tags"), F.lit(k))
    rail = tag("railway").isNotNull()
    kinds = F.array_compact(F.array(F.when(tag("bridge") == "yes", "bridge"), F.when(rail, "railway"), F.when((tag("tunnel") == "yes") & rail, "tunnel")))
    return ways.withColumn("kind", F.explode(kinds)).withColumn("layer", layer(F.col("tags")))


def railways(ways: DataFrame, *types: str) -> DataFrame:
    """id, geometry, railway_type of railways (rail and light_rail by default)."""
    t = F.try_element_at(F.col("tags"), F.lit("railway"))
    return ways.where(t.isin(*(types or ("rail", "light_rail")))).select("id", "geometry", t.alias("railway_type"))


def read_overpass(spark: SparkSession, path: str, structure_type: str) -> DataFrame:
    """structure_id, structure_type, coordinates (array of lat, lon) from an Overpass reply in JSON."""
    e = spark.read.option("multiLine", True).schema("elements array<struct<type:string,id:long,lat:double,lon:double,nodes:array<long>>>").json(path).select(F.explode("elements").alias("e")).select("e.*")
    ways = lines_of_ways(e.where("type = 'way'").select("id", F.col("nodes").alias("refs")), e.where("type = 'node'").select("id", "lon", "lat"))
    return ways.select(F.col("id").alias("structure_id"), F.lit(structure_type).alias("structure_type"), F.transform("geometry", lambda p: F.struct(p["y"].alias("lat"), p["x"].alias("lon"))).alias("coordinates"))


def structure_places(structures: DataFrame) -> DataFrame:
    return structures.select("structure_id", "structure_type", F.explode("coordinates").alias("c")).select("structure_id", "structure_type", "c.lat", "c.lon")


def read_structures_csv(spark: SparkSession, path: str) -> DataFrame:
    """A saved structure table; coordinates are JSON."""
    d = spark.read.option("header", True).option("escape", '"').csv(path)
    return d.select(F.col("structure_id").cast("long").alias("structure_id"), "structure_type", F.from_json("coordinates", "array<struct<lat:double,lon:double>>").alias("coordinates"))


#: Regions with an extract of their own.
REGIONS = ("baden-wuerttemberg", "bayern", "berlin", "brandenburg", "bremen", "hamburg", "hessen", "mecklenburg-vorpommern", "niedersachsen", "nordrhein-westfalen", "rheinland-pfalz", "saarland", "sachsen", "sachsen-anhalt", "schleswig-holstein", "thueringen")


#: Fixed value: where their extracts are offered.
EXTRACTS = "https://download.geofabrik.de/europe/germany"


def regions(spark: SparkSession, base: str = EXTRACTS) -> DataFrame:
    """region, file, url of each region's extract."""
    return spark.createDataFrame([(r, f"{r}-latest.osm.pbf", f"{base}/{r}-latest.osm.pbf") for r in REGIONS], "region string, file string, url string")


def parsed_once(spark: SparkSession, table: str, parse: Callable[[], DataFrame]) -> DataFrame:
    """The Parquet table of that path; parsed and written first if there is none."""
    if not exists(spark, f"{table}/_SUCCESS"):
        parse().write.mode("overwrite").parquet(table)
    return spark.read.parquet(table)
