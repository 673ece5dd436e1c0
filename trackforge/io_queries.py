"""Queries that write what the readers read, into the shared folder, and read it back; and queries of the
operators that the other module leaves out. Each with SQL over the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackforge.core import with_seq
from trackforge.functions import geo as degrees
from trackforge.functions import numeric
from trackforge.operators import filters, kinematics, profile, resample, segmentation, sequential, smoothing, spatial
from trackforge.plans import products
from trackforge.queries import CLEAR6, _CURV, _DIST, _FULL, _KALMAN, _PTS, EV, KEY, PL, T, W, _curved, _curves, _lines, _points, _savgol_sql, _sql_text, _text, planar, query, r, read, tracks
from trackforge.sources import elevation, geo, logs, shared, sinks

# Files


def _log(spark, sf):
    """Tracks with the raw log's columns."""
    d = tracks(spark, sf)
    return d.select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("DatumZeit"), F.col("lat").alias("GPS_lat"), F.col("lon").alias("GPS_lon"), (F.col("v") / 10).alias("Geschwindigkeit in m/s"),
        F.when(F.col("event_id") % 5 > 0, F.col("v")).alias("Gier"), F.lit(float("nan")).alias("Gier_GPS"), (F.col("event_id") % 6).cast("int").alias("GPS Qualität"), F.lit(0.0).alias("Beschleunigung in m/s2"))


@query(f"{EV} SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS t, round(lat, 6) AS lat, round(v / 10, 6) AS speed, round(CASE WHEN event_id % 5 > 0 THEN v END, 6) AS yaw, NULL::DOUBLE AS yaw_gps, (event_id % 6)::INT AS quality FROM e")
def csv_log(spark, sf):
    path = shared.folder(spark, "csv_log")
    sinks.write_csv(_log(spark, sf), path)
    d = logs.read_csv(spark, path, logs.RAW_LOG, times=["DatumZeit"])
    return d.select(F.date_format("DatumZeit", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("t"), r("GPS_lat", 6, "lat"), r("Geschwindigkeit in m/s", 6, "speed"), r("Gier", 6, "yaw"), r("Gier_GPS", 6, "yaw_gps"), F.col("GPS Qualität").alias("quality"))


@query("SELECT ts::DATE::VARCHAR AS day, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def csv_by_date(spark, sf):
    path = shared.folder(spark, "csv_by_date")
    sinks.write_by_date(read(spark, sf, "events").select(F.to_date("ts").alias("track_date"), "event_id", "value"), path)
    d = spark.read.option("header", True).schema("event_id long, value double, track_date date").csv(path)
    return d.groupBy(F.col("track_date").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT DISTINCT ts::DATE::VARCHAR AS file_date FROM events")
def files_by_date(spark, sf):
    path = shared.folder(spark, "files_by_date")
    sinks.write_by_date(read(spark, sf, "events").select(F.to_date("ts").alias("track_date"), "event_id"), path)
    return logs.files(spark, path, name_holds="track_date=").select(F.col("file_date").cast("string").alias("file_date")).distinct()


@query("SELECT o_orderstatus AS status, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def csv_folder(spark, sf):
    """Files below folders, found by ending, and the folder that each row was read from."""
    path = shared.folder(spark, "csv_folder")
    read(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("_s")).write.option("header", True).partitionBy("_s").csv(path)
    d = logs.read_csv(spark, path).select("o_orderkey", F.col("_metadata.file_path").alias("path"))
    return d.groupBy(F.regexp_extract("path", "_s=([^/]*)/", 1).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 10::BIGINT AS day_files, count(*)::BIGINT AS n FROM (SELECT * FROM nation)")
def csv_listing(spark, sf):
    """Ten files named by day, listed by what was read from them."""
    path = shared.folder(spark, "csv_listing")
    n = read(spark, sf, "nation").select("n_nationkey", "n_name")
    for i in range(10):
        n.where(F.col("n_nationkey") % 10 == i).coalesce(1).write.option("header", True).csv(f"{path}/2024-01-{i + 1:02d}")
    d = spark.read.option("header", True).option("recursiveFileLookup", True).csv(path).select("*", "_metadata")
    found = logs.listing(d).withColumn("day", logs.date_in(F.col("path")))
    return found.agg(F.countDistinct("day").alias("day_files")).crossJoin(d.agg(F.count(F.lit(1)).alias("n")))  # one row each


@query("SELECT c_custkey AS q, 4::INT AS n, round(c_custkey * 71 % 5000 + 60.0, 4) AS last_x FROM customer")
def geojson_lines(spark, sf):
    path = shared.folder(spark, "geojson_lines")
    sinks.write_geojson(_curves(spark, sf), path)
    d = geo.read_features(spark, path)
    return d.select(F.col("properties")["q"].cast("long").alias("q"), F.size("geometry").alias("n"), r(F.element_at("geometry", -1)["x"], 4, "last_x"))


@query("SELECT c_custkey AS q, 'LineString' AS kind, round(c_custkey * 313 % 5000 + c_custkey % 7 + 1.0, 4) AS second_y FROM customer")
def geojson_collection(spark, sf):
    """FeatureCollections of a bounded number of features in a file."""
    path = shared.folder(spark, "geojson_collection")
    sinks.write_collection(_curves(spark, sf), path)
    d = geo.read_geojson(spark, path)
    return d.select(F.col("properties")["q"].cast("long").alias("q"), "kind", r(F.col("geometry")[1]["y"], 4, "second_y"))


@query("SELECT c_custkey AS q, 'LineString' AS kind, round(c_custkey * 313 % 5000 + c_custkey % 7 + 1.0, 4) AS second_y FROM customer")
def geojson_ranges(spark, sf):
    """The same, read by ranges of bytes."""
    path = shared.folder(spark, "geojson_ranges")
    sinks.write_collection(_curves(spark, sf), path)
    d = geo.read_geojson(spark, path, split=5000)
    return d.select(F.col("properties")["q"].cast("long").alias("q"), "kind", r(F.col("geometry")[1]["y"], 4, "second_y"))


@query("SELECT 'starts' AS layer, count(*)::BIGINT AS n FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT 'curves', count(*)::BIGINT FROM customer")
def map_layers(spark, sf):
    path = shared.folder(spark, "map_layers")
    starts = products.ends_layer(tracks(spark, sf), T, "lat", "lon").select("track_id", F.array(F.struct(F.col("first_lon").alias("x"), F.col("first_lat").alias("y"))).alias("geometry"))
    sinks.write_layers({"starts": starts, "curves": _curves(spark, sf)}, path, "tracks")
    of = lambda layer: geo.read_features(spark, f"{path}/tracks/{layer}").agg(F.lit(layer).alias("layer"), F.count(F.lit(1)).alias("n"))
    return of("starts").unionByName(of("curves"))


@query(f"SELECT p.p, coalesce(h, false) AS gps_blocked FROM {_PTS} p LEFT JOIN (SELECT DISTINCT p, true AS h FROM {_DIST} WHERE d <= 60) b ON p.p = b.p")
def blockage_csv(spark, sf):
    path = shared.folder(spark, "blockage_csv")
    sinks.write_csv(spatial.flag_near(_points(spark, sf), _lines(spark, sf), 60.0, "p"), path)
    return logs.read_csv(spark, path).select(F.col("p").cast("long").alias("p"), F.col("gps_blocked").cast("boolean").alias("gps_blocked"))


@query("SELECT count(*)::BIGINT AS rows, count_if(o_custkey % 11 <> 0)::BIGINT AS kept, count_if(o_custkey % 11 = 0)::BIGINT AS removed, count_if(o_custkey % 11 <> 0)::BIGINT AS written FROM orders")
def without_na_csv(spark, sf):
    path = shared.folder(spark, "without_na") + "/orders.csv"
    d = read(spark, sf, "orders").select("o_orderkey", F.expr("nullif(o_custkey, if(o_custkey % 11 = 0, o_custkey, null))").alias("o_custkey"))
    counts = sinks.write_without_na(d, path, "o_custkey")
    return counts.crossJoin(logs.read_csv(spark, sinks.beside(path, "_noNA"), suffix="").agg(F.count(F.lit(1)).alias("written")))  # one row each


@query(" UNION ALL ".join(f"SELECT '{i}' AS item, '{c}' AS of, round(({e})::DOUBLE, 4) AS value FROM orders" for c in ("o_orderkey", "o_totalprice") for i, e in (("rows", "count(*)"), ("nulls", f"count_if({c} IS NULL)"), ("zeros", f"count_if({c} = 0)"), ("count", f"count({c})"), ("mean", f"avg({c})"), ("std", f"stddev_samp({c})"), ("min", f"min({c})"), ("q25", f"quantile_cont({c}, 0.25)"), ("q50", f"quantile_cont({c}, 0.5)"), ("q75", f"quantile_cont({c}, 0.75)"), ("max", f"max({c})"))) + " UNION ALL SELECT 'rows', 'o_orderdate', count(*)::DOUBLE FROM orders UNION ALL SELECT 'nulls', 'o_orderdate', count_if(o_orderdate IS NULL)::DOUBLE FROM orders UNION ALL SELECT 'entries', o_orderdate::DATE::VARCHAR, count(*)::DOUBLE FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 2")
def stats_report(spark, sf):
    return profile.report(read(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderdate"), "o_orderdate").select("item", "of", r("value", 4))


def _overpass(spark, sf, path: str) -> None:
    """Replies, one file for each nation: customers are ways of two nodes."""
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("_n"))
    node = lambda i: F.struct(F.lit("node").alias("type"), (F.col("k") * 2 + i).alias("id"), (51 + F.col("k") % 400 / 1000 + i / 100).alias("lat"), (11 + F.col("k") % 700 / 1000).alias("lon"), F.lit(None).cast("array<bigint>").alias("nodes"))
    way = F.struct(F.lit("way").alias("type"), F.col("k").alias("id"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.array(F.col("k") * 2, F.col("k") * 2 + 1).alias("nodes"))
    one = c.select("_n", F.explode(F.array(node(0), node(1), way)).alias("e")).groupBy("_n").agg(F.collect_list("e").alias("elements"))
    one.select("_n", F.to_json(F.struct("elements")).alias("value")).write.partitionBy("_n").text(path)


@query("SELECT c_custkey AS structure_id, 'bridge' AS structure_type, unnest([round(51 + c_custkey % 400 / 1000, 6), round(51 + c_custkey % 400 / 1000 + 0.01, 6)]) AS lat, round(11 + c_custkey % 700 / 1000, 6) AS lon FROM customer")
def overpass_structures(spark, sf):
    path = shared.folder(spark, "overpass")
    _overpass(spark, sf, path)
    return geo.structure_places(geo.read_overpass(spark, path, "bridge")).select("structure_id", "structure_type", r("lat"), r("lon"))


@query("SELECT c_custkey AS structure_id, 'tunnel' AS structure_type, 2::INT AS n, round(51 + c_custkey % 400 / 1000, 6) AS first_lat FROM customer")
def structures_csv(spark, sf):
    """Structures saved as a table and read again; parsed once, then from Parquet."""
    path = shared.folder(spark, "structures")
    _overpass(spark, sf, f"{path}/reply")
    d = geo.parsed_once(spark, f"{path}/parsed", lambda: geo.read_overpass(spark, f"{path}/reply", "tunnel"))
    d.withColumn("coordinates", F.to_json("coordinates")).write.option("header", True).option("escape", '"').csv(f"{path}/csv")
    again = geo.parsed_once(spark, f"{path}/parsed", lambda: 1 / 0)
    return geo.read_structures_csv(spark, f"{path}/csv").join(again.select("structure_id"), "structure_id", "left_semi").select("structure_id", "structure_type", F.size("coordinates").alias("n"), r(F.col("coordinates")[0]["lat"], 6, "first_lat"))


def _extract(spark, sf):
    """The curves as an extract's nodes and ways, written and read back by ranges of a few KB."""
    c, path = _curves(spark, sf), shared.folder(spark, "extract")
    node = lambda i: (F.col("q") * 4 + i).alias("id")
    some = F.when(F.col("q") % 6 == 0, F.create_map(F.lit("name"), F.concat(F.lit("Ü"), F.col("q").cast("string")))).otherwise(F.create_map().cast("map<string,string>"))
    nodes = c.select(some.alias("tags"), "q", F.posexplode("geometry").alias("i", "p")).select(F.lit("node").alias("kind"), node(F.col("i")), (11 + F.col("p.x") / 1e5).alias("lon"), (51 + F.col("p.y") / 1e5).alias("lat"), F.lit(None).cast("array<long>").alias("refs"), "tags")
    rail = F.element_at(F.array(*map(F.lit, ("rail", "light_rail", "tram"))), (F.col("q") % 3 + 1).cast("int"))
    tags = F.map_concat(F.when(F.col("q") % 2 == 0, F.create_map(F.lit("railway"), rail)).otherwise(F.create_map(F.lit("highway"), F.lit("track"))), F.create_map(F.lit("layer"), (F.col("q") % 4).cast("string")))
    none = F.lit(None).cast("double")
    ways = c.select(F.lit("way").alias("kind"), F.col("q").alias("id"), none.alias("lon"), none.alias("lat"), F.array(*[F.col("q") * 4 + i for i in range(4)]).alias("refs"), tags.alias("tags"))
    geo.register(spark)
    nodes.unionByName(ways).repartition(3).write.format("track_osm_pbf").mode("append").save(path)
    return spark.read.format("track_osm_pbf").option("range", 4000), path


@query("""SELECT 'node' AS kind, count(*) * 4 AS n, sum(c_custkey * 16 + 6)::BIGINT AS ids, 0::BIGINT AS refs, (count(*) FILTER (c_custkey % 6 = 0)) * 4 AS tagged FROM customer
UNION ALL SELECT 'way', count(*), sum(c_custkey)::BIGINT, sum(c_custkey * 16 + 6)::BIGINT, count(*) FROM customer""")
def pbf_elements(spark, sf):
    source, path = _extract(spark, sf)
    d = source.load(path)
    refs = F.coalesce(F.aggregate("refs", F.lit(0).cast("long"), lambda a, b: a + b), F.lit(0))
    return d.groupBy("kind").agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.sum(refs).alias("refs"), F.count(F.when(F.size("tags") > 0, 1)).alias("tagged"))


@query("""SELECT c_custkey AS id, ['rail', 'light_rail', 'tram'][c_custkey % 3 + 1] AS railway_type, round(11 + (c_custkey * 71 % 5000 + 20) / 1e5, 7) AS x, round(51 + (c_custkey * 313 % 5000 + c_custkey % 7 + 1) / 1e5, 7) AS y, 4::BIGINT AS n
FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 < 2""")
def pbf_railways(spark, sf):
    """Railways alone are made by the reader; nodes by another read, without their tags."""
    source, path = _extract(spark, sf)
    ways = source.option("keys", "railway").load(path).where("kind = 'way'")
    nodes = spark.read.format("track_osm_pbf").option("range", 4000).load(path).where("kind = 'node'")
    d = geo.railways(geo.lines_of_ways(ways.select("id", "refs", "tags"), nodes.select("id", "lon", "lat")))
    return d.select("id", "railway_type", r(F.col("geometry")[1]["x"], 7, "x"), r(F.col("geometry")[1]["y"], 7, "y"), F.size("geometry").cast("long").alias("n"))


@query("""SELECT c_custkey AS id, k AS kind, (c_custkey % 4)::INT AS layer FROM customer, (VALUES ('railway')) t(k) WHERE c_custkey % 2 = 0""")
def pbf_infrastructure(spark, sf):
    source, path = _extract(spark, sf)
    return geo.infrastructure_ways(source.option("keys", "railway,bridge,tunnel").load(path).where(F.col("kind").isin("way", "relation"))).select("id", "kind", "layer")


@query("""SELECT c_custkey AS q, 0 AS part, round(11 + (c_custkey * 71 % 5000 + 20) / 1e5, 7) AS x, 4::BIGINT AS n, CASE WHEN c_custkey % 9 > 0 THEN 'Müller ' || c_custkey END AS owner, round(c_acctbal, 2)::DOUBLE AS balance, DATE '2024-01-01' + (c_custkey % 366)::INT AS built, c_custkey % 2 = 0 AS electric
FROM customer""")
def shapefile_lines(spark, sf):
    """Lines with attributes, written as shapefiles and read back, a few records a task, without one column."""
    path, c = shared.folder(spark, "shapes"), _curves(spark, sf)
    k = F.col("q")
    degrees_of = F.transform("geometry", lambda p: F.struct((11 + p["x"] / 1e5).alias("x"), (51 + p["y"] / 1e5).alias("y")))
    own = read(spark, sf, "customer").select(F.col("c_custkey").alias("q"), F.col("c_acctbal").cast("double").alias("balance"))
    d = c.join(own, "q").select(k, degrees_of.alias("geometry"), F.when(k % 9 > 0, F.concat(F.lit("Müller "), k.cast("string"))).alias("owner"), "balance", F.date_add(F.lit("2024-01-01").cast("date"), (k % 366).cast("int")).alias("built"), (k % 2 == 0).alias("electric"), F.lit(1.5).alias("unread"))
    geo.register(spark)
    d.repartition(3).write.format("track_shapefile").mode("append").save(path)
    back = spark.read.format("track_shapefile").option("records", 200).option("columns", "q,owner,balance,built,electric").load(path)
    return back.select("q", "part", r(F.col("geometry")[1]["x"], 7, "x"), F.size("geometry").cast("long").alias("n"), "owner", r("balance", 2), "built", "electric")


@query("SELECT region, region || '-latest.osm.pbf' AS file, 'https://x.org/' || region || '-latest.osm.pbf' AS url FROM (SELECT unnest([" + ", ".join(f"'{x}'" for x in geo.REGIONS) + "]) AS region)")
def region_files(spark, sf):
    return geo.regions(spark, "https://x.org")


@query(f"{EV}, g AS (SELECT c_custkey % 100 AS iy, c_custkey % 10 AS ix, max(c_acctbal) AS elevation FROM customer GROUP BY ALL) SELECT track_id, seq, elevation FROM e LEFT JOIN g ON floor((lat - 51) * 1000) = iy AND floor((lon - 11) * 100) = ix")
def elevation_grid(spark, sf):
    d = tracks(spark, sf).withColumns({"y": F.floor((F.col("lat") - 51) * 1000).cast("double"), "x": F.floor((F.col("lon") - 11) * 100).cast("double")})
    g = read(spark, sf, "customer").groupBy((F.col("c_custkey") % 100).alias("iy"), (F.col("c_custkey") % 10).alias("ix")).agg(F.max("c_acctbal").alias("elevation"))
    return elevation.from_grid(d, g, 1.0, lat="y", lon="x").select(*KEY, "elevation")


def _ask(places):
    return [round(a * 100 + b, 6) for a, b in places]


@query(f"{EV} SELECT track_id, seq, round(lat * 100 + lon, 4) AS elevation FROM e")
def elevation_service(spark, sf):
    return elevation.from_service(tracks(spark, sf), _ask, lat="lat", lon="lon").select(*KEY, r("elevation", 4))


# What else operators can do

_UTM33 = f"""{EV}, a AS (SELECT *, radians(lon - 15) AS dl, sinh(atanh(sin(radians(lat))) - {degrees.E2 ** 0.5!r} * atanh({degrees.E2 ** 0.5!r} * sin(radians(lat)))) AS q FROM e),
b AS (SELECT *, atan2(q, cos(dl)) AS xi, asinh(sin(dl) / sqrt(q * q + cos(dl) * cos(dl))) AS eta FROM a)
SELECT track_id, seq, round(500000 + {degrees.UTM_SCALE * degrees.RECTIFYING!r} * (eta + {' + '.join(f'{a!r} * cos({2 * k} * xi) * sinh({2 * k} * eta)' for k, a in enumerate(degrees.ALPHA, 1))}), 3) AS x,
 round({degrees.UTM_SCALE * degrees.RECTIFYING!r} * (xi + {' + '.join(f'{a!r} * sin({2 * k} * xi) * cosh({2 * k} * eta)' for k, a in enumerate(degrees.ALPHA, 1))}), 3) AS y, 'EPSG:32633' AS projection_epsg FROM b"""


@query(_UTM33)
def utm_zone_33(spark, sf):
    return kinematics.to_planar(tracks(spark, sf), T, "lat", "lon", zone=33).select(*KEY, r("x", 3), r("y", 3), "projection_epsg")


_P501 = [[float(v) for v in row] for row in smoothing.savgol_powers(501, 2)]
_FIT = "list_dot_product({0}, {1}[1]) + list_dot_product({0}, {1}[2]) * ({2}) / 250 + list_dot_product({0}, {1}[3]) * pow(({2}) / 250, 2)"


@query(f"""WITH e AS (SELECT user_id % 4 AS track_id, value AS v, row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) AS seq FROM events), p AS (SELECT {_P501}::DOUBLE[][] AS p),
z AS (SELECT track_id, seq, count(*) OVER (PARTITION BY track_id) AS n, list(v) OVER (PARTITION BY track_id ORDER BY seq ROWS BETWEEN 250 PRECEDING AND 250 FOLLOWING) AS w FROM e),
f AS (SELECT track_id, w AS w0 FROM z WHERE seq = 251), l AS (SELECT track_id, w AS w9 FROM z WHERE seq = n - 250)
SELECT track_id, seq, round(CASE WHEN seq <= 250 THEN {_FIT.format('w0', 'p', 'seq - 251')} WHEN seq > n - 250 THEN {_FIT.format('w9', 'p', 'seq - n + 250')} ELSE list_dot_product(w, p[1]) END, 6) AS smooth FROM z JOIN f USING (track_id) JOIN l USING (track_id), p""")
def savgol_501_2(spark, sf):
    """A window of 501 rows, on tracks that are long enough for it."""
    d = with_seq(read(spark, sf, "events").select((F.col("user_id") % 4).alias("track_id"), "ts", "event_id", F.col("value").alias("v")), "track_id", "ts", "event_id")
    return smoothing.savgol(d, T, "v", 501, 2, to="smooth").select(*KEY, r("smooth"))


@query(_savgol_sql(51, 2).replace("v_savgol", "smooth"))
def savgol_51_2(spark, sf):
    return smoothing.savgol(tracks(spark, sf), T, "v", 51, 2, to="smooth").select(*KEY, r("smooth"))


@query(f"{EV}, m AS (SELECT *, max(abs(v - 50)) OVER (PARTITION BY track_id) AS m, max(seq) OVER (PARTITION BY track_id) AS n FROM e WHERE v IS NOT NULL), l AS (SELECT *, max(abs(v - 50)) FILTER (WHERE seq < n) OVER (PARTITION BY track_id) AS top FROM m) SELECT track_id, seq, round(CASE WHEN top > 0 THEN (v - 50 + top) / (2 * top) ELSE 0.5 END, 6) AS colour FROM l WHERE seq < n")
def symmetric_colours(spark, sf):
    d = tracks(spark, sf).withColumn("c", F.col("v") - 50)
    return products.colour_track(d, T, "c", "lat", "lon", symmetric=True).select(*KEY, r("colour"))


@query(f"{EV}, s AS (SELECT *, v * 3.6 AS k, lead(lat) OVER {W} AS to_lat, max(seq) OVER (PARTITION BY track_id) AS n FROM e), m AS (SELECT *, max(k) OVER (PARTITION BY track_id) AS hi, min(k) OVER (PARTITION BY track_id) AS lo FROM s WHERE seq < n) SELECT track_id, seq, round(k, 6) AS speed_kmh, round(CASE WHEN hi > lo THEN (k - lo) / (hi - lo) ELSE 0.5 END, 6) AS colour, round(to_lat, 6) AS next_lat FROM m")
def speed_layer(spark, sf):
    return products.speed_layer(tracks(spark, sf), T, "v", "lat", "lon").select(*KEY, r("speed_kmh"), r("colour"), r("next_lat"))


@query(f"{EV} SELECT track_id, event_id % 4 AS tunnel, round(arg_min(lat, seq), 6) AS first_lat, round(arg_max(lon, seq), 6) AS last_lon FROM e WHERE event_id % 4 > 0 GROUP BY ALL")
def tunnel_layer(spark, sf):
    d = tracks(spark, sf).withColumn("tunnel", F.expr("nullif(event_id % 4, 0)"))
    return products.tunnel_layer(d, T, "tunnel", "lat", "lon").select("track_id", "tunnel", r("first_lat"), r("last_lon"))


@query(f"{PL}, k AS (SELECT *, (v - 50) / 1e5 AS k, lead(x) OVER {W} AS next_x, lead((v - 50) / 1e5) OVER {W} AS next_k, lead(seq) OVER {W} AS on_ FROM p) SELECT track_id, seq, round(next_x, 4) AS next_x, round(next_k, 9) + 0.0 AS next_k FROM k WHERE on_ IS NOT NULL")
def curvature_strip(spark, sf):
    d = planar(spark, sf).withColumn("k", (F.col("v") - 50) / 1e5)
    return products.curvature_strip(d, T, "k").select(*KEY, r("next_x", 4), r("next_k", 9))


@query(f"{PL}, g AS (SELECT *, CASE WHEN lag(s) OVER {W} IS NULL OR s = lag(s) OVER {W} THEN 0 ELSE (v - lag(v) OVER {W}) / (s - lag(s) OVER {W}) END AS g FROM p) SELECT track_id, 'v' AS signal, round(s, 6) AS s, round(v, 6) AS value FROM g UNION ALL SELECT track_id, 'gradient', round(s, 6), round(g, 6) + 0.0 FROM g")
def elevation_chart(spark, sf):
    d = kinematics.grade(planar(spark, sf), T, "v", "s")
    return products.elevation_chart(d, T, "s", "v", "gradient")[0].select("track_id", "signal", r("s"), r("value"))


@query(f"{PL}, y AS (SELECT *, v - 40 AS yaw_rate_from_a, h AS Gier FROM p) SELECT round(least(min(v - 40), min(h)), 6) + 0.0 AS lo, round(greatest(max(v - 40), max(h)), 6) AS hi FROM y")
def yaw_chart_range(spark, sf):
    d = planar(spark, sf).withColumns({"yaw_rate_from_a": F.col("v") - 40, "Gier": F.col("h")})
    return products.yaw_chart(d, T, "ts")[1].select(r("lo"), r("hi"))


@query(f"{PL} SELECT track_id, 'yaw_rate_from_a' AS signal, count(*)::BIGINT AS n, round(sum(v - 40), 4) AS total FROM p GROUP BY 1 UNION ALL SELECT track_id, 'Gier', count(*)::BIGINT, round(sum(h), 4) FROM p GROUP BY 1")
def yaw_chart(spark, sf):
    d = planar(spark, sf).withColumns({"yaw_rate_from_a": F.col("v") - 40, "Gier": F.col("h")})
    return products.yaw_chart(d, T, "ts")[0].groupBy("track_id", "signal").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"{EV} SELECT track_id, seq FROM e WHERE event_id % 3 > 0")
def has_radius(spark, sf):
    return products.has_radius(tracks(spark, sf).withColumn("radius", F.when(F.col("event_id") % 3 > 0, F.col("v"))), "radius").select(*KEY)


@query(f"{_FULL} SELECT track_id, seq, round(mean_radius, 2) AS mean_radius FROM a WHERE abs(mean_radius) BETWEEN 400 AND 30000 AND segment_type = 'steady_curve'")
def radius_marks(spark, sf):
    d = segmentation.segment(_curved(spark, sf), T, "k", "s", tie_fix=False)
    return filters.radius_marks(d).select(*KEY, r("mean_radius", 2))


@query(f"{_FULL}, g1 AS (SELECT track_id, segment_id, avg(instant_radius) FILTER (WHERE instant_radius <> 'Infinity'::DOUBLE) AS m FROM a GROUP BY ALL) SELECT track_id, segment_id::BIGINT AS segment_id, round(m, 2) AS mean FROM g1 WHERE abs(m) < 1e7")
def means_without_infinity(spark, sf):
    d = segmentation.segment(_curved(spark, sf), T, "k", "s", tie_fix=False)
    return d.groupBy("track_id", "segment_id").agg(segmentation.mean_without_inf("instant_radius").alias("mean")).where("abs(mean) < 1e7").select("track_id", "segment_id", r("mean", 2))


@query(f"""WITH RECURSIVE b AS (SELECT user_id AS track_id, time_bucket(INTERVAL 1 HOUR, ts) AS ts, avg(value) AS v FROM events GROUP BY ALL), e AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY ts) AS seq FROM b),
k AS (SELECT track_id, seq, v AS x, 1.1 * (1 - 1.1 / 3.1) AS p FROM e WHERE seq = 1 UNION ALL SELECT e.track_id, e.seq, x + (p + 0.1) / (p + 2.1) * (v - x), (p + 0.1) * (1 - (p + 0.1) / (p + 2.1)) FROM k JOIN e ON e.track_id = k.track_id AND e.seq = k.seq + 1)
SELECT track_id, seq, round(x, 6) AS v_kalman FROM k""")
def resampled_kalman(spark, sf):
    d = resample.bucket_mean(read(spark, sf, "events").withColumnRenamed("value", "v"), "user_id", "ts", "1 hour", "v").withColumnRenamed("user_id", "track_id")
    return sequential.kalman_smooth(with_seq(d, "track_id", "ts"), T, "v").select(*KEY, r("v_kalman"))


_GAPS = """CASE WHEN a.v IS NULL THEN b.v WHEN b.v IS NULL OR a.n = b.n THEN a.v ELSE a.v + (b.v - a.v) * (seq - a.n) / (b.n - a.n) END"""


def _filled(c: str) -> str:
    """A column with its gaps filled on the line between known rows."""
    known = f"CASE WHEN {c} IS NOT NULL THEN {{'n': seq, 'v': {c}}} END"
    return f"SELECT * EXCLUDE (a, b), coalesce({c}, {_GAPS}) AS {c}_ FROM (SELECT *, last_value({known} IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY seq) AS a, first_value({known} IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM"


@query(f"""WITH RECURSIVE s AS (SELECT user_id AS track_id, time_bucket(INTERVAL 6 HOUR, ts) AS ts, avg(CASE WHEN event_id % 3 > 0 THEN value END) AS v, avg(CASE WHEN event_id % 4 > 0 THEN 51 + value / 1000 END) AS lat, avg(11 + event_id % 100 / 1000) AS lon FROM events GROUP BY ALL),
e AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY ts) AS seq FROM s), f AS ({_filled('v')} e)), h AS ({_filled('lat')} f)),
p AS (SELECT track_id, seq, v_ AS v, lat_ AS lat, lon, (epoch_us(ts) - epoch_us(first_value(ts) OVER {W})) / 1e6 AS t, (epoch_us(ts) - epoch_us(coalesce(lag(ts) OVER {W}, ts))) / 1e6 AS dt,
 avg(lat_) OVER (PARTITION BY track_id ORDER BY seq ROWS 4 PRECEDING) AS mlat, avg(lon) OVER (PARTITION BY track_id ORDER BY seq ROWS 4 PRECEDING) AS mlon FROM h WHERE v_ IS NOT NULL AND lat_ IS NOT NULL),
{_KALMAN} SELECT track_id, seq, moves AS is_moving, round(a + {CLEAR6!r}, 6) AS lat_smoothed_kalman, round(o + {CLEAR6!r}, 6) AS lon_smoothed_kalman FROM k WHERE seq > 0""")
def resampled_filtered(spark, sf):
    """Even steps, gaps filled, then the filter in two dimensions. What is added keeps means clear of halves of a digit."""
    v, n = F.col("value"), F.col("event_id")
    d = read(spark, sf, "events").select(F.col("user_id").alias("track_id"), "ts", F.when(n % 3 > 0, v).alias("v"), F.when(n % 4 > 0, 51 + v / 1000).alias("lat"), (11 + n % 100 / 1000).alias("lon"))
    d = resample.smoothed_resampled(d, T, "ts", "lat", "lon", "v", "6 hours", move=60.0, stop=40.0, hold=3600.0, split=20)
    return d.select(*KEY, "is_moving", *[r(F.col(c) + CLEAR6, 6, c) for c in ("lat_smoothed_kalman", "lon_smoothed_kalman")])


@query(f"{_CURV}, i AS (SELECT *, CASE WHEN abs(v - 50) <= 1e-12 THEN 'Infinity'::DOUBLE ELSE 1 / (v - 50) END AS radius FROM k) SELECT track_id, seq, {_sql_text('radius')} FROM i")
def instant_radius(spark, sf):
    return planar(spark, sf).withColumn("radius", kinematics.instant_radius(F.col("v") - 50)).select(*KEY, _text("radius"))


@query(f"{PL} SELECT track_id, seq, round(abs(((h - v) % 180 + 270) % 180 - 90), 6) AS gap FROM p")
def half_circle_gap(spark, sf):
    return planar(spark, sf).select(*KEY, r(numeric.undirected_gap(F.col("h"), F.col("v")), 6, "gap"))


@query("SELECT s_suppkey AS id, 'tunnel' AS infrastructure FROM supplier WHERE s_nationkey < 5 INTERSECT SELECT s_suppkey, 'tunnel' FROM supplier WHERE s_nationkey > 2")
def intersect_infra(spark, sf):
    d = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("tunnel").alias("infrastructure"), "s_nationkey")
    return d.where("s_nationkey < 5").drop("s_nationkey").intersect(d.where("s_nationkey > 2").drop("s_nationkey"))


@query("SELECT c_custkey * 3 + 1 AS id, CASE WHEN c_custkey % 3 = 0 THEN 'light_rail' ELSE 'rail' END AS railway_type FROM customer WHERE c_custkey % 5 < 3 AND NOT c_custkey % 3 = 1")
def rail_types(spark, sf):
    k = F.col("c_custkey")
    kind = F.when(k % 3 == 1, "tram").when(k % 3 == 0, "light_rail").otherwise("rail")
    w = read(spark, sf, "customer").select((k * 3 + 1).alias("id"), F.lit(None).alias("geometry"), F.when(k % 5 < 3, F.create_map(F.lit("railway"), kind)).otherwise(F.create_map(F.lit("highway"), F.lit("path"))).alias("tags"))
    return geo.railways(w).select("id", "railway_type")


@query("SELECT c_custkey AS id, unnest(list_filter([CASE WHEN c_custkey % 2 = 0 THEN 'bridge' END, CASE WHEN c_custkey % 3 = 0 THEN 'railway' END, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 5 = 0 THEN 'tunnel' END], lambda x: x IS NOT NULL)) AS kind, (CASE WHEN c_custkey % 7 = 0 THEN -1 ELSE 0 END)::INT AS layer FROM customer")
def way_kinds(spark, sf):
    k = F.col("c_custkey")
    tag = lambda on, key, v: F.when(on, F.create_map(F.lit(key), F.lit(v))).otherwise(F.create_map().cast("map<string,string>"))
    tags = F.map_concat(tag(k % 2 == 0, "bridge", "yes"), tag(k % 3 == 0, "railway", "rail"), tag(k % 5 == 0, "tunnel", "yes"), tag(k % 7 == 0, "layer", "-1"), tag(k % 11 == 0, "name", "x"))
    return geo.infrastructure_ways(read(spark, sf, "customer").select(k.alias("id"), tags.alias("tags"))).select("id", "kind", "layer")


@query("SELECT c_custkey AS id, list_filter([c_custkey * 2, c_custkey * 2 + 1, c_custkey + 7], lambda x: x % 3 > 0).len()::INT AS n FROM customer WHERE list_filter([c_custkey * 2, c_custkey * 2 + 1, c_custkey + 7], lambda x: x % 3 > 0).len() > 1")
def ways_of_nodes(spark, sf):
    k = F.col("c_custkey")
    c = read(spark, sf, "customer")
    ways = c.select(k.alias("id"), F.array(k * 2, k * 2 + 1, k + 7).alias("refs"))
    nodes = ways.select(F.explode("refs").alias("id")).distinct().where("id % 3 > 0").select("id", (F.col("id") / 10).alias("lon"), F.lit(51.0).alias("lat"))
    return geo.lines_of_ways(ways, nodes).select("id", F.size("geometry").alias("n"))


@query("SELECT DISTINCT 'raw' AS side, o_orderdate::DATE::VARCHAR AS day FROM orders WHERE o_orderdate IN (SELECT o_orderdate FROM orders WHERE o_custkey % 50 = 0) UNION SELECT 'processed', o_orderdate::DATE::VARCHAR FROM orders WHERE o_custkey % 50 = 0")
def raw_beside_processed(spark, sf):
    raw = read(spark, sf, "orders").select(F.to_date("o_orderdate").alias("track_date"), "o_totalprice", "o_custkey")
    d = logs.with_raw(raw.where("o_custkey % 50 = 0"), raw, "o_totalprice")
    return d.select("side", F.col("track_date").cast("string").alias("day")).distinct()
