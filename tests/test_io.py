"""Files in and out, plans over them, streams."""

import json
import random
import struct
import time
import zlib
from datetime import UTC, datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trackforge.core import Track
from trackforge.operators import profile, sequential, spatial
from trackforge.plans import daily, infrastructure, products
from trackforge.sources import elevation, geo, logs, pbf, sinks
from trackforge.streaming import live

T = Track()


def test_csv_days(spark, tmp_path):
    (tmp_path / "in/a").mkdir(parents=True)
    (tmp_path / "in/a/2024-04-02.csv").write_text("DatumZeit,GPS_lat,GPS_lon,Gier\n2024-04-02 23:59:59.5,51.0,11.0,NaN\n2024-04-03 00:00:00.25,51.1,,2\n")
    d = logs.read_csv(spark, str(tmp_path / "in"), times=["DatumZeit"])
    assert logs.listing(d).first().file_date.isoformat() == "2024-04-02"
    assert logs.files(spark, str(tmp_path / "in")).first().relative == "a/2024-04-02.csv"
    t = logs.as_tracks(d)
    assert sorted((r.track_id, r.seq) for r in t.collect()) == [("2024-04-02", 1), ("2024-04-03", 1)]
    assert d.where("Gier is null").count() == 1
    sinks.write_by_date(t.drop("track_id"), str(tmp_path / "out"))
    sinks.write_by_date(t.drop("track_id").where("track_date = '2024-04-03'"), str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.count() == 2
    assert {"rows", "entries"} <= {x.item for x in profile.report(t, "DatumZeit").collect()}
    assert profile.provenance(t) == {"selected_smoothing_method": "default_smoothing_method", "min_distance": 0}
    assert logs.with_raw(t, d.withColumn("track_date", F.to_date("DatumZeit")), "DatumZeit").count() == 4
    with pytest.raises(Exception):
        logs.read_csv(spark, str(tmp_path / "none"))


def test_geojson_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(1, "a", [(11.0, 51.0), (11.1, 51.1)]), (2, None, [(12.0, 52.0)])], f"i long, name string, geometry {geo.LINE}")
    sinks.write_collection(d, str(tmp_path / "one"))
    (tmp_path / "x.geojson").write_text(next((tmp_path / "one").glob("part-*")).read_text())
    back = geo.read_geojson(spark, str(tmp_path / "x.geojson"), "struct<i:long,name:string>").select("properties.i", "properties.name", "kind", "geometry").orderBy("i").collect()
    assert [(r.i, r.name, r.kind) for r in back] == [(1, "a", "LineString"), (2, None, "Point")]
    assert back[0].geometry[1].y == 51.1
    many = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"k": 1}, "geometry": {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[2, 2], [3, 3]]]}}]}
    (tmp_path / "m.geojson").write_text(json.dumps(many))
    assert geo.read_geojson(spark, str(tmp_path / "m.geojson")).count() == 2


def test_shapefile(spark, tmp_path):
    body = struct.pack("<i4d2i1i4d", 3, 0, 0, 1, 1, 1, 2, 0, 0.0, 0.0, 1.0, 1.0)
    record = struct.pack(">2i", 1, len(body) // 2) + body
    head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(record)) // 2) + struct.pack("<2i8d", 1000, 3, *[0.0] * 8)
    (tmp_path / "x.shp").write_bytes(head + record)
    geo.register(spark)
    r = spark.read.format("track_shapefile").load(str(tmp_path / "x.shp")).collect()
    assert len(r) == 1 and [(p.x, p.y) for p in r[0].geometry] == [(0.0, 0.0), (1.0, 1.0)]


def test_shapefile_attributes_ranges_and_projection(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, [(rng.uniform(-9, 9), rng.random()) for _ in range(rng.randint(0, 6))] or None, None if i % 7 == 0 else f"naïve {i}", None if i % 5 == 0 else rng.uniform(-1e9, 1e9), i % 3 == 0, i * 10**12) for i in range(500)]
    d = spark.createDataFrame(rows, f"id long, geometry {geo.LINE}, name string, size double, odd boolean, number long")
    geo.register(spark)
    path = str(tmp_path / "lines")
    d.repartition(2).write.format("track_shapefile").mode("append").save(path)
    want = sorted(str((r[0], [tuple(p) for p in r[1]], *r[2:])) for r in rows if r[1])
    for n in (7, 50_000):
        back = spark.read.format("track_shapefile").option("records", n).load(path)
        assert back.columns == ["id", "part", "geometry", "_id", "name", "size", "odd", "number"]  # id is the record's number
        assert sorted(str((r._id, [(p.x, p.y) for p in r.geometry], r["name"], r.size, r.odd, r.number)) for r in back.collect()) == want
        assert back.rdd.getNumPartitions() == (72 if n == 7 else 2)
    some = spark.read.format("track_shapefile").option("columns", "odd, NAME").load(path)
    assert some.columns == ["id", "part", "geometry", "name", "odd"] and some.where("odd").count() == sum(r[4] for r in rows if r[1])
    one = next((tmp_path / "lines").glob("*.prj"))
    one.write_text('PROJCS["ETRS_1989_UTM_Zone_32N"]')
    with pytest.raises(Exception, match="WGS 84"):
        spark.read.format("track_shapefile").load(path).count()
    assert spark.read.format("track_shapefile").option("crs", "any").load(path).count() == len(want)
    d.limit(3).write.format("track_shapefile").mode("overwrite").save(path)
    assert spark.read.format("track_shapefile").load(path).count() <= 3
    for f in (tmp_path / "lines").glob("*.shx"):
        f.unlink()
    assert spark.read.format("track_shapefile").load(path).count() == len([r for r in d.limit(3).collect() if r.geometry])


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(*fields):
    return b"".join(varint(n << 3 | (0 if isinstance(v, int) else 2)) + (varint(v) if isinstance(v, int) else varint(len(v)) + v) for n, v in fields)


def zig(n):
    return n << 1 if n >= 0 else -n * 2 - 1


def test_pbf(spark, tmp_path):
    strings = message(*[(1, s.encode()) for s in ("", "railway", "rail", "bridge", "yes", "layer", "1")])
    packed = lambda v, s=False: b"".join(varint(zig(x) if s else x) for x in v)
    dense = message((1, packed([1, 1, 1], True)), (8, packed([510000000, 1000, 1000], True)), (9, packed([110000000, 0, 1000], True)))
    way = message((1, 77), (2, packed([1, 3, 5])), (3, packed([2, 4, 6])), (8, packed([1, 1, 97], True)))
    block = message((1, strings), (2, message((2, dense), (3, way))))
    blob = message((2, len(block)), (3, zlib.compress(block)))
    head = message((1, b"OSMData"), (3, len(blob)))
    other = message((1, b"OSMHeader"), (3, 3))
    (tmp_path / "x.osm.pbf").write_bytes(struct.pack(">i", len(other)) + other + b"abc" + struct.pack(">i", len(head)) + head + blob)
    geo.register(spark)
    d = spark.read.format("track_osm_pbf").load(str(tmp_path / "x.osm.pbf")).cache()
    assert d.where("kind = 'node'").count() == 3
    ways = geo.lines_of_ways(d.where("kind = 'way'").select("id", "refs", "tags"), d.where("kind = 'node'").select("id", "lon", "lat"))
    r = ways.collect()
    assert len(r) == 1 and len(r[0].geometry) == 2 and abs(r[0].geometry[0].y - 51.0) < 1e-9
    kinds = geo.infrastructure_ways(ways).collect()
    assert {(k.kind, k.layer) for k in kinds} == {("bridge", 1), ("railway", 1)}
    assert geo.railways(ways).first().railway_type == "rail"


def test_pbf_ranges_and_filters(spark, tmp_path):
    rng = random.Random(3)
    rows = [("node", rng.randint(-(2**40), 2**40), round(rng.uniform(-180, 180), 7), round(rng.uniform(-90, 90), 7), None, {"railway": "stop", "name": "é"} if i % 7 == 0 else {}) for i in range(3000)]
    rows += [("way", i, None, None, [rng.randint(-(2**33), 2**33) for _ in range(i % 5)], {"railway": "rail"} if i % 3 == 0 else {"highway": "x" * (i % 50)}) for i in range(900)]
    geo.register(spark)
    d = spark.createDataFrame(rows, pbf.ELEMENT)
    path = str(tmp_path / "out")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(pbf, "BLOCK", 100)  # of this process; workers were forked before
        d.repartition(2).write.format("track_osm_pbf").mode("append").save(path)
    plain = lambda rows: sorted(map(str, ((k, i, lon and round(lon, 7), lat and round(lat, 7), refs, sorted((tags or {}).items())) for k, i, lon, lat, refs, tags in rows)))
    for size in (97, 5000, 1 << 25):
        got = spark.read.format("track_osm_pbf").option("range", size).load(path)
        assert plain(map(tuple, got.collect())) == plain(rows)
        assert got.rdd.getNumPartitions() >= (30 if size == 97 else 2)
        ways = got.where("kind = 'way'")
        assert plain(map(tuple, ways.collect())) == plain(r for r in rows if r[0] == "way")
        rails = spark.read.format("track_osm_pbf").option("range", size).option("keys", "railway").load(path)
        assert plain(map(tuple, rails.collect())) == plain(r for r in rows if "railway" in r[5])
    d.limit(5).write.format("track_osm_pbf").mode("overwrite").save(path)
    assert spark.read.format("track_osm_pbf").load(path).count() == 5
    # bytes that look like a header aren't taken for one
    fake = pbf.blob(b"OSMData", pbf.block_of("way", pa.RecordBatch.from_pylist([{"kind": "way", "id": 1, "refs": [1], "tags": {"a": "b"}}], pbf._ARROW)))
    noise = struct.pack(">i", 4) + b"\x0a\x07OSMData" + b"z" * 40
    (tmp_path / "one.pbf").write_bytes(pbf.blob(b"OSMHeader", noise * 3) + fake)
    for size in (1, 9, 60):
        assert spark.read.format("track_osm_pbf").option("range", size).load(str(tmp_path / "one.pbf")).count() == 1
    with pytest.raises(Exception, match="NotFound|No such|not.*found"):
        spark.read.format("track_osm_pbf").load(str(tmp_path / "none.pbf")).count()


def test_one_collection_by_ranges(spark, tmp_path):
    rng = random.Random(1)
    odd = ['a "quoted" {', "back\\\\slash\\\\", "tail\\\\\"}]", "é{[", "", "\\\\" * 9, "x" * 500]
    made = [{"type": "Feature", "properties": {"n": str(i), "text": odd[i % 7], "deep": json.dumps({"a": [1, {"b": "]"}]})}, "geometry": {"type": "LineString", "coordinates": [[i, 0.5], [i + 1, rng.random()]]}} for i in range(60)]
    for indent in (None, 1):
        text = json.dumps({"type": "FeatureCollection", "name": "a\"b{", "crs": {"type": "name", "properties": {"name": "x", "sub": {"type": "Other"}}}, "bbox": [0, 1], "features": made}, indent=indent, ensure_ascii=bool(indent))
        (tmp_path / "c.json").write_text(text)
        want = sorted(map(str, geo.read_geojson(spark, str(tmp_path / "c.json")).drop("feature_id").collect()))
        for size in (333, 1 << 20):
            got = geo.read_geojson(spark, str(tmp_path / "c.json"), split=size)
            assert sorted(map(str, got.drop("feature_id").collect())) == want and len(want) == 60


def test_overpass_and_structures(spark, tmp_path):
    reply = {"elements": [{"type": "way", "id": 5, "nodes": [1, 2, 99]}, {"type": "node", "id": 1, "lat": 51.0, "lon": 11.0}, {"type": "node", "id": 2, "lat": 51.001, "lon": 11.0}, {"type": "way", "id": 6, "nodes": [1]}]}
    (tmp_path / "o.json").write_text(json.dumps(reply))
    s = geo.read_overpass(spark, str(tmp_path / "o.json"), "tunnel")
    assert s.count() == 1 and geo.structure_places(s).count() == 2
    p = spark.createDataFrame([(1, 51.0, 11.00005), (2, 52.0, 11.0)], "p long, lat double, lon double")
    got = {r.p: r.structure_status for r in spatial.structure_status(p, geo.structure_places(s), 10.0, "p").collect()}
    assert got == {1: "near tunnel 5", 2: "clear"}
    s.select("structure_id", "structure_type", F.to_json("coordinates").alias("coordinates")).write.option("header", True).option("escape", '"').csv(str(tmp_path / "s.csv"))
    assert geo.read_structures_csv(spark, str(tmp_path / "s.csv")).first().coordinates[1].lat == 51.001
    assert geo.regions(spark).count() == 16


def test_elevation(spark):
    p = spark.createDataFrame([(i, 51.0 + i, 11.0) for i in range(5)], "i long, GPS_lat double, GPS_lon double").coalesce(1)
    ask = lambda places: [lat * 10 for lat, _ in places] if places[0][0] < 53 else 1 / 0
    assert [r.elevation for r in elevation.from_service(p, ask, batch=2).orderBy("i").collect()] == [510.0, 520.0, None, None, None]
    g = spark.createDataFrame([(51, 11, 7.0)], "iy int, ix int, elevation double")
    assert [r.elevation for r in elevation.from_grid(p, g, 1.0).orderBy("i").collect()] == [7.0, None, None, None, None]


def ways(spark):
    m = 1 / 111_320.0
    rows = [(1, "bridge", 1, [(0, 0), (100, 0)]), (2, "railway", 0, [(50, -50), (50, 50)]), (3, "bridge", 1, [(1000, 0), (1100, 0)]), (4, "railway", 1, [(990, 0.5), (1110, -0.5)]), (5, "bridge", 0, [(2000, 0), (2100, 0)]), (6, "railway", 0, [(2000, 6), (2100, 6)]), (7, "tunnel", -1, [(3000, 0), (3100, 0)]), (7, "railway", -1, [(3000, 0), (3100, 0)])]
    return spark.createDataFrame([(i, k, y, [(10 + a * m, b * m) for a, b in g]) for i, k, y, g in rows], f"id long, kind string, layer int, geometry {geo.LINE}")


def test_under_on_unknown(spark):
    d = ways(spark)
    assert [r.id for r in infrastructure.bridges(d).collect()] == [1]
    assert [r.id for r in infrastructure.bridges(d, rule="layer").collect()] == [1]
    c = infrastructure.combined(d, region="sachsen").collect()
    assert {(r["index"], r.infrastructure, r.position, r.bundesland) for r in c} == {(1, "bridge", "under", "sachsen"), (7, "tunnel", "in", "sachsen")}


def test_daily_pipeline_and_products(spark):
    rows = [("d", i + 1, datetime(2024, 4, 2) + timedelta(seconds=i), 51 + i * 1e-4, 11 + i * 2e-5, 12.0) for i in range(120)] + [("bad", 1, None, None, None, None)]
    d = spark.createDataFrame(rows, "track_id string, seq int, ts timestamp_ntz, GPS_lat double, GPS_lon double, speed double")
    out = daily.run(d)
    assert {r.track_id for r in out.collect()} == {"d"}
    assert {"curvature_heading_dx_ds_grad", "segment_type", "mean_radius", "steps"} <= set(out.columns)
    assert out.agg(F.min(F.col("cumulative_distance_m"))).first()[0] == 0
    long, span = products.yaw_chart(out, T, "elapsed_time_s")
    assert long.count() > 0 and span.first().lo is not None
    assert products.speed_layer(d.where("track_id = 'd'"), T, "speed", "GPS_lat", "GPS_lon").first().colour == 0.5
    assert products.has_radius(out, "mean_radius").count() == out.where("mean_radius is not null").count()
    a, b = products.elevation_chart(d, T, "ts", "GPS_lat", "speed")
    assert a.count() == 240 and b.first().lo == 12.0
    assert products.curvature_strip(out, T, "curvature_heading_dx_ds_grad").count() == out.count() - 1
    assert products.tunnel_layer(d.where("track_id = 'd'").withColumn("tunnel", F.when(F.col("seq") < 3, 1)), T, "tunnel", "GPS_lat", "GPS_lon").count() == 1


def test_streams(spark, tmp_path):
    rng, base = random.Random(7), 1_700_000_000
    rows, speed = [], {1: 0.0, 2: 9.0, 3: 4.0}
    for i in range(240):
        for k in speed:
            speed[k] = 0.0 if (i // 40 + k) % 3 == 0 else 8.0 + 6 * ((i // 25) % 2) + rng.random()
            rows.append((k, datetime.fromtimestamp(base + i, UTC).replace(tzinfo=None), 51 + i / 1e4, 11.0 + k, speed[k]))
    kind = "track long, ts timestamp_ntz, lat double, lon double, speed double"
    shuffled = sorted(rows, key=lambda r: r[1].timestamp() + rng.uniform(0, 15))  # out of order by 15 seconds at most
    for n in range(0, len(shuffled), 90):
        part = spark.createDataFrame(shuffled[n : n + 90], kind).withColumn("ts", F.col("ts").cast("timestamp"))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
        time.sleep(0.02)  # files are read in the order of their times
    late = [(9, datetime.fromtimestamp(base + 10_000 + k, UTC).replace(tzinfo=None), 0.0, 0.0, 0.0) for k in (0, 9000)] + [(1, rows[0][1], 99.0, 99.0, 99.0)]  # the last is too late
    for r in late:
        spark.createDataFrame([r], kind).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
        time.sleep(0.02)
    stream = spark.readStream.schema("track long, ts timestamp, lat double, lon double, speed double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s"))
    q = live.live_stops(stream, track="track", late="20 seconds").writeStream.format("memory").queryName("stops").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    got = sorted(tuple(r) for r in spark.table("stops").where("track < 9").collect())
    want = []
    for k in speed:
        own = [(r[1].replace(tzinfo=UTC).timestamp(), r[4]) for r in sorted(rows) if r[0] == k]
        for i, j, stop in sequential.pieces(np.array([t for t, _ in own]), np.array([v for _, v in own])):
            mean = sum(v for _, v in own[i:j]) / (j - i)
            want.append((k, own[i][0], own[j - 1][0], "STOP" if stop else f"MOVING_{sequential.speed_class(mean, sequential.SPEED_BINS)}", j - i))
    assert [(*r[:4], r[7]) for r in got] == sorted(want) and len(want) > 20
    spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id) ts, 1L track_id, cast(id as double) v from range(100)").write.parquet(str(tmp_path / "m"))
    stream = spark.readStream.schema("ts timestamp, track_id long, v double").parquet(str(tmp_path / "m"))
    q = live.live_means(stream, "track_id", "ts", "10 seconds", "5 seconds", "v").writeStream.format("memory").queryName("means").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert spark.sql("select min(v) from means").first()[0] == 4.5
