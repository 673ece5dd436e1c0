"""Files are cut into tasks that neither grow in number with small ranges nor read beyond their own range."""

import io

from pyspark.sql import functions as F

from trackforge.sources import geo, pbf, sinks


def test_ranges_of_large_files():
    assert pbf.range_size(4000, 32 << 20, 100_000) == 4000
    assert 900 << 20 <= 256 * pbf.range_size(4000, 32 << 20, 900 << 20) <= 901 << 20
    assert pbf.range_size(4000, 32 << 20, 1 << 40) == 32 << 20


def test_search_for_a_header_stays_in_its_range():
    class Counted(io.BytesIO):
        most = 0

        def read(self, n=-1):
            got = super().read(n)
            self.most += len(got)
            return got

    f = Counted(bytes(3 << 20))
    assert pbf.first_header(f, 4000, 8000, 3 << 20) is None
    assert f.most <= 8000


def test_large_collections_are_several_files(spark, tmp_path):
    vertex = F.struct(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y"))
    d = spark.range(95).select("id", F.array(vertex, vertex).alias("geometry"))
    for most, files in ((100, 1), (20, 5), (None, 1)):
        path = tmp_path / str(most)
        sinks.write_collection(d, str(path), most=most)
        assert len(list(path.glob("part-*"))) == files
        for split in (None, 500):
            got = sorted(int(r.properties["id"]) for r in geo.read_geojson(spark, str(path), split=split).collect())
            assert got == list(range(95))
