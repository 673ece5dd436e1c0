"""Track logs in CSV files, one or many, and where they were read from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackforge.core import nan_to_null, with_seq
from trackforge.operators.kinematics import TIME_FORMAT

#: Columns of the raw log.
RAW_LOG = T.StructType([
    T.StructField("DatumZeit", T.StringType()), T.StructField("GPS_lat", T.DoubleType()), T.StructField("GPS_lon", T.DoubleType()), T.StructField("Geschwindigkeit in m/s", T.DoubleType()),
    T.StructField("Gier", T.DoubleType()), T.StructField("Gier_GPS", T.DoubleType()), T.StructField("GPS Qualität", T.IntegerType()), T.StructField("Beschleunigung in m/s2", T.DoubleType())])


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None, *, encoding: str = "utf-8", suffix: str = ".csv", times: list[str] | None = None) -> DataFrame:
    """A file or all files below a folder whose names end in the suffix. Columns are found by name in
    each file's header. Given times are parsed (a bad one is an error); NaN becomes null."""
    r = spark.read.option("header", True).option("encoding", encoding).option("enforceSchema", False).option("recursiveFileLookup", True)
    r = r.option("pathGlobFilter", f"*{suffix}") if suffix else r
    df = nan_to_null((r.schema(schema) if schema else r.option("inferSchema", True)).csv(path))
    return df.withColumns({c: F.to_timestamp_ntz(F.col(c).cast("string"), F.lit(TIME_FORMAT)) for c in times or ()})


def listing(df: DataFrame) -> DataFrame:
    """path, name, file_date: the files that a table was read from."""
    m = df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name")).distinct()
    return m.withColumn("file_date", date_in(F.col("name")))


def date_in(name: F.Column) -> F.Column:
    """The date in a file's name, or null."""
    return F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})", 1).try_cast("date")


def files(spark: SparkSession, folder: str, suffix: str = ".csv", *, name_holds: str = "") -> DataFrame:
    """path, relative, file_date of all files below a folder, without reading them."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(folder).select("path")
    root = folder.rstrip("/").rpartition("/")[2]
    d = d.select("path", F.substring_index("path", f"/{root}/", -1).alias("relative")).withColumn("file_date", date_in(F.col("relative")))
    return d.where(F.contains("relative", F.lit(name_holds)))


def as_tracks(raw: DataFrame, ts: str = "DatumZeit", *tiebreak: str) -> DataFrame:
    """The log with track_id and track_date (the day) and seq (place within it, by time)."""
    d = raw.withColumn("track_date", F.to_date(ts)).withColumn("track_id", F.col("track_date").cast("string"))
    return with_seq(d, "track_id", ts, *tiebreak)


def with_raw(processed: DataFrame, raw: DataFrame, *columns: str, date: str = "track_date") -> DataFrame:
    """A processed track's time axis beside the raw log's of the same day: side, date, columns."""
    days = processed.select(date).distinct()
    r = raw.join(days, date, "left_semi").select(F.lit("raw").alias("side"), date, *columns)
    return processed.select(F.lit("processed").alias("side"), date, *[c for c in columns if c in processed.columns]).unionByName(r, allowMissingColumns=True)
