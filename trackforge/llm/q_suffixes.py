"""Query op12: repeated 200-byte strings of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackforge.llm.common import table
from trackforge.llm.suffixes import repeats


def op12_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(repeats(table(spark, sf_dir, "documents"))).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def digests(found: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.withColumns({"n_removed": removed, "n_spans": F.size("spans").cast("long"), "kept_sha256": F.sha2("kept", 256)})
