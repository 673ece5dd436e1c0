"""Connected components of a table of links by alternating large-star and small-star steps.

Links stay distributed; each step takes a minimum per node (summed up before the shuffle) and joins
it back, so a node with very many links is a skewed join that Spark can split. Every round is
written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackforge.llm.common import Scratch


def _large(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return both.join(low, both["a"] == low["u"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(e: DataFrame) -> DataFrame:
    # every link runs from the larger end (a) to the smaller (b)
    low = e.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
    j = e.join(low, e["a"] == low["u"])
    return j.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(j.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (its smallest node): for each node that has a link to another. links: a, b."""
    e = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, mark = scratch.write(e), None
    while True:
        new = scratch.write(_small(_large(now)))
        r = new.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))).alias("h")).first()
        scratch.drop(now)
        now = new
        if (r["n"], r["h"]) == mark:
            break
        mark = (r["n"], r["h"])
    out = now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
    out._scratch_path = now._scratch_path
    return out
