"""URL filters as a sort-merge range join.

A rule (host, path) is the prefix of all keys "reversed host?path" that it fits, so it is an interval
of sorted keys, and intervals of prefixes nest ("?" is in no host). Every url has a key for each
ending of its host that has as many labels as some rule's. The distinct keys and the rules are
range-partitioned and sorted together; one sweep per partition keeps the stack of rules whose interval is
open. A partition's first key tells which rules are open at its start (the prefixes of that key that are
rules), and these are handed to it.
The keys that a rule fits are joined back to the urls, and these to the pages, so that a page, host or
key that repeats without end is judged once and then is a skewed equi-join, which Spark splits.

Defined results: a null url or one without "://" has an empty host and path; a rule's null host or path
is an empty one: an empty path is the start of every path, an empty host fits empty hosts and those that
end with a dot; a repeated rule counts once, and where one has both verdicts "block" wins; one result per
row of pages, also for repeated rows and null ids; empty tables give no rows or the default verdict;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackforge.llm.common import Scratch, lower_ascii

_PARTS = r"(?s)\A.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def judge(pages: DataFrame, rules: DataFrame, *, page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """page_id, url_hash, host, path, rule (host + path of the longest that fits, or null), verdict: one
    row per row of pages.

    rules: host, path, verdict.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    r = rules.groupBy(lower_ascii(text("host")).alias("host"), text("path").alias("path")).agg(F.max("verdict").alias("verdict"))  # block > allow
    r = r.select(_key(F.split("host", r"\.", -1), F.col("path")).alias("key"), F.concat("host", "path").alias("rule"), "verdict")
    p = pages.select(F.col(page_id).alias("id"), F.xxhash64(url).alias("url_hash"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    labels = F.split("host", r"\.", -1)
    # a rule fits only hosts' endings of as many labels as its own host has
    sizes = sorted(x[0] for x in rules.select(F.size(F.split(text("host"), r"\.", -1))).distinct().collect())
    domains = F.transform(F.filter(F.lit(sizes).cast("array<int>"), lambda n: n <= F.size(labels)), lambda n: F.slice(labels, -n, n))
    urls = p.select("host", "path").distinct().select("host", "path", F.explode(domains).alias("domain")).select("host", "path", _key(F.col("domain"), F.col("path")).alias("key"))
    fit = _fitting(urls.select("key").distinct(), r, scratch)
    best = urls.join(fit, "key").groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("best"))
    out = p.join(best, ["host", "path"], "left")
    return out.select(F.col("id").alias(page_id), "url_hash", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.concat_ws(".", F.reverse(labels)), F.lit("?"), path)


def _fitting(keys: DataFrame, rules: DataFrame, scratch: Scratch) -> DataFrame:
    """key, rule, verdict: the longest rule (key, rule, verdict) that is a prefix of a key; keys that have none are left out."""
    none = [F.lit(None).cast("string").alias(c) for c in ("rule", "verdict")]
    both = keys.select("key", F.lit(1).alias("kind"), *none).unionByName(rules.select("key", F.lit(0).alias("kind"), "rule", "verdict"))
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = scratch.write(both.repartitionByRange(n, "key").withColumn("part", F.spark_partition_id()), last=True)
    # Rules are shorter than a key that goes on forever: only lengths that rules have, fewer than the longest rule has characters.
    lengths = sorted(x[0] for x in rules.select(F.length("key")).distinct().collect())
    starts = dealt.groupBy("part").agg(F.min("key").alias("first"))
    # A rule equal to the first key is in the partition itself.
    prefixes = starts.select("part", "first", F.explode(F.lit(lengths).cast("array<int>")).alias("n")).where(F.col("n") < F.length("first")).select("part", F.substring("first", F.lit(1), F.col("n")).alias("key"))
    open_at = prefixes.join(rules, "key").select("key", F.lit(-1).alias("kind"), "rule", "verdict", "part")
    lines = dealt.unionByName(open_at).repartition(n, "part").sortWithinPartitions("part", F.expr("kind >= 0"), "key", "kind")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, str, str]] = []
        part = None
        for b in batches:
            parts, keys, kinds, names, verdicts = (b.column(c).to_pylist() for c in ("part", "key", "kind", "rule", "verdict"))
            take, rule, verdict = [], [], []
            for i, key in enumerate(keys):
                if parts[i] != part:
                    part, stack = parts[i], []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kinds[i] < 1:
                    stack.append((key, names[i], verdicts[i]))
                elif stack:
                    take.append(i)
                    rule.append(stack[-1][1])
                    verdict.append(stack[-1][2])
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(take, pa.int64())), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["key", "rule", "verdict"])

    return lines.select("part", "key", "kind", "rule", "verdict").mapInArrow(sweep, "key string, rule string, verdict string")
