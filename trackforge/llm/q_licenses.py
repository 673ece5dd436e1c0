"""Query op7: license phrases and notices of every document; and the part of it that SQL can say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackforge.llm.common import LOWER, UPPER, table
from trackforge.llm.licenses import scan


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["exact"])
    starts = F.transform(base, lambda s: s["start"])
    labels = lambda a: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(a, lambda s: s["label"]))))
    return out.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["covered"])), F.lit(0.0)).alias("score"))


def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p(label, q) AS (VALUES ('mit', ['mit', 'license']), ('apache', ['apache', 'license']), ('gpl', ['general', 'public', 'license'])),
h AS (SELECT doc_id, label, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1 : i + len(q)] = q)) AS i FROM d, p)
SELECT d.doc_id, len(w)::BIGINT AS n_words, count(i)::BIGINT AS n_base, min(i)::BIGINT AS first_word, max(i)::BIGINT AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
FROM d LEFT JOIN h ON d.doc_id = h.doc_id GROUP BY d.doc_id, w
"""
