"""Query op8: log10 probabilities of all documents under a unigram and the hidden Markov model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackforge.llm.common import LOWER, UPPER, table
from trackforge.llm.hmm import Config, score


def op8_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string")) % 10
    out = score(table(spark, sf_dir, "documents"), fold != 0)
    return out.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def unigram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op8 that SQL can say; it can't say crc32, so the fold is the query's own."""
    fold = F.col("doc_id") % 10
    out = score(table(spark, sf_dir, "documents"), fold != 0, cfg=Config(states=2, rounds=1))
    return out.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


SQL = rf"""
WITH d AS (SELECT doc_id, doc_id % 10 <> 0 AS t, list_append(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+'), ' ') AS w FROM documents),
x AS (SELECT doc_id, t, unnest(w) AS w FROM d), c AS (SELECT w, count(*) AS c FROM x WHERE t GROUP BY w), n AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT doc_id, NOT t AS held_out, count(*)::BIGINT AS n_tokens, count(c)::BIGINT AS n_known, any_value(n)::BIGINT AS train_tokens, round(sum(log10((coalesce(c, 0) + 0.1) / (n + 0.1 * (v + 1)))), 4) AS base_score
FROM x LEFT JOIN c USING (w), n GROUP BY doc_id, t
"""
