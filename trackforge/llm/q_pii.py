"""Query op9: personal data of every document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackforge.llm.common import table
from trackforge.llm.pii import KINDS, find


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"] != "term")
    return out.select("doc_id", *map(count, KINDS[:4]), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op9 that SQL can say."""
    return op9_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_DOUBLED = f"CASE WHEN i % 2 = 0 THEN {_DIGITS}[len({_DIGITS}) - i]::INT WHEN {_DIGITS}[len({_DIGITS}) - i]::INT > 4 THEN {_DIGITS}[len({_DIGITS}) - i]::INT * 2 - 9 ELSE {_DIGITS}[len({_DIGITS}) - i]::INT * 2 END"
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'))::BIGINT AS n_email,
 len(list_filter(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda m: len(list_filter(string_split(m, '.'), lambda p: coalesce(TRY_CAST(p AS BIGINT) <= 255, false))) = 4))::BIGINT AS n_ip,
 len(list_filter(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda m: len({_DIGITS}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(0, len({_DIGITS})), lambda i: {_DOUBLED})) % 10 = 0))::BIGINT AS n_card,
 len(list_filter(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda m: len({_DIGITS}) BETWEEN 9 AND 15))::BIGINT AS n_phone
FROM d
"""
