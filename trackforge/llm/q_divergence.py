"""Query op13 and its SQL: distances between the sources of each language, and their telling terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackforge.llm.common import LOWER, UPPER, table
from trackforge.llm.divergence import audit


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents")).select("lang", "source", "part", "item", "value", "rank")


#: Term by term for each pair of groups.
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, unnest(list_append(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), '')) AS t FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
k AS (SELECT lang, t, count(*) AS ln FROM d WHERE t <> '' GROUP BY ALL HAVING count(DISTINCT r) >= 10),
l AS (SELECT lang, count(*) AS v, sum(ln) AS la FROM k GROUP BY lang),
c AS (SELECT lang, source, t, count(*) AS n FROM d JOIN k USING (lang, t) GROUP BY ALL),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS own FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.t, coalesce(n, 0) AS n, (1 + (1000000000 * (coalesce(n, 0) + 2)::HUGEINT) // (own + 2 * v))::BIGINT AS p, (1 + (1000000000 * (ln + 2)::HUGEINT) // (la + 2 * v))::BIGINT AS q
      FROM s JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.t = k.t),
y AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
z AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN y ON y.lang = a.lang AND y.source = a.source AND y.item = b.source
      UNION ALL SELECT lang, source, 'term', t, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM z) WHERE part = 'pair' OR rank <= 10
"""
