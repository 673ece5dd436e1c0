"""Query op5 and its SQL: links and components of all embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackforge.llm.common import table
from trackforge.llm.epsilon_grid import near_vectors


def op5_epsilon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: All pairs: for tables small enough to test by.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, e, len(e) AS k, sqrt(list_sum(list_transform(e, lambda q: q * q))) AS n FROM v WHERE len(list_filter(e, lambda q: q IS NOT NULL AND isfinite(q))) = len(e)),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id < b.vec_id AND a.k = b.k AND a.n > 0 AND b.n > 0 WHERE CASE WHEN a.k = b.k THEN list_dot_product(a.e, b.e) END / (a.n * b.n) >= 0.95),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x)
SELECT v.vec_id, (SELECT count(*) FROM e WHERE e.x = v.vec_id)::BIGINT AS n_links, low AS component_id, v.vec_id = low AS kept
FROM v JOIN (SELECT a AS vec_id, min(b) AS low FROM r GROUP BY a) USING (vec_id)
"""
