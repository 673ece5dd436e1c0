"""Query op11 and its SQL: ten rounds of k-means over all embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackforge.llm.common import table
from trackforge.llm.yinyang import cluster

ROUNDS = 10


def op11_yinyang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"), 8, rounds=ROUNDS, seed=3, dim=64)


#: Every vector against every centroid, round by round.
_ROUND = """a{r} AS MATERIALIZED (SELECT i, vec_id, e, c, d FROM (SELECT v.*, c, list_sum(list_transform(range(1, 65), lambda j: (v.e[j] - z.e[j]) * (v.e[j] - z.e[j])))::BIGINT AS d FROM v, c{r} z) QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, c) = 1)"""
_MEANS = """,
c{n} AS MATERIALIZED (SELECT c, list(m ORDER BY j) AS e FROM (SELECT c, j, ((s - ((s % n) + n) % n) // n)::BIGINT AS m FROM (SELECT c, j, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(e) AS x, generate_subscripts(e, 1) AS j FROM a{r}) GROUP BY c, j)) GROUP BY c
       UNION ALL SELECT c, e FROM c{r} WHERE c NOT IN (SELECT c FROM a{r})),
"""
SQL = (
    """WITH v AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, e FROM v ORDER BY sha256('3:' || vec_id) LIMIT 8),
"""
    + "".join(_ROUND.format(r=r) + _MEANS.format(r=r, n=r + 1) for r in range(ROUNDS))
    + _ROUND.format(r=ROUNDS)
    + f""" SELECT vec_id, a.c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(z.e, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} z ON a.c = z.c"""
)
