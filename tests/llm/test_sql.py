"""The SQL of this package's queries gives their rows on the same tables."""

import os

import duckdb
import pytest

from trackforge.llm import registry

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = registry.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want.fetchall()))
