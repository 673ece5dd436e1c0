"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from trackforge import io_queries, queries  # noqa: F401

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def canon(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    cell = lambda v: "null" if v is None or v != v else repr(round(v, 5) + 0.0) if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, db, name):
    got = queries.QUERIES[name](spark, SF)
    want = db.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    a, b = canon([tuple(r) for r in got.collect()], got.columns), canon(want.fetchall(), columns)
    assert len(a) == len(b) > 0
    far = [(x, y) for x, y in zip(a, b) if x != y]
    assert len(far) <= len(a) * 1e-4, far[:3]  # a last digit may round the other way


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_entry(spark):
    d = entry.entry(spark)
    assert d.count() > 0
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "NestedLoop" not in plan
    assert plan.count("Exchange hashpartitioning(track_id") <= 2  # all windows share one; the sum has its own


def test_optional_package_is_optional(monkeypatch, spark):
    real = entry.importlib.import_module

    def without(name):
        if name.startswith(("trackforge.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name=name.rpartition(".")[0] or name)
        return real(name)

    monkeypatch.setattr(entry.importlib, "import_module", without)
    assert set(entry.queries()) == set(queries.QUERIES)
    assert set(entry.oracle_sql()) == set(queries.ORACLE_SQL)
