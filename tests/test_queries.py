"""Every query of the library against its DuckDB twin on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tideglass.jobs import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def twin(sql, data=DATA):
    con = duckdb.connect()
    for t in TABLES:
        f = f"{data}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{f}/*.parquet')" if os.path.isdir(f) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{f}')")
    return con.sql(sql).df()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    clean = [[None if v is None or v != v else round(v, 5) + 0.0 if isinstance(v, float) else v for v in r] for r in frame.astype(object).values.tolist()]
    return sorted(map(tuple, clean), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_its_twin(spark, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    want = twin(registry.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_without_twin_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    found = entry.entry(spark)
    assert found.columns == ["candidate_id", "info_gain"] and found.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
