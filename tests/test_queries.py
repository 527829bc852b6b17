"""Every query of the engine against its SQL on the smallest test data."""

import glob
import os

import duckdb
import pytest

from corpusloom.plans import lifecycle, relational, semantic  # noqa: F401


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(relational.SQL))
def test_against_sql(spark, duck, data, name):
    df = relational.QUERIES[name](spark, data)
    found = duck.sql(relational.SQL[name])
    assert sorted(df.columns) == sorted(found.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(found.columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(relational.QUERIES) - set(relational.SQL)))
def test_runs(spark, data, name):
    """Whole results of queries without SQL; what they hold is tested by operator."""
    df = relational.QUERIES[name](spark, data)
    found = df.collect()
    assert found and len(set(df.columns)) == len(df.columns)
    assert all(any(r[c] is not None for r in found) for c in df.columns if c not in ("heading", "heading_path"))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
