"""Every registered core query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from lodeweave.plans.queries import ORACLE, QUERIES

from conftest import DATA

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return db


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, tables, name):
    df = QUERIES[name](spark, DATA)
    result = tables.execute(ORACLE[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in df.collect()))) == sorted(map(repr, result.fetchall()))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).columns


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
