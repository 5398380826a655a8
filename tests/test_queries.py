"""Every registered query of the engine against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from tessera import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    return con


def rows(table):
    names = sorted(table.column_names)
    plain = lambda v: "nan" if isinstance(v, float) and v != v else v
    return names, sorted(repr([plain(v) for v in r]) for r in zip(*(table.column(n).to_pylist() for n in names), strict=True))


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_against_sql(spark, views, name):
    found = rows(queries.queries()[name](spark, SF).toArrow())
    assert found == rows(views.sql(queries.oracle_sql()[name]).arrow().read_all())


def test_entry(spark):
    assert set(queries.oracle_sql()) == set(queries.queries())
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
