"""Every query of the catalog against its SQL in DuckDB."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__
from feedloom.plans import catalog, relational, scalars  # noqa: F401
from feedloom.plans.fixtures import TABLES

AT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{AT}/{t}.parquet'")
    return c


def shown(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, oracle, name):
    df = catalog.QUERIES[name](spark, AT)
    columns = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    if name not in catalog.SQL:
        assert got
        return
    rows = oracle.sql(catalog.SQL[name])
    assert sorted(rows.columns) == columns
    at = [rows.columns.index(c) for c in columns]
    assert got == sorted(tuple(shown(r[i]) for i in at) for r in rows.fetchall())


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 20
    assert sorted(r.batch_order for r in rows) == list(range(20))
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
