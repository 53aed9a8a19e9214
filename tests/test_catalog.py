"""Every registered floor-plan query against its SQL twin in DuckDB, and brute force for the few without one."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from planfold import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    same = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else f"{float(x):.4f}" if isinstance(x, (int, float)) and not isinstance(x, bool) or type(x).__name__ == "Decimal" else str(x)
    return sorted(str([same(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_twin(spark, sf, duck, name):
    got = catalog.QUERIES[name](spark, sf)
    expected = duck.sql(catalog.ORACLE[name])
    assert sorted(got.columns) == sorted(expected.columns)
    assert canonical(got.collect(), got.columns) == canonical(expected.fetchall(), expected.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
