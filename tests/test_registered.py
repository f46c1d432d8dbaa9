"""Every registered query of the core runs on the smallest tables and gives the rows of its SQL."""

import os

import duckdb
import pytest

import __spark_entry__
from veriscreen.plans import queries as plans

SF_DIR = "/root/testdata/sf0.001"
ALL = __spark_entry__.queries()
CORE = sorted(set(ALL) & set(plans.QUERIES))


def plain(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return str(value) if isinstance(value, (list, tuple, dict)) else value


def table(columns, rows):
    """Rows with their values in the order of the columns' names."""
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for name in os.listdir(SF_DIR):
        db.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{name}'")
    yield db
    db.close()


def compared(spark, duck, name):
    df = ALL[name](spark, SF_DIR)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    sql = __spark_entry__.oracle_sql().get(name)
    if sql is not None:
        found = duck.execute(sql)
        assert got == table([c[0] for c in found.description], found.fetchall())


@pytest.mark.parametrize("name", CORE)
def test_core_queries(spark, duck, name):
    compared(spark, duck, name)
