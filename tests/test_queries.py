"""Every registered query of the formula engine against its SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__
from quillgrid import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def key(row):
    return tuple((x is not None, str(type(x)), x) for x in row)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, sf, con, name):
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in cols)
    expect = sorted((tuple(map(cell, r)) for r in con.execute(f"SELECT {quoted} FROM ({catalog.ORACLE_SQL[name]})").fetchall()), key=key)
    got = sorted((tuple(map(cell, r)) for r in df.select(*[df[c] for c in cols]).collect()), key=key)
    assert got == expect


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.ORACLE_SQL) == set(catalog.QUERIES)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
