"""Every named query against its SQL in another engine, or rows only where SQL cannot say it."""

import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as contract

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def canonical(rows, cols):
    def one(v):
        if isinstance(v, (decimal.Decimal, float)):
            v = float(v)
            return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
        return str(v)

    order = [cols.index(c) for c in sorted(cols)]
    return sorted(tuple(one(r[i]) for i in order) for r in rows)


def test_names():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    ref = duck.execute(ORACLES[name])
    cols = [c[0] for c in ref.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == canonical(ref.fetchall(), cols)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).limit(1).count() == 1


def test_entry(spark):
    assert contract.entry(spark).columns == ["time", "default_rate"]
