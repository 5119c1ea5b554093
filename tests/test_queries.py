"""Every named query of the library against its oracle on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from lexiloom.plans import exchange, lexical, reports

ORACLES, QUERIES = exchange.ORACLES, exchange.QUERIES
assert lexical.QUERIES is QUERIES and reports.QUERIES is QUERIES  # one register

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: round(v, 6) if isinstance(v, float) else str(v) if v is not None and not isinstance(v, (int, bool, str)) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    found = duck.execute(ORACLES[name])
    want = rows([c[0] for c in found.description], found.fetchall())
    assert got == want


def test_registries_agree():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(ORACLES) == set(QUERIES)
