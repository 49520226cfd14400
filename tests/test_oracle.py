"""Every registered query equals its DuckDB oracle on the smallest supplied tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

import __spark_entry__ as E  # noqa: E402

ORACLE = E.oracle_sql()
KEYS = sorted(E.queries())


@pytest.fixture(scope="module")
def duck(sf_small):
    duckdb = pytest.importorskip("duckdb")
    from compare import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return con


def test_every_key_registered():
    assert len(KEYS) >= 60
    missing = set(ORACLE) - set(KEYS)
    assert not missing


@pytest.mark.parametrize("key", KEYS)
def test_key_matches_oracle(spark, sf_small, duck, key):
    from compare import digest

    df = E.queries()[key](spark, sf_small)
    rows = [tuple(r) for r in df.collect()]
    if key not in ORACLE:
        assert df.columns and rows is not None
        return
    res = duck.execute(ORACLE[key])
    ocols = [d[0] for d in res.description]
    s = digest(df.columns, rows)
    o = digest(ocols, res.fetchall())
    assert s[0] == o[0], f"columns differ: {s[0]} vs {o[0]}"
    assert s[1] == o[1], f"row counts differ: {s[1]} vs {o[1]}"
    assert s[2] == o[2], f"values differ: {sorted(set(s[3]) ^ set(o[3]))[:4]}"


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and len(df.columns) == 17
