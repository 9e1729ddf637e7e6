"""Every query with SQL against DuckDB on the smallest tables, as the driver compares them."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        c.execute(f"CREATE VIEW {f.partition('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    assert sorted(rows, key=repr) == sorted(want.fetchall(), key=repr)


#: Queries whose answer is empty whatever the data.
NOTHING = {"filter_wrong_type", "str_on_int"}


def test_every_query_has_an_answer_on_larger_tables():
    c, at = duckdb.connect(), "/root/testdata/sf0.01"
    for f in sorted(os.listdir(at)):
        c.execute(f"CREATE VIEW {f.partition('.')[0]} AS SELECT * FROM '{at}/{f}'")
    none = {name for name, sql in ORACLES.items() if not c.execute(f"SELECT count(*) FROM ({sql})").fetchone()[0]}
    assert none == NOTHING
