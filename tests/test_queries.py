"""Every registered query against its SQL counterpart on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry_point

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", list(entry_point.queries()))
def test_query_equals_sql(spark, sql, name):
    df = entry_point.queries()[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    text = entry_point.oracle_sql().get(name)
    if text is None:
        assert got
        return
    cursor = sql.execute(text)
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names) and got == rows_of(names, cursor.fetchall())


def test_envelopes_open_again(spark):
    rows = entry_point.queries()["encrypt_roundtrip"](spark, SF)
    assert rows.filter("sealed and email is null").count() == 0 and rows.filter("ip is null").count() == 0
    assert entry_point.queries()["rewrap_keys"](spark, SF).filter("not kept").count() == 0


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
