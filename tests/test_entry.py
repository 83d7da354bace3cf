import os

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for file in os.listdir(SF):
        connection.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    return connection


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 44


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_and_sql_agree(spark, sql, name):
    found = __spark_entry__.queries()[name](spark, SF)
    names = sorted(found.columns)
    wanted = sql.execute(__spark_entry__.oracle_sql()[name])
    assert sorted(c[0] for c in wanted.description) == names
    order = [[c[0] for c in wanted.description].index(n) for n in names]
    rows = sorted(repr(tuple(r[i] for i in order)) for r in wanted.fetchall())
    assert sorted(repr(tuple(r[n] for n in names)) for r in found.collect()) == rows
