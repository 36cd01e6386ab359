"""Every registered query with SQL gives the rows DuckDB gives."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_point

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def in_order(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(row[i] for i in order)) for row in rows)


@pytest.mark.parametrize("name", sorted(entry_point.oracle_sql()))
def test_query_equals_sql(spark, duck, folder, name):
    df = entry_point.queries()[name](spark, folder)
    answer = duck.execute(entry_point.oracle_sql()[name])
    kinds = {d[0]: str(d[1]) for d in answer.description}
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds
    assert in_order(df.collect(), df.columns) == in_order(answer.fetchall(), list(kinds))


@pytest.mark.parametrize("name", sorted(set(entry_point.queries()) - set(entry_point.oracle_sql())))
def test_query_without_sql_has_rows(spark, folder, name):
    df = entry_point.queries()[name](spark, folder)
    assert len(df.columns) == len(set(df.columns))
    assert df.count() > 0


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
