"""Every query with SQL to check it: same columns, types and rows in Spark and DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry_module

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
}


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()))
def test_same_as_sql(spark, duck, sf_dir, name):
    df = entry_module.queries()[name](spark, sf_dir)
    answer = duck.execute(entry_module.oracle_sql()[name])
    names = [c[0] for c in answer.description]
    types = dict(zip(names, (str(c[1]) for c in answer.description)))
    assert sorted(df.columns) == sorted(names)
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema.fields} == types
    expected = [tuple(row[names.index(c)] for c in df.columns) for row in answer.fetchall()]
    assert _sorted(df.collect()) == _sorted(expected)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
