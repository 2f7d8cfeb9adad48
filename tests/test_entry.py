"""Every query of the library gives the rows of its SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def canonical(frame):
    columns = sorted(frame.columns)
    plain = frame[columns].astype(object)
    return columns, sorted(map(repr, plain.where(plain.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    assert canonical(got) == canonical(duck.sql(entry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - {"pipeline"}))
def test_other_queries_run(spark, name):
    entry.queries()[name](spark, FOLDER).write.format("noop").mode("overwrite").save()


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
