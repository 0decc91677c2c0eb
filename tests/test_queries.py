"""Every registered query with SQL, beside that SQL, on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from check import rows_of
from queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
NAMES = list(ORACLES)


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    cursor = db.execute(ORACLES[name])
    names = [column[0] for column in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cursor.fetchall())


def test_every_query_has_a_name_of_its_own():
    assert set(ORACLES) <= set(QUERIES)
