"""Every registered packet query against its SQL."""

import os
from glob import glob

import duckdb
import pytest

from netloom.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def plain(value):
    return tuple(map(plain, value)) if isinstance(value, list) else value


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    query, sql = QUERIES[name]
    found = query(spark, SF)
    columns = sorted(found.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert got == want
