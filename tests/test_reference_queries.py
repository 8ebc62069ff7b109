"""Each registered query against its oracle in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from vellum.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations lineitem".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(v):
    return f"{v:.8g}" if isinstance(v, float) else str(list(v)) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_oracle(spark, duck, name):
    frame = registry.queries()[name](spark, DIR)
    found = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(frame.columns)
    order = sorted(names)
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in order) for r in frame.collect()) == theirs


def test_every_query_has_an_oracle():
    assert set(registry.queries()) == set(registry.oracle_sql())
