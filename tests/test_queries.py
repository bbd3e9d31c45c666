"""Every named query with an SQL counterpart, beside an independent engine."""

import duckdb
import pytest

from check_queries import TABLES, canonical
from hourloom.catalog import ORACLE, QUERIES


@pytest.fixture(scope="module")
def db(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def test_every_counterpart_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_counterpart(spark, folder, db, name):
    mine = canonical(QUERIES[name](spark, folder).toPandas())
    theirs = canonical(db.sql(ORACLE[name]).df())
    assert mine[0] == theirs[0]
    assert mine[1] == theirs[1]
