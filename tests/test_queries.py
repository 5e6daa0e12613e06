"""Every query with SQL gives the rows of its SQL on the smallest tables."""

import os
import re

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = [n for n in __spark_entry__.queries() if not re.match(r"op\d+_|pipeline$", n)]
NAMES = [n for n in OWN if n in __spark_entry__.oracle_sql()]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    want = duck.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in df.columns]
    assert sorted((plain(tuple(r)) for r in df.collect()), key=repr) == sorted((plain(tuple(r[k] for k in at)) for r in want.fetchall()), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_queries_without_sql_run(spark):
    for name in sorted(set(OWN) - set(NAMES)):
        assert __spark_entry__.queries()[name](spark, SF).count() > 0, name
    assert __spark_entry__.entry(spark).count() > 0
