"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import os

import duckdb
import pytest

from assaylake.plans.catalogue import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def rows(frame):
    columns = sorted(frame.columns)
    plain = lambda v: None if v is None or v != v else int(v) if isinstance(v, float) and v == int(v) else v
    return sorted(str([plain(v) for v in r]) for r in frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DATA}/{file}'")
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), con.execute(ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
