"""Every query of the plans against its SQL on DuckDB, over whole tables of the smallest size."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

from quarry.plans import documents, more, queries, search, uploads  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else round(float(v), 5) + 0.0
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, database, name):
    out = queries.QUERIES[name](spark, SF)
    want = database.sql(queries.SQL[name])
    columns = sorted(out.columns)
    assert columns == sorted(want.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in out.collect()), key=repr)
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["query_id", "document_id", "score", "rank"]
    assert set(queries.QUERIES) <= set(__spark_entry__.queries()) and set(queries.SQL) <= set(__spark_entry__.oracle_sql())


def test_pairs_of_titles_and_questions_stay_where_they_are(spark):
    plan = queries.QUERIES["title_boost"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" not in plan and "hashpartitioning(document_id" in plan
