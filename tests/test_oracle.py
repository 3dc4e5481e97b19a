"""Every registered core query with SQL against DuckDB on the smallest tables."""

import datetime
import glob
import math
import os

import duckdb
import pytest

from riftlens import queries as core


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.isoformat() if isinstance(v, datetime.datetime) else v


def compare(spark, d, name, query, sql):
    con = duckdb.connect()
    for p in glob.glob(d + "/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = query(spark, d)
    cols = sorted(df.columns)
    mine = sorted((tuple(norm(x) for x in r) for r in df.select(*cols).collect()), key=repr)
    got = con.execute(sql)
    at = [x[0] for x in got.description]
    theirs = sorted((tuple(norm(r[at.index(c)]) for c in cols) for r in got.fetchall()), key=repr)
    assert mine == theirs, name


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_equals_sql(spark, small, name):
    compare(spark, small, name, core.queries()[name], core.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_query_does_not_depend_on_the_partitioning(spark, small, name):
    rows = lambda: sorted((tuple(map(str, r)) for r in core.queries()[name](spark, small).collect()), key=repr)
    got = rows()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert rows() == got
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_entry(spark, small):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(core.queries()) <= set(__spark_entry__.queries())
