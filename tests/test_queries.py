"""Every registered query outside the corpus operators against its DuckDB SQL, on the smallest data."""

import math
import os

import duckdb
import pytest

from verisift import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    rows = df.collect()
    sql = queries.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = duck.sql(sql)
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert sorted("|".join(shown(r[c]) for c in cols) for r in rows) == sorted("|".join(shown(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["claim_id", "status", "overall", "needs_human_review"] and df.count() > 0
