"""Every registered query with SQL gives DuckDB's rows."""

import glob
import os

import duckdb
import pytest
from folioscope.plans.registry import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def shown(value):
    return repr(round(value, 6) + 0.0) if isinstance(value, float) else repr(value)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ("weights_custom", "rank_lexical_best")])
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert got and got == sorted(tuple(shown(r[i]) for i in places) for r in result.fetchall())
    spark.catalog.clearCache()
