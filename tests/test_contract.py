"""The driver contract: every registered query with SQL agrees with DuckDB on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry_module
from loomframe import registry

DATA = os.environ.get("LOOMFRAME_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def normal(rows):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return (0, "")
        if isinstance(v, bool):
            return (1, str(v))
        if isinstance(v, (int, float)):
            return (2, f"{v:.6g}")
        return (3, str(v))

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_duckdb(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = [tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()]
    result = duck.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == names
    assert normal(got) == normal([tuple(r[columns.index(n)] for n in names) for r in result.fetchall()])


def test_queries_without_sql_run(spark):
    for name in sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)):
        assert registry.QUERIES[name](spark, DATA).count() >= 0


def test_entry(spark):
    out = entry_module.entry(spark)
    assert out.columns and out.count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
