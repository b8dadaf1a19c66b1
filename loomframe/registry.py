"""Queries over the test tables, one or more for each operator family, and their oracle SQL.

A query gets a Tables helper and returns a Frame or DataFrame; doubles that come from sums are
rounded on both sides, as neither engine fixes the order of additions.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.frame import Frame

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Orders that make rows unique.
ORDERS = {"orders": "o_orderkey", "events": "event_id", "customer": "c_custkey", "part": "p_partkey", "supplier": "s_suppkey",
          "nation": "n_nationkey", "region": "r_regionkey", "embeddings": "vec_id", "pages": "page_id", "documents": "doc_id"}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> Frame:
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        if name == "lineitem":
            return Frame(df, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
        return Frame(df, ORDERS.get(name, ()))


def query(name: str, sql: str | None = None, digits: int = 4):
    """Registers a query; its double columns are rounded to digits."""

    def add(fn: Callable[[Tables], Frame | DataFrame]):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(Tables(spark, sf_dir))
            df = out.df if isinstance(out, Frame) else out
            df = df.drop("__pos__", "__first__", "__at__")
            return df.withColumns({n: F.round(f"`{n}`", digits) for n, k in df.dtypes if k == "double"}) if any(k == "double" for _, k in df.dtypes) else df

        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return add


from loomframe import catalog, catalog_more  # noqa: E402, F401  registers the queries
