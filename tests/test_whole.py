"""Queries over whole tables, beside those whose SQL takes a part."""

from pyspark.sql import functions as F

from loomframe import registry
from test_contract import DATA, pytestmark  # noqa: F401


def test_whole_tables(spark):
    count = lambda name: spark.read.parquet(f"{DATA}/{name}.parquet").count()
    for name, table in (("src_09_json_normalize", "events"), ("rsh_02_pivot", "nation"), ("sql_01_select_list", "orders")):
        assert registry.QUERIES[f"{name}_whole"](spark, DATA).count() == count(table)


def test_whole_sort_and_vectors(spark):
    rows = registry.QUERIES["sort_01_sort_by_whole"](spark, DATA).collect()
    key = lambda r: (r["e"] is None, [-ord(c) for c in r["e"] or ""] + [0], r["v"] is None, r["v"] or 0, r["event_id"])
    assert len(rows) == spark.read.parquet(f"{DATA}/events.parquet").count() > 500 and rows == sorted(rows, key=key)
    elements = spark.read.parquet(f"{DATA}/embeddings.parquet").agg(F.sum(F.size("embedding"))).first()[0]
    assert registry.QUERIES["rsh_06_explode_whole"](spark, DATA).count() == elements
