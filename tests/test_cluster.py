"""Queries on executors that are processes of their own and share the scratch folder only."""

import json
import os
import subprocess
import sys

import pytest

from loomframe import registry
from test_contract import DATA, duck, normal, pytestmark  # noqa: F401

QUERIES = ["rel_01_transactions", "rel_04_sql_builder", "src_27_jdbc_query", "src_28_jdbc_table", "src_29_jdbc_write"]

#: TMPDIR is relative to the process, so that the driver's temporary files mean nothing to executors.
RUN = """
import json, sys
from pyspark.sql import SparkSession
import __spark_entry__ as entry
data, scratch, *names = sys.argv[1:]
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "700m", "spark.checkpoint.dir": f"file://{scratch}", "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": "2", "spark.driver.host": "127.0.0.1"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
out = {}
for n in names:
    df = entry.queries()[n](spark, data)
    columns = sorted(df.columns)
    out[n] = [columns, [list(r) for r in df.select(*columns).collect()]]
print("GOT", json.dumps(out))
spark.stop()
"""


@pytest.fixture(scope="module")
def got(tmp_path_factory):
    import pyspark

    own = tmp_path_factory.mktemp("cluster")
    for d in ("home/work", "scratch", "tmp"):
        (own / d).mkdir(parents=True)
    home = os.path.dirname(pyspark.__file__)
    for n in set(os.listdir(home)) - {"work"}:  # executors work in Spark's home
        (own / "home" / n).symlink_to(f"{home}/{n}")
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK_", "PYSPARK_"))}
    env |= {"SPARK_HOME": f"{own}/home", "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable, "PYTHONPATH": repo, "TMPDIR": "/proc/self/cwd/tmp"}
    ran = subprocess.run([sys.executable, "-c", RUN, DATA, f"{own}/scratch", *QUERIES], cwd=own, env=env, capture_output=True, text=True, timeout=300)
    said = [line for line in ran.stdout.splitlines() if line.startswith("GOT ")]
    assert said, ran.stderr[:3000]
    return json.loads(said[0][4:])


@pytest.mark.parametrize("name", QUERIES)
def test_on_a_cluster(got, duck, name):  # noqa: F811
    columns, rows = got[name]
    result = duck.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    assert normal(rows) == normal([tuple(r[names.index(n)] for n in columns) for r in result.fetchall()])


def test_what_passes_through_the_driver(spark, tmp_path, monkeypatch):
    """Kinds, missing values and pieces of few rows, as without the detour."""
    from loomframe.frame import Frame
    from loomframe.sources import jdbc

    df = spark.range(1300).repartition(3).selectExpr(
        "id", "if(id % 5 = 0, null, id / 7) AS x", "if(id % 3 = 0, null, concat('ä', id)) AS s", "id % 2 = 0 AS b",
        "date_add(DATE '2020-02-28', int(id)) AS d", "timestamp_ntz '2020-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) AS t", "cast(id AS decimal(9, 2)) AS n", "cast('z' AS binary) AS y",
    )
    all_rows = lambda f: sorted(map(tuple, f.df.collect()))
    read = lambda e: (all_rows(jdbc.read_table(spark, e, "t", '"id"', 2)), all_rows(jdbc.read_query(spark, e, 'SELECT "s", "t" FROM t WHERE "id" = ?', 1)), jdbc.read_table(spark, e, "bare"))
    engines = [jdbc.Engine("derby", path=f"{tmp_path}/{k}") for k in "ab"]
    got = []
    for e in engines:
        jdbc.write_table(Frame(df), e, "t")
        jdbc.write_table(Frame(df.limit(2)), e, "t", "append", batch=1)
        jdbc.write_table(Frame(df.limit(0)), e, "bare")
        got.append(read(e))
        monkeypatch.setattr(jdbc, "one_process", lambda _: False)
        monkeypatch.setattr(jdbc, "PIECE", 200_000)
        monkeypatch.setattr(jdbc, "FETCH", 60)
    assert got[0][:2] == got[1][:2] and len(got[1][0]) == 1302
    assert got[0][2].df.dtypes == got[1][2].df.dtypes and got[1][2].df.isEmpty()
