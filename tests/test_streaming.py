"""Streams over a folder of files, run to their end."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomframe.streaming import windows as S

SCHEMA = "id long, ts timestamp, user long, v double"


@pytest.fixture()
def folder(spark, tmp_path):
    t0 = dt.datetime(2026, 1, 1)
    rows = [(i, t0 + dt.timedelta(minutes=7 * i), i % 3, float(i)) for i in range(40)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    return str(tmp_path)


def stream(spark, folder):
    return S.event_stream(spark, f"{folder}/in", "*.parquet", spark.read.parquet(f"{folder}/in").schema)


def test_tumbling(spark, folder):
    made = S.windowed(stream(spark, folder), "ts", "1 hour", None, ["user"], "10 minutes", n=F.count("*"))
    out = S.run_to_batches(made, f"{folder}/out", f"{folder}/state")
    assert out.agg(F.sum("n")).first()[0] == 40


def test_sessions_and_late_rows(spark, folder):
    made = S.sessions(stream(spark, folder), "ts", "15 minutes", ["user"], "0 minutes", n=F.count("*"))
    out = S.run_available(made, f"{folder}/out2", f"{folder}/state2")
    assert out.count() >= 1 and out.agg(F.max("n")).first()[0] == 1


def test_deduplication_and_state(spark, folder):
    out = S.run_available(S.deduplicated(stream(spark, folder), "ts", ["user"], "1 day"), f"{folder}/out3", f"{folder}/state3")
    assert out.count() == 3
    totals = S.running_totals(stream(spark, folder), "user", "v")
    out = S.run_to_batches(totals, f"{folder}/out4", f"{folder}/state4", mode="update")
    assert {r["user"]: r["total"] for r in out.collect()} == {u: float(sum(range(u, 40, 3))) for u in range(3)}
