"""Order-dependent functions on their path for large tables, which lower limits bring on."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loomframe import registry
from loomframe.frame import Frame
from loomframe.operators import ordered
from test_contract import DATA, normal, pytestmark  # noqa: F401

#: Registered queries that number rows, carry running values or look at bounded frames.
QUERIES = [
    n for n in registry.QUERIES
    if re.match(r"win_(0[1-9]|1[012345])|proj_(16|20_reset|21_iloc|23)|sort_04|join_(08|14|15)|udf_04|viz_07|agg_(26_spearman|32|33|34)", n) and n not in ("win_08_rolling_std",)
]


def rows_of(df):
    names = sorted(df.columns)
    return normal([tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()])


@pytest.mark.parametrize("name", QUERIES)
def test_large_path_gives_the_same(spark, monkeypatch, name):
    want = rows_of(registry.QUERIES[name](spark, DATA))
    monkeypatch.setattr(ordered, "SINGLE", 97)
    monkeypatch.setattr(ordered, "BLOCK", 64)
    assert rows_of(registry.QUERIES[name](spark, DATA)) == want


@pytest.mark.parametrize("kind", ["prefix", "ties", "missing", "two"])
def test_numbers_are_those_of_the_order(spark, kind):
    rng = random.Random(4)
    rows = [(i, f"a common prefix {rng.randrange(500):05}", rng.choice([1, 1, 1, 1, 2]), rng.choice([None, float("nan"), 1.5, -2.0])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, text string, tie int, x double").repartition(5)
    order = {"prefix": ["text", "id"], "ties": ["tie"], "missing": ["x", "id"], "two": ["tie", "text"]}[kind]
    got = ordered.numbered(df, order, "n", 200).collect()
    assert sorted(r["n"] for r in got) == list(range(3000))
    one = lambda v: (v is None, v != v, 0 if v is None or v != v else v)
    key = lambda r: tuple(one(r[c]) if c == "x" else r[c] for c in order)
    in_order = sorted(got, key=lambda r: r["n"])
    missing_last = lambda r: tuple((r[c] is None, 0 if r[c] is None else (1, 0) if r[c] != r[c] else (0, r[c])) for c in order)
    keys = [missing_last(r) if kind == "missing" else key(r) for r in in_order]
    assert keys == sorted(keys)


def test_every_running_function_over_ties(spark):
    df = spark.range(2000).select(F.col("id"), (F.col("id") % 3).alias("tie"), F.when(F.col("id") % 7 != 0, F.col("id") * 1.0).alias("x"))
    wanted = {fn: (fn, F.col("x")) for fn in ordered.RUNNING if fn != "product"}
    small = ordered.running(df, ["tie", "id"], [], wanted)
    large = ordered.running(df, ["tie", "id"], [], wanted, 150, 64)
    assert rows_of(small) == rows_of(large)


def test_frames_longer_than_a_block(spark):
    df = Frame(spark.range(1500).select("id", (F.col("id") * 7 % 13).cast("double").alias("x")), "id")
    make = lambda w: {"s": F.sum("x").over(w.rowsBetween(-100, 5)), "l": F.lag("x", 80).over(w)}
    small = ordered.windowed(df.df, ["id"], [], 100, 5, make)
    large = ordered.windowed(df.df, ["id"], [], 100, 5, make, 150, 64)
    assert rows_of(small) == rows_of(large)


@pytest.mark.parametrize("fn", ["mean", "var", "std"])
def test_weighted_means_by_runs(spark, monkeypatch, fn):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, float("nan"), rng.random()]) if i > 90 else None, i * 2, i % 3, 1.0) for i in range(700)]
    f = Frame(spark.createDataFrame(rows, "id long, x double, run int, key_ int, mean double"), "id")
    want = getattr(f.ewm("x", 0.3), fn)("w")
    monkeypatch.setattr(ordered, "SINGLE", 100)
    monkeypatch.setattr(ordered, "BLOCK", 32)
    got = getattr(f.ewm("x", 0.3), fn)("w")
    assert got.df.columns == want.df.columns
    assert rows_of(got.df.withColumn("w", F.round("w", 9))) == rows_of(want.df.withColumn("w", F.round("w", 9)))


def test_rows_that_repeat_with_the_same_order(spark):
    f = Frame(spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, None), (3, None), (4, "b")], "k int, s string"), "k")
    flags = lambda keep: sorted((r["k"], r["s"] or "", r["d"]) for r in f.duplicated("s", keep, "d").df.collect())
    assert flags("first") == [(1, "a", False), (1, "a", True), (2, "", False), (2, "a", True), (3, "", True), (4, "b", False)]
    assert flags("last") == [(1, "a", True), (1, "a", True), (2, "", True), (2, "a", False), (3, "", False), (4, "b", False)]
    assert [r[2] for r in flags("none")] == [True, True, True, True, True, False]
    assert f.drop_duplicates("s", "none").df.collect() == [(4, "b")]


@pytest.mark.parametrize("limits", [(), (150, 64)])
def test_what_follows_is_looked_at_once(spark, limits):
    """No frame ends with the last row, as such a one takes the square of its rows; missing order keys come last."""
    rows = [(i, None if i % 9 == 0 else float("nan") if i % 9 == 1 else float(-(i // 3)), float(i) if i % 4 == 0 else None) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, o double, x double").repartition(3)
    out = ordered.running(df, ["o", "id"], [], {"n": ("next", F.col("x"))}, *limits)
    assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()
    want, held = {}, None
    for i, o, x in sorted(rows, key=lambda r: (r[1] is None, r[1] is not None and r[1] != r[1], r[1] if r[1] == r[1] and r[1] is not None else 0, r[0]), reverse=True):
        held = held if x is None else x
        want[i] = held
    assert {r["id"]: r["n"] for r in out.collect()} == want


def test_interpolation_looks_ahead_once(spark, monkeypatch):
    f = Frame(spark.range(600).select("id", (F.col("id") % 3).alias("k"), F.when(F.col("id") % 5 == 0, F.col("id") * 2.0).alias("x")), "id")
    for partition in ([], ["k"]):
        out = f.interpolate("x", partition_by=partition)
        assert "unboundedfollowing" not in out.df._jdf.queryExecution().toString().lower()
    assert {r["x"] - 2 * r["id"] for r in f.interpolate("x").df.where("id <= 595").collect()} == {0.0}


@pytest.mark.parametrize("single", [1 << 20, 100])
def test_as_of_ties_go_to_the_last_of_the_right_order(spark, monkeypatch, single):
    """SQL's ASOF leaves open which of several rows with the same time it takes; merge_asof does not."""
    monkeypatch.setattr(ordered, "SINGLE", single)
    monkeypatch.setattr(ordered, "BLOCK", 64)
    left = Frame(spark.range(300).select("id", F.col("id").alias("t")), "id")
    right = Frame(spark.range(900).repartition(4).select((F.col("id") % 100 * 3).alias("t"), F.col("id").alias("k")), "k")
    got = left.merge_asof(right, on="t").df.collect()
    assert {r["id"]: r["k"] for r in got} == {i: 800 + i // 3 for i in range(300)}
