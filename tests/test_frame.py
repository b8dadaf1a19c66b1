"""Golden cases with results worked out by hand, comparisons with pandas, and relations that must hold."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loomframe import Frame, concat, frame
from loomframe.frame import OrderError
from loomframe.functions.frequency import Frequency, infer
from loomframe.functions.values import FrameError
from loomframe.operators import ordered

NAN = float("nan")


def make(spark, **columns):
    return frame(columns, spark=spark)


def column(f, name):
    return f.to_list(name)


def test_sales_by_category(spark):
    f = make(spark, store=list("aabbccab"), category=["food", "toy"] * 4, amount=[100, 50, 200, 20, 150, 30, 250, 60])
    top = f.group_by("category").agg("amount", "sum").df.orderBy("amount_sum", ascending=False).first()
    assert tuple(top) == ("food", 700.0)


def test_reconcile_by_outer_merge(spark):
    bank = make(spark, txn=["T1", "T2", "T3", "T4"], amount=[100, 200, 300, 400]).drop("__pos__")
    corp = make(spark, txn=["T1", "T2", "T3", "T5"], amount=[100, 200, 350, 500]).drop("__pos__")
    both = bank.merge(corp, "outer", on="txn")
    assert both.df.columns == ["txn", "amount_x", "amount_y"]
    odd = both.query("amount_x is null || amount_y is null || amount_x != amount_y")
    assert sorted(r[0] for r in odd.df.collect()) == ["T3", "T4", "T5"]


def test_fx_as_of(spark):
    rates = make(spark, date=[1, 3, 6], rate=[7.1, 7.2, 7.3]).drop("__pos__").ordered_by("date")
    tx = make(spark, date=[1, 3, 6, 7, 5, 0], usd=[100, 200, 10, 20, 30, 40])
    got = {r["date"]: r["rate"] for r in tx.merge_asof(rates, on="date").df.collect()}
    assert got == {1: 7.1, 3: 7.2, 6: 7.3, 7: 7.3, 5: 7.2, 0: None}
    with pytest.raises(FrameError):
        tx.merge_asof(tx.rename_columns({"usd": "usd"}), on="date")


def test_resample_starts_at_the_first_time_and_keeps_empty_bins(spark):
    t0 = dt.datetime(2026, 1, 1, 10, 5)
    times = [t0, t0 + dt.timedelta(minutes=30), t0 + dt.timedelta(hours=1), t0 + dt.timedelta(hours=3)]
    f = Frame(spark.createDataFrame(list(zip(times, [100, 200, 200, 250], strict=True)), "ts timestamp_ntz, ms long"), "ts")
    out = f.resample("ts", "1h").mean("ms")
    assert column(out, "ms_mean") == [150.0, 200.0, None, 250.0]
    assert column(out, "_bucket_")[0] == t0
    assert column(f.resample("ts", "1h").agg({"ms": "sum"}), "sum_ms") == [300, 200, None, 250]
    assert f.resample("ts", "1h").ohlc("ms").df.columns == ["_bucket_", "ms_open", "ms_high", "ms_low", "ms_close"]


def test_month_steps():
    step = Frequency.parse("1M")
    assert step.range(dt.datetime(2024, 1, 31), 3) == [dt.datetime(2024, 1, 31), dt.datetime(2024, 2, 29), dt.datetime(2024, 3, 29)]
    assert Frequency.parse("1ME").plus(dt.datetime(2026, 2, 28)) == dt.datetime(2026, 3, 31)
    assert Frequency.parse("1ME").align_start(dt.datetime(2026, 1, 15, 8)) == dt.datetime(2025, 12, 31)
    assert Frequency.parse("ms").align_start(dt.datetime(2026, 1, 15, 8)) == dt.datetime(2026, 1, 1)
    assert Frequency.parse("2D").steps_between(dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 8)) == 3
    assert infer([dt.datetime(2026, 1, d) for d in (1, 3, 5)]) == "2D"
    with pytest.raises(FrameError):
        Frequency.parse("0D")


def test_month_grid_follows_the_drift(spark):
    days = [dt.datetime(2024, 1, 31), dt.datetime(2024, 2, 29), dt.datetime(2024, 3, 28), dt.datetime(2024, 3, 29)]
    f = Frame(spark.createDataFrame([(d, 1) for d in days], "ts timestamp_ntz, v long"), "ts")
    assert column(f.resample("ts", "1M").sum("v"), "v_sum") == [1, 2, 1]


def test_running_functions_pass_missing_values_over(spark):
    f = make(spark, v=[1.0, None, 3.0, NAN, 2.0])
    assert column(f.col_cumsum("v"), "v_cumsum") == [1, None, 4, None, 6]
    assert column(f.col_cummax("v"), "v_cummax") == [1, None, 3, None, 3]
    assert column(f.col_diff("v"), "v_diff") == [None, None, None, None, None]
    assert column(f.ffill("v"), "v") == [1, 1, 3, 3, 2]
    assert column(f.bfill("v"), "v") == [1, 3, 3, 2, 2]
    assert column(f.interpolate("v"), "v") == [1, 2, 3, 2.5, 2]
    assert column(f.rolling("v", 2, 1).sum("r"), "r") == [1, 1, 3, 3, 2]
    assert column(f.expanding("v").mean("e"), "e") == [1, 1, 2, 2, 2]


def test_ewm(spark):
    f = make(spark, v=[1.0, 2.0, None, 3.0])
    assert column(f.ewm("v", 0.5).mean("m"), "m") == [1, 1.5, 1.5, 2.25]
    var = column(make(spark, v=[1.0, 2.0, 3.0]).ewm("v", 0.5).var("x"), "x")
    assert var[0] is None and var[1] == pytest.approx(1 / 6) and var[2] == pytest.approx(0.392857142)


def test_order_is_asked_for(spark):
    with pytest.raises(OrderError):
        Frame(spark.range(3)).col_cumsum("id")
    with pytest.raises(FrameError):
        Frame(spark.range(3)).group_by("id").agg("id", "first")


def test_duplicates(spark):
    f = make(spark, k=["a", "b", "a", "c", "b"], v=[1, 2, 3, 4, 5])
    assert sorted(column(f.drop_duplicates("k"), "v")) == [1, 2, 4]
    assert sorted(column(f.drop_duplicates("k", "last"), "v")) == [3, 4, 5]
    assert column(f.drop_duplicates("k", "none"), "v") == [4]
    assert column(f.duplicated("k"), "duplicated") == [False, False, True, False, True]


def test_statistics_agree_with_pandas(spark):
    rng = np.random.default_rng(3)
    p = pd.DataFrame({"a": rng.normal(size=60), "b": rng.integers(0, 9, 60).astype(float)})
    p.loc[::7, "a"] = np.nan
    f = frame(p, spark=spark)
    assert f.col_skew("a") == pytest.approx(p.a.skew()) and f.col_kurt("a") == pytest.approx(p.a.kurt())
    assert f.col_sem("a") == pytest.approx(p.a.sem()) and f.col_median("b") == p.b.median()
    assert f.col_quantile("a", 0.3) == pytest.approx(p.a.quantile(0.3))
    assert f.col_corr("a", "b") == pytest.approx(p.a.corr(p.b)) and f.col_cov("a", "b") == pytest.approx(p.a.cov(p.b))
    assert f.col_corr("a", "b", "spearman") == pytest.approx(p[["a", "b"]].dropna().corr("spearman").iloc[0, 1])
    assert f.col_mad("a") == pytest.approx((p.a - p.a.mean()).abs().mean())
    for method in ("average", "min", "max", "first", "dense"):
        got = column(f.col_rank("b", method, "r"), "r")
        assert got == p.b.rank(method=method).tolist()
    assert f.col_prod("b") == pytest.approx(p.b.prod()) and f.col_nunique("b") == p.b.nunique()
    assert f.idxmax("a") == int(p.a.idxmax()) and f.idxmin("a") == int(p.a.idxmin())
    d = f.describe(["a"]).df.collect()
    assert {r["stat"]: pytest.approx(r["a"]) for r in d} == p.a.describe().to_dict()


def test_constant_columns_do_not_raise(spark):
    f = make(spark, a=[1.0, 1.0, 1.0], b=[1.0, 2.0, 3.0])
    assert f.col_corr("a", "b") is None and f.col_skew("a") is None


def test_reshape(spark):
    f = make(spark, name=["x", "x", "y", "y"], subject=["m", "e", "m", "e"], score=[70, 80, 85, 75])
    wide = f.pivot_table("name", "subject", "score", "sum")
    assert wide.df.columns[:3] == ["name", "m", "e"]
    long = wide.melt(["name"], ["m", "e"])
    assert long.row_count() == 4 and {r["value"] for r in long.df.collect()} == {70, 80, 85, 75}
    with pytest.raises(FrameError):
        concat(f, f).pivot("name", "subject", "score")
    t = make(spark, a=[1, 2], b=[3, 4]).drop("__pos__")
    assert sorted(map(tuple, t.ordered_by("a").transpose().df.select("_index", "0", "1").collect())) == [("a", 1, 2), ("b", 3, 4)]
    e = make(spark, k=[1, 2], tags=[["p", "q"], ["r"]]).explode("tags")
    assert sorted(column(e, "tags")) == ["p", "q", "r"]


def test_missing(spark):
    f = make(spark, a=[1.0, NAN, None], s=["x", None, "z"])
    assert [tuple(r)[:2] for r in f.isna().df.select("a", "s").collect()].count((True, True)) == 1
    assert f.dropna(subset=["a", "s"]).row_count() == 1 and f.dropna("all", ["a", "s"]).row_count() == 2
    assert column(f.fillna({"a": 0.0}), "a") == [1, 0, 0]
    with pytest.raises(FrameError):
        f.fillna({"a": "x"})


def test_positions(spark):
    f = make(spark, v=list(range(10)))
    assert column(f.head(3), "v") == [0, 1, 2] and column(f.head(-8), "v") == [0, 1]
    assert column(f.tail(2), "v") == [8, 9] and column(f.slice(-3, -1), "v") == [7, 8]
    assert column(f.iloc(4, 0), "v") == [4, 0] and f.get(3, "v") == 3
    assert f.sample(4, seed=1).row_count() == 4 and f.sample(40, replace=True, seed=1).row_count() == 40
    assert column(f.filter([i % 2 == 0 for i in range(10)]), "v") == [0, 2, 4, 6, 8]
    assert f.setIndex("v").resetIndex("k").df.columns[-1] == "k"


def test_groups(spark):
    f = make(spark, k=["b", "a", None, "b", None], v=[1, 2, 3, 4, 5], ok=[True, False, True, True, None], s=["p", "q", "r", None, "t"])
    out = f.group_by("k").agg({"v": ["sum", "mean", "first", "last"], "ok": "sum", "s": "sum"}, ordered=True)
    assert [tuple(r)[:1] for r in out.iter_rows()] == [("b",), ("a",), (None,)]
    rows = {r["k"]: r for r in out.df.collect()}
    assert rows["b"]["v_sum"] == 5.0 and rows[None]["v_mean"] == 4.0 and rows["b"]["ok_sum"] == 2
    assert rows["b"]["s_sum"] == "p" and rows[None]["s_sum"] == "rt" and rows[None]["v_last"] == 5
    assert sorted(column(f.group_by("k").filter("v", "sum", lambda c: c > 4), "v")) == [1, 3, 4, 5]
    assert sorted(column(f.group_by("k").transform("v", "max", "m"), "m")) == [2, 4, 4, 5, 5]
    assert f.group_by("k").group_count() == 3 and len(list(f.group_by("k").iter_groups())) == 3


def test_floats_as_keys(spark):
    f = Frame(spark.createDataFrame([(0.0, 1), (-0.0, 2), (NAN, 3), (None, 4)], "k double, v int"))
    assert f.group_by("k").size().row_count() == 2
    assert f.merge(f, on="k").row_count() == 8


SMALL = {"single": 7, "block": 5}


@given(st.lists(st.one_of(st.none(), st.integers(-50, 50)), min_size=1, max_size=60), st.integers(1, 6))
@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_block_wise_plans_equal_plain_windows(spark, values, size):
    """Beyond the single-task bound, rows are dealt into runs: the same results as one window's."""
    rows = [(i * 3 % 61, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k long, v long")
    wanted = {n: (n, df.v.cast("double")) for n in ("sum", "count", "max", "min", "last", "next")}
    a = ordered.running(df, ["k"], [], wanted).orderBy("k").collect()
    b = ordered.running(df, ["k"], [], wanted, **SMALL).orderBy("k").collect()
    assert [r.asDict() for r in a] == [r.asDict() for r in b]
    from pyspark.sql import functions as F

    def make_columns(w):
        return {"lag": F.lag("v", size).over(w), "s": F.sum("v").over(w.rowsBetween(-size, 0)), "ahead": F.lead("v", 2).over(w)}

    a = ordered.windowed(df, ["k"], [], size, 2, make_columns).orderBy("k").collect()
    b = ordered.windowed(df, ["k"], [], size, 2, make_columns, **SMALL).orderBy("k").collect()
    assert [r.asDict() for r in a] == [r.asDict() for r in b]
    n = ordered.numbered(df, ["k"], "n", 7).orderBy("k").collect()
    assert [r["n"] for r in n] == list(range(len(rows)))


def test_numbers_by_text_keys(spark):
    rows = [(f"{c}{i:02d}",) for c in "zebra" for i in range(7)]
    df = spark.createDataFrame(rows, "k string").distinct()
    got = ordered.numbered(df, ["k"], "n", 6).orderBy("k").collect()
    assert [r["n"] for r in got] == list(range(len(got)))


@given(st.lists(st.tuples(st.integers(0, 5), st.one_of(st.none(), st.floats(-100, 100))), max_size=25))
@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_relations(spark, rows):
    f = frame([(i, v) for i, v in rows], schema="id long, v double", spark=spark)
    yes, no = f.query("v > 3"), f.query("not v > 3")
    assert yes.row_count() + no.row_count() == len(rows)
    p = pd.DataFrame(rows, columns=["id", "v"]).astype({"v": float})
    got = {r["id"]: r["v_sum"] for r in f.group_by("id").agg("v", "sum").df.collect()}
    want = p.groupby("id").v.sum().to_dict() if rows else {}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in got)
    assert f.merge(f, on="id").row_count() == sum(c * c for c in p.id.value_counts())


def test_set_operations(spark):
    a, b = make(spark, x=[1, 2, 2, None]).drop("__pos__"), make(spark, x=[2, None, 5]).drop("__pos__")
    as_set = lambda f: sorted((r[0] for r in f.df.collect()), key=str)
    assert as_set(a.intersect(b)) == [2, None] and as_set(a.subtract(b)) == [1]
    assert concat(a, make(spark, y=["q"]).drop("__pos__")).df.columns == ["x", "y"]
    assert concat(a, make(spark, x=["q"]).drop("__pos__")).dtypes()["x"] == "string"


def test_names_and_kinds(spark):
    f = make(spark, **{"a b": [1], "ключ": ["1"], "d.e": [2.7]}).drop("__pos__")
    assert f.select("d.e").df.first()[0] == 2.7 and f.astype("d.e", "long").df.first()[2] == 2
    assert f.astype("ключ", "bool").df.first()[1] is True and f.infer_objects().dtypes()["ключ"] == "int"
    with pytest.raises(FrameError):
        f.astype("a b", "category")
    with pytest.raises(FrameError):
        f.select("none")
    assert f.query("`a b` == 1 and ключ == '1'").row_count() == 1


def test_plot_data(spark):
    f = make(spark, v=[1.0, 2.0, 2.0, 5.0, None], g=list("aabbb"))
    h = f.plot.hist("v", 4)
    assert column(h, "count") == [1, 2, 0, 1]
    assert sum(r["density"] * (r["right"] - r["left"]) for r in f.plot.kde("v", 4).df.collect()) == pytest.approx(1)
    with pytest.raises(FrameError):
        f.plot.pie("g", "v")
    r = column(make(spark, v=[1.0, 2.0, 3.0]).plot.autocorrelation("v", 1), "r")
    assert r[0] == pytest.approx(1) and r[1] == pytest.approx(0)


def test_index_levels(spark):
    from loomframe.operators.index import Index

    f = make(spark, a=["x", "y", "x"], b=[1, 2, 1], t=[dt.datetime(2026, 1, d, 9) for d in (1, 2, 3)])
    ix = Index(f, "a", "b")
    assert ix.labels() == [("x", 1), ("y", 2), ("x", 1)] and sorted(ix.unique().labels()) == [("x", 1), ("y", 2)]
    assert ix.swaplevel().levels == ["b", "a"] and ix.droplevel("a").labels() == [1, 2, 1]
    assert ix.reorder_levels([1, 0]).level(0) == "b" and ix.take(2, 0).labels() == [("x", 1), ("x", 1)]
    assert ix.slice(1, 2).labels() == [("y", 2)] and Index(f, "t").infer_freq() == "1D"
    assert Index(f, "t").asof("2026-01-02 12:00:00") == dt.datetime(2026, 1, 2, 9)
    with pytest.raises(FrameError):
        ix.droplevel(0, 1)


def test_engines_and_sources(spark):
    from loomframe.functions import arrays
    from loomframe.plans import engines
    from loomframe.sources.codegen import columns_source

    f = make(spark, **{"class": [1, 2], "unitPrice": [3, 4]})
    assert engines.run("SELECT unitPrice FROM this WHERE unitPrice > 3", this=f).row_count() == 1
    engines.use_custom(engines.SparkSql())
    assert engines.run("SELECT sum(unitPrice) AS s FROM this", this=f).df.first()[0] == 7
    engines.reset()
    assert engines.capabilities()["CTE"] and "UNIT_PRICE = 'unitPrice'" in columns_source(f)
    m = arrays.Matrix([[2, 0], [0, 4]])
    assert m.solve([2, 4]) == [1, 1] and m.determinant() == pytest.approx(8) and m.inverse().mul(m).to_array() == [[1, 0], [0, 1]]
    with pytest.raises(FrameError):
        arrays.Matrix([[1, 1], [1, 1]]).inverse()
    got = f.df.agg(arrays.percentile(f.df.unitPrice, 50).alias("p"), arrays.statistic(f.df.unitPrice, "sum").alias("s")).first()
    assert tuple(got) == (3.5, 7.0)
