"""More registered queries: sources and sinks, accessors, rules of the expression language and of SQL,
databases. What an accessor gives the driver comes back as a frame of its values."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import functions as F

from loomframe.catalog import _NULLS, with_nulls
from loomframe.frame import Frame, date_range, frame
from loomframe.functions import arrays as A
from loomframe.functions.frequency import Frequency
from loomframe.functions.scratch import scratch
from loomframe.functions.values import FrameError
from loomframe.operators import stats
from loomframe.operators.index import Index
from loomframe.plans import engines
from loomframe.plans.sql import sql as run_sql
from loomframe.registry import Tables, query
from loomframe.sources import dispatch, excel, files, jdbc, jsons, render
from loomframe.sources.codegen import columns_source

C = F.col


def told(t: Tables, schema: str, *rows: tuple):
    """Values that the driver has, as a frame."""
    return t.spark.createDataFrame(list(rows), schema)


def error_of(fn) -> str:
    """The name of the error that fn raises."""
    try:
        fn()
    except FrameError as e:
        return type(e).__name__
    return ""


# ---------------------------------------------------------------- sources and sinks


def _written(t: Tables, table: str, suffix: str, **options) -> str:
    path = f"{scratch(t.spark, 'io')}.{suffix}"
    dispatch.write(getattr(t, table), path, **options)
    return path


query("src_01_read_by_extension", "SELECT * FROM orders")(lambda t: dispatch.read(t.spark, f"{t.dir}/orders.parquet"))
query("src_02_write_by_extension", "SELECT * FROM customer")(lambda t: t.spark.read.parquet(_written(t, "customer", "parquet")))


@query("src_04_csv_write", "SELECT n_nationkey, '''=' || n_name AS formula, n_regionkey FROM nation")
def _(t):
    """Text that a spreadsheet would run is written with a quote in front."""
    path = scratch(t.spark, "io") + ".csv"
    files.write_csv(Frame(t.nation.df.select("n_nationkey", F.concat(F.lit("="), "n_name").alias("formula"), "n_regionkey")), path)
    return t.spark.read.option("header", True).schema("n_nationkey int, formula string, n_regionkey int").csv(path)


@query("src_06_fixed_width", "SELECT c_custkey::INTEGER AS k, c_name AS name, c_mktsegment AS segment FROM customer")
def _(t):
    path = scratch(t.spark, "io")
    t.customer.df.select(F.concat(F.lpad(C("c_custkey").cast("string"), 12, " "), F.rpad("c_name", 30, " "), F.rpad("c_mktsegment", 12, " "))).write.text(path)
    return files.read_fwf(t.spark, path, [12, 30, 12], ["k", "name", "segment"])


query("src_08_json_write", "SELECT * FROM supplier")(lambda t: t.spark.read.schema(t.supplier.df.schema).json(_written(t, "supplier", "json")))


@query("src_08_json_write_index", "SELECT r_regionkey::BIGINT AS \"index\", r_name FROM region")
def _(t):
    path = scratch(t.spark, "io") + ".json"
    jsons.write_json(t.region, path, "index", index="r_regionkey")
    return jsons.read_json(t.spark, path, "index")


def _workbook(t: Tables) -> str:
    path = scratch(t.spark, "io") + ".xlsx"
    with excel.ExcelWriter(t.spark, path) as book:
        book.write(t.nation, "nations").write(t.region, "regions")
    return path


query("src_11_excel_sheet_names", "SELECT * FROM (VALUES (0::BIGINT, 'nations'), (1::BIGINT, 'regions')) s(place, name)")(
    lambda t: told(t, "place long, name string", *enumerate(excel.sheet_names(t.spark, _workbook(t))))
)
query("src_12_excel_write", "SELECT r_regionkey, r_name FROM region")(lambda t: excel.read_excel(t.spark, _workbook(t), "regions"))
query("src_14_html_write", "SELECT count(*) AS n, '<td>' || min(s_name) || '</td>' AS first FROM supplier")(
    lambda t: t.spark.read.text(_written(t, "supplier", "html")).where(C("value").contains("<td>")).agg(
        F.count("*").alias("n"), F.min(F.regexp_extract("value", "<td>[^<]*</td>(<td>[^<]*</td>)", 1)).alias("first")
    )
)
query("src_16_xml_write", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")(
    lambda t: t.spark.read.option("rowTag", "row").schema(t.supplier.df.schema).xml(_written(t, "supplier", "xml"))
)
query("src_18_parquet_write", "SELECT * FROM orders")(lambda t: t.spark.read.parquet(_written(t, "orders", "parquet", partition_by=["o_orderstatus"])))
query("src_20_orc_write", "SELECT * FROM orders")(lambda t: t.spark.read.orc(_written(t, "orders", "orc", partition_by=["o_orderstatus"])))
query("src_22_tsv_text", "SELECT n_nationkey, n_name, n_regionkey FROM nation")(lambda t: files.from_tsv_text(t.spark, files.to_tsv_text(t.nation)))
query("src_23_latex_write", "SELECT '0' || n_nationkey || ' & ' || n_name || ' \\\\' AS line FROM (SELECT n_nationkey, replace(n_name, '_', '\\_') AS n_name FROM nation)")(
    lambda t: t.spark.read.text(_latex(t)).where(C("value").contains(" & NATION") | C("value").rlike(r"^0\d+ & ")).select(C("value").alias("line"))
)


def _latex(t: Tables) -> str:
    path = scratch(t.spark, "io") + ".tex"
    dispatch.write(Frame(t.nation.df.select(F.concat(F.lit("0"), C("n_nationkey").cast("string")).alias("k"), "n_name"), "k"), path)
    return path


query("src_24_markdown_write", "SELECT '| ' || r_regionkey || ' | ' || r_name || ' |' AS line FROM region")(
    lambda t: t.spark.read.text(_written(t, "region", "md")).where(C("value").rlike(r"^\| [0-9]")).select(C("value").alias("line"))
)
query("src_25_console", "SELECT r_regionkey || repeat(' ', 13 - length(r_regionkey::VARCHAR)) || r_name AS line FROM region")(
    lambda t: told(t, "line string", *[(x,) for x in render.console(t.region).split("\n")[2:]])
)
query("src_26_styled", "SELECT max(p_retailprice) AS highlighted FROM part")(lambda t: _highlighted(t))


def _highlighted(t: Tables):
    html = render.Styler(t.part).highlight_max("#ffff00", "p_retailprice").to_html()
    page = t.spark.createDataFrame([(html,)], "html string")
    cells = F.regexp_extract_all("html", F.lit("<td[^>]*background-color: #ffff00[^>]*>([^<]*)</td>"), F.lit(1))
    return page.select(F.explode(cells).alias("x")).select(C("x").cast("double").alias("highlighted")).distinct()


def _database(t: Tables, **more) -> jdbc.Engine:
    """An empty embedded database in this process."""
    import tempfile

    return jdbc.Engine("derby", path=f"{tempfile.mkdtemp(prefix='loomframe-db-')}/db", **more)


def _table_in(t: Tables, table: str) -> tuple[jdbc.Engine, str]:
    engine = _database(t)
    jdbc.write_table(getattr(t, table), engine, table)
    return engine, table


def _bare(df):
    """Names as an embedded database gives them back."""
    return df.toDF(*[c.lower() for c in df.columns])


query("src_27_jdbc_query", "SELECT n_name, n_regionkey FROM nation WHERE n_regionkey > 2")(
    lambda t: _bare(jdbc.read_query(t.spark, _table_in(t, "nation")[0], 'SELECT "n_name", "n_regionkey" FROM nation WHERE "n_regionkey" > ?', 2).df)
)
query("src_28_jdbc_table", "SELECT * FROM supplier")(lambda t: jdbc.read_table(t.spark, *_table_in(t, "supplier"), partition_column='"s_suppkey"', parts=3))


@query("src_29_jdbc_write", "SELECT * FROM region UNION ALL SELECT * FROM region")
def _(t):
    engine, table = _table_in(t, "region")
    jdbc.write_table(t.region, engine, table, "append")
    return jdbc.read_table(t.spark, engine, table)


@dataclass
class Nation:
    n_nationkey: int
    n_name: str
    n_regionkey: int


query("src_30_records", "SELECT n_nationkey::BIGINT AS n_nationkey, upper(n_name) AS n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")(
    lambda t: frame([Nation(r.n_nationkey, r.n_name.upper(), r.n_regionkey) for r in t.nation.to_records(Nation)], spark=t.spark)
)
query("src_31_rows_and_columns", "SELECT * FROM (VALUES (1::BIGINT, 'a'), (2::BIGINT, NULL), (3::BIGINT, 'c')) v(k, s)")(
    lambda t: frame({"k": [1, 2, 3], "s": ["a", None, "c"]}, spark=t.spark)
)
query("src_32_column_constants", "SELECT * FROM (VALUES ('R_REGIONKEY', 'r_regionkey'), ('R_NAME', 'r_name')) v(constant, name)")(lambda t: _constants(t))


def _constants(t: Tables):
    held: dict = {}
    exec(columns_source(t.region), held)  # noqa: S102  the source that the library has just made
    return told(t, "constant string, name string", *[(k, v) for k, v in vars(held["Columns"]).items() if k.isupper()])


# ---------------------------------------------------------------- accessors

query("proj_13_metadata", "SELECT count(*) AS n_rows, 3 AS n_columns, count(*) * 3 AS size, 2 AS ndim, false AS empty, 'n_nationkey,n_name,n_regionkey' AS names, 'int,string,int' AS kinds FROM nation")(
    lambda t: told(
        t, "n_rows long, n_columns int, size long, ndim int, empty boolean, names string, kinds string",
        (*t.nation.shape(), t.nation.size(), t.nation.ndim(), t.nation.is_empty(), ",".join(t.nation.column_names()), ",".join(t.nation.dtypes().values())),
    )
)
query("proj_13_info", f"SELECT 'event_id' AS name, count(event_id) AS present FROM ({_NULLS}) UNION ALL SELECT 'v', count(v) FROM ({_NULLS}) UNION ALL SELECT 'e', count(e) FROM ({_NULLS})")(
    lambda t: told(t, "name string, present long", *[(x["name"], x["non_null"]) for x in with_nulls(t).drop("ts").info()])
)
query("proj_14_column_index", "SELECT * FROM (VALUES ('n_nationkey', 0), ('n_name', 1), ('n_regionkey', 2), ('none', -1)) v(name, place)")(
    lambda t: told(t, "name string, place int", *[(n, t.nation.column_index(n)) for n in ("n_nationkey", "n_name", "n_regionkey", "none")])
)
query("proj_15_cells", "SELECT o.n_name AS by_row, p.n_name AS by_label, q.n_regionkey::BIGINT AS last FROM nation o, nation p, nation q WHERE o.n_nationkey = 7 AND p.n_nationkey = 11 AND q.n_nationkey = 24")(
    lambda t: told(t, "by_row string, by_label string, last long", (t.nation.get(7, "n_name"), t.nation.at(11, "n_name", "n_nationkey"), t.nation.get_row(24)[2]))
)
query("proj_17_iteration", "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS place, p_partkey, p_name FROM part")(
    lambda t: told(t, "place long, p_partkey long, p_name string", *[(i, *r) for i, r in enumerate(t.part.select("p_partkey", "p_name").iter_rows())])
)
query("proj_18_exports", "SELECT r_regionkey, r_name, 5::BIGINT AS rows_of_array, (SELECT r_name FROM region WHERE r_regionkey = 3) AS one FROM region")(
    lambda t: told(
        t, "r_regionkey int, r_name string, rows_of_array long, one string",
        *[(k, n, len(t.region.to_numpy()), t.region.query("r_regionkey == 3").squeeze()[1]) for k, n in zip(*t.region.to_dict().values(), strict=True)],
    )
)
query("proj_19_pipe", "SELECT n_name FROM nation WHERE n_regionkey = 3")(lambda t: t.nation.pipe(lambda f, k: f.query(f"n_regionkey == {k}"), 3).select("n_name"))
query("proj_23_valid_index", "SELECT min(place) AS first, max(place) AS last FROM (SELECT row_number() OVER (ORDER BY event_id) - 1 AS place, event_id % 3 = 0 AND event_id % 5 = 0 AS none FROM events) WHERE NOT none")(
    lambda t: (lambda f: told(t, "first long, last long", (f.first_valid_index(), f.last_valid_index())))(_without_key(with_nulls(t)))
)


def _without_key(f: Frame) -> Frame:
    """v and e in the rows' order, whose key does not count as a value."""
    return _Ordered(f.df.select("v", "e", "event_id"), "event_id")


class _Ordered(Frame):
    """Values beside a key that is only an order."""

    def _valid_index(self, pick):
        from loomframe.operators import ordered

        rows = ordered.numbered(self.df, self.order(), "row_")
        some = (F.isnotnull(F.nanvl("v", F.lit(None)))) | C("e").isNotNull()
        return rows.where(some).agg(pick(C("row_"))).first()[0]


query("proj_24_index_levels", "SELECT n_name || ':' || n_regionkey AS label, 'n_regionkey' AS dropped FROM nation")(
    lambda t: (lambda x: told(t, "label string, dropped string", *[(f"{a}:{b}", x.droplevel("n_name").level(0)) for a, b in x.swaplevel().labels()]))(Index(t.nation, "n_regionkey", "n_name"))
)
query("proj_25_index", "SELECT DISTINCT o_orderpriority AS label FROM orders WHERE o_orderpriority > '2'")(
    lambda t: told(t, "label string", *[(x,) for x in Index(t.orders, "o_orderpriority").filter(lambda c: c > "2").unique().labels()])
)

# ---------------------------------------------------------------- filters, expressions, joins

query("filt_09_sample_rules", "SELECT 50::BIGINT AS n, 50::BIGINT AS n_distinct, 50::BIGINT AS n_members, 80::BIGINT AS n_replaced FROM (SELECT 1)")(
    lambda t: t.orders.sample(50, seed=5).df.agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("n_distinct"))
    .crossJoin(t.orders.sample(50, seed=5).df.join(t.orders.df, "o_orderkey", "left_semi").agg(F.count("*").alias("n_members")))
    .crossJoin(t.nation.sample(80, replace=True, seed=5).df.agg(F.count("*").alias("n_replaced")))
)
query("expr_01_lexer", "SELECT p_partkey FROM part WHERE p_retailprice > 1250.0 OR p_brand = 'it''s' OR p_name LIKE '%a%' AND p_size < 12")(
    lambda t: t.part.query("`p_retailprice` > 1.25e3 or p_brand == 'it''s' or p_name like \"%a%\" and p_size < 12").select("p_partkey")
)
query("expr_05_spellings", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'")(
    lambda t: t.orders.query("`o_orderstatus` = 'F' and o_orderpriority <> '5-LOW'").select("o_orderkey")
)
query("expr_06_logic", f"SELECT event_id FROM ({_NULLS}) WHERE (coalesce(v > 50, false) OR coalesce(e = 'view', false)) AND NOT (coalesce(v > 90, false) AND coalesce(e = 'view', false))")(
    lambda t: with_nulls(t).query("(v > 50 or e == 'view') and not (v > 90 && e == 'view')").select("event_id")
)
query("join_04_unknown_how", "SELECT 'FrameError' AS error")(lambda t: told(t, "error string", (error_of(lambda: t.nation.merge(t.region, "sideways", left_on="n_regionkey", right_on="r_regionkey")),)))
query("join_05_long_key", "SELECT l_orderkey, l_linenumber, o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey")(
    lambda t: t.lineitem.merge(t.orders, left_on="l_orderkey", right_on="o_orderkey").select("l_orderkey", "l_linenumber", "o_totalprice")
)
query("join_06_double_key", "SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")(
    lambda t: Frame(t.nation.df.select("n_nationkey", (C("n_regionkey") * F.lit(-1.0)).alias("k")))
    .merge(Frame(t.region.df.select("r_name", (F.lit(0.0) - C("r_regionkey")).alias("k"))), on="k").select("n_nationkey", "r_name")
)

# ---------------------------------------------------------------- aggregates

query("agg_02_long_key", "SELECT l_partkey, round(sum(l_quantity), 4) AS l_quantity_sum FROM lineitem GROUP BY 1")(lambda t: t.lineitem.group_by("l_partkey").agg("l_quantity", "sum"))
query("agg_02_double_key", "SELECT l_discount, count(l_tax) AS l_tax_count FROM lineitem GROUP BY 1")(lambda t: t.lineitem.group_by("l_discount").agg("l_tax", "count"))
query("agg_04_count", f"SELECT e, count(v) AS v_count FROM ({_NULLS}) GROUP BY 1")(lambda t: with_nulls(t).group_by("e").agg("v", "count"))
query("agg_05_nunique", f"SELECT e, count(DISTINCT v) AS v_nunique FROM ({_NULLS}) GROUP BY 1")(lambda t: with_nulls(t).group_by("e").agg("v", "nunique"))
query("agg_07_mean", f"SELECT e, round(avg(v), 4) AS v_mean FROM ({_NULLS}) GROUP BY 1")(lambda t: with_nulls(t).group_by("e").agg("v", "mean"))
query("agg_08_min_max", f"SELECT e, min(v) AS v_min, max(v) AS v_max FROM ({_NULLS}) GROUP BY 1")(lambda t: with_nulls(t).group_by("e").agg({"v": ["min", "max"]}))
query("agg_15_column_sum", "SELECT round(sum(l_quantity), 4) AS s FROM lineitem")(lambda t: told(t, "s double", (t.lineitem.col_sum("l_quantity"),)))
query("agg_17_variance", "SELECT round(var_samp(o_totalprice) / 1e6, 2) AS v FROM orders", digits=2)(lambda t: told(t, "v double", (t.orders.col_var("o_totalprice") / 1e6,)))
query("agg_21_all_any", "SELECT bool_and(p_size > 0) AS a, bool_or(p_size > 49) AS b, bool_and(p_size <> 1) AS c FROM part")(
    lambda t: (lambda f: told(t, "a boolean, b boolean, c boolean", (f.col_all("x"), f.col_any("y"), f.col_all("z"))))(
        Frame(t.part.df.select(C("p_size").alias("x"), (C("p_size") > 49).alias("y"), (C("p_size") - 1).alias("z")))
    )
)
query("agg_23_kurtosis", "SELECT round(kurtosis(l_extendedprice), 4) AS k FROM lineitem")(lambda t: told(t, "k double", (t.lineitem.col_kurt("l_extendedprice"),)))
query("agg_25_sem", "SELECT round(stddev_samp(value) / sqrt(count(value)), 4) AS e FROM events")(lambda t: told(t, "e double", (t.events.col_sem("value"),)))
query("agg_27_covariance", "SELECT round(covar_samp(l_quantity, l_extendedprice), 2) AS c FROM lineitem", digits=2)(lambda t: told(t, "c double", (t.lineitem.col_cov("l_quantity", "l_extendedprice"),)))
query(
    "agg_32_extreme_places",
    """WITH x AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS place, value FROM events)
       SELECT (SELECT min(place) FROM x WHERE value = (SELECT max(value) FROM x)) AS most, (SELECT min(place) FROM x WHERE value = (SELECT min(value) FROM x)) AS least""",
)(lambda t: told(t, "most long, least long", (t.events.idxmax("value"), t.events.argmin("value"))))
query("agg_33_dot", "SELECT sum(n_nationkey * (n_nationkey * 2 + 1))::DOUBLE AS d FROM nation")(
    lambda t: told(t, "d double", (t.nation.select("n_nationkey").dot(Frame(t.nation.df.select((C("n_nationkey") * 2 + 1).alias("y")), "y")),))
)
query("agg_34_monotonic_unique", f"SELECT true AS up, false AS not_up, true AS one, false AS many, count(*) > count(v) AS some_missing FROM ({_NULLS})")(
    lambda t: told(
        t, "up boolean, not_up boolean, one boolean, many boolean, some_missing boolean",
        (t.orders.is_monotonic_increasing("o_orderkey"), t.orders.is_monotonic_increasing("o_totalprice"), t.orders.is_unique("o_orderkey"), t.orders.is_unique("o_custkey"), with_nulls(t).hasnans("v")),
    )
)
query("agg_36_partial_final", "SELECT l_suppkey, count(l_tax) AS l_tax_count, round(sum(l_tax), 4) AS l_tax_sum, max(l_shipdate)::VARCHAR AS last FROM lineitem GROUP BY 1")(
    lambda t: t.lineitem.group_by("l_suppkey").agg({"l_tax": ["count", "sum"]}).merge(
        Frame(t.lineitem.df.groupBy("l_suppkey").agg(F.max("l_shipdate").cast("timestamp_ntz").cast("string").alias("last"))), on="l_suppkey"
    )
)

# ---------------------------------------------------------------- order, sorting, shapes, scalars

query("win_08_rolling_std", "SELECT o_orderkey, CASE WHEN count(*) OVER w >= 4 THEN round(stddev_samp(o_totalprice) OVER w, 4) END AS s FROM orders WINDOW w AS (ORDER BY o_orderkey ROWS 3 PRECEDING)")(
    lambda t: t.orders.rolling("o_totalprice", 4).std("s").select("o_orderkey", "s")
)
query(
    "win_11_ewm_var",
    """WITH RECURSIVE r AS (SELECT n_nationkey AS k, n_regionkey::DOUBLE AS m, 0::DOUBLE AS v, 1 AS n FROM nation WHERE n_nationkey = 0
       UNION ALL SELECT b.n_nationkey, 0.4 * b.n_regionkey + 0.6 * r.m, 0.6 * r.v + 0.4 * pow(b.n_regionkey - (0.4 * b.n_regionkey + 0.6 * r.m), 2), r.n + 1 FROM r JOIN nation b ON b.n_nationkey = r.k + 1)
       SELECT k AS n_nationkey, CASE WHEN n > 1 THEN round(v / (1 - pow(0.6, n)), 4) END AS v, CASE WHEN n > 1 THEN round(sqrt(v / (1 - pow(0.6, n))), 4) END AS s FROM r""",
)(lambda t: t.nation.ewm("n_regionkey", 0.4).var("v").ewm("n_regionkey", 0.4).std("s").select("n_nationkey", "v", "s"))
query("sort_02_na_first", f"SELECT row_number() OVER (ORDER BY v NULLS FIRST, event_id) - 1 AS place, event_id FROM ({_NULLS})")(
    lambda t: told(t, "place long, event_id long", *[(i, r[0]) for i, r in enumerate(with_nulls(t).select("event_id", "v").sort_by("v", na_position="first").df.select("event_id").toLocalIterator())])
)
query("sort_03_sort_index", "SELECT row_number() OVER (ORDER BY n_nationkey DESC) - 1 AS place, n_name FROM nation")(
    lambda t: told(t, "place long, n_name string", *[(i, r[0]) for i, r in enumerate(t.nation.sort_index(False).df.select("n_name").collect())])
)
query("sort_07_sql_order_by", "SELECT row_number() OVER (ORDER BY p_size DESC, p_partkey) - 1 AS place, p_partkey FROM part")(
    lambda t: told(t, "place long, p_partkey long", *[(i, r[0]) for i, r in enumerate(run_sql("SELECT p_partkey FROM ${p} ORDER BY p_size DESC, p_partkey ASC", t.part).df.toLocalIterator())])
)
query("rsh_04_stack", "SELECT l_orderkey, l_linenumber, 'l_tax' AS variable, l_tax AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', l_discount FROM lineitem")(
    lambda t: t.lineitem.select("l_orderkey", "l_linenumber", "l_tax", "l_discount").stack(["l_orderkey", "l_linenumber"], ["l_tax", "l_discount"])
)
query("rsh_04_unstack", "SELECT s_suppkey, s_nationkey::DOUBLE AS nation, s_acctbal AS s_acctbal FROM supplier")(
    lambda t: t.supplier.rename_columns({"s_nationkey": "nation"}).stack(["s_suppkey"], ["nation", "s_acctbal"]).unstack("s_suppkey", "variable", "value")
)
query("math_02_scalar_arithmetic", "SELECT s_suppkey, round(s_acctbal + 5, 4) AS a, round(s_acctbal - 5, 4) AS b, round(s_acctbal * 5, 4) AS c, round(s_acctbal / 5, 4) AS d FROM supplier")(
    lambda t: t.supplier.col_add("a", "s_acctbal", 5).col_sub("b", "s_acctbal", 5).col_mul("c", "s_acctbal", 5).col_div("d", "s_acctbal", 5).select("s_suppkey", "a", "b", "c", "d")
)
query("math_07_default_names", "SELECT event_id, least(greatest(value, 20), 30) AS value_clip, round_even(value, 0) AS value_round FROM events")(
    lambda t: t.events.select("event_id", "value").col_clip("value", 20, 30).col_round("value").select("event_id", "value_clip", "value_round")
)
query("str_02_parts", "SELECT c_custkey, contains(c_name, '7') AS a, starts_with(c_mktsegment, 'B') AS b, ends_with(c_mktsegment, 'Y') AS c FROM customer")(
    lambda t: (lambda f: f.assign(a=f.str("c_name").contains("7"), b=f.str("c_mktsegment").starts_with("B"), c=f.str("c_mktsegment").ends_with("Y")))(t.customer).select("c_custkey", "a", "b", "c")
)
query("str_03_replace_length", "SELECT c_custkey, replace(c_name, '#', ' no ') AS r, length(c_mktsegment) AS n FROM customer")(
    lambda t: (lambda f: f.assign(r=f.str("c_name").replace("#", " no "), n=f.str("c_mktsegment").length()))(t.customer).select("c_custkey", "r", "n")
)
query("date_03_frequency", "SELECT unnest([TIMESTAMP '2024-01-31', TIMESTAMP '2024-02-29', TIMESTAMP '2024-03-29', TIMESTAMP '2024-04-29']) AS ts")(lambda t: date_range(t.spark, dt.datetime(2024, 1, 31), 4, "1M"))
query("date_03_steps_between", "SELECT datediff('hour', min(ts), max(ts) - INTERVAL 0 SECOND)::BIGINT - CASE WHEN (epoch_us(max(ts)) - epoch_us(min(ts))) // 3600000000 < datediff('hour', min(ts), max(ts)) THEN 1 ELSE 0 END AS steps FROM events")(
    lambda t: told(t, "steps long", (Frequency.parse("1h").steps_between(*t.events.df.agg(F.min("ts"), F.max("ts")).first()),))
)
query("date_04_infer_frequency", "SELECT '6H' AS step, 'unknown' AS none")(
    lambda t: told(t, "step string, none string", (date_range(t.spark, dt.datetime(2024, 1, 1), 9, "6h").infer_freq("ts"), date_range(t.spark, dt.datetime(2024, 1, 1), 9, "1M").infer_freq("ts")))
)
query("arr_01_arrays", "SELECT vec_id, x FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) WHERE x > 0")(
    lambda t: Frame(t.embeddings.df.select("vec_id", C("embedding").alias("x"))).explode("x").query("x > 0")
)
query("jsn_01_json_value", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 'k' AS key FROM events")(
    lambda t: (lambda f: f.json_value("props", "$.k", "k", "bigint").json_keys("props", "keys").explode("keys").rename_columns({"keys": "key"}))(t.events).select("event_id", "k", "key")
)
query("ts_02_bins", "SELECT event_id, floor((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 7200000000.0)::BIGINT AS bin FROM events")(
    lambda t: t.events.resample("ts", "2h").bins().select("event_id", "bin")
)
query(
    "ts_07_bucket_rules",
    """WITH x AS (SELECT n_nationkey, TIMESTAMP '2024-01-01' + (n_nationkey * 3) * INTERVAL 1 HOUR AS ts FROM nation), g AS (SELECT unnest(range(0, 37)) AS i)
       SELECT TIMESTAMP '2024-01-01' + (i * 2) * INTERVAL 1 HOUR AS _bucket_, CASE WHEN count(n_nationkey) > 0 THEN sum(n_nationkey)::BIGINT END AS sum_n_nationkey, nullif(count(n_nationkey), 0) AS count_k
       FROM g LEFT JOIN x ON ts >= TIMESTAMP '2024-01-01' + (i * 2) * INTERVAL 1 HOUR AND ts < TIMESTAMP '2024-01-01' + (i * 2 + 2) * INTERVAL 1 HOUR GROUP BY i""",
)(
    lambda t: Frame(
        t.nation.df.select("n_nationkey", C("n_nationkey").alias("k"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=C("n_nationkey") * 3)).alias("ts")), "ts"
    ).resample("ts", "2h").agg({"n_nationkey": "sum", "k": "count"})
)

# ---------------------------------------------------------------- SQL

query("sql_02_from", "SELECT 1 + 1 AS two, count(*) AS n FROM nation")(
    lambda t: run_sql("SELECT 1 + 1 AS two FROM DUAL").df.select(C("two").cast("int")).crossJoin(run_sql("SELECT count(*) AS n FROM this", this=t.nation).df)
)
query("sql_02_bare_name", "SELECT 'FrameError' AS error")(lambda t: told(t, "error string", (error_of(lambda: run_sql("SELECT n_name FROM nation", t.nation)),)))
query("sql_03_placeholders", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")(
    lambda t: run_sql("SELECT n_name, r_name FROM ${first} a JOIN ${second} b ON a.n_regionkey = b.r_regionkey", t.nation, t.region)
)
query("sql_04_where", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity > 40 AND l_discount IN (0.05, 0.1)) OR (l_returnflag = 'R' AND NOT l_tax BETWEEN 0.02 AND 0.08)")(
    lambda t: run_sql("SELECT l_orderkey, l_linenumber FROM ${l} WHERE l_quantity > 40 AND l_discount IN (0.05, 0.1) OR l_returnflag = 'R' AND l_tax NOT BETWEEN 0.02 AND 0.08", t.lineitem)
)
query("sql_06_count_star", "SELECT l_linestatus, count(*) AS n FROM lineitem GROUP BY 1")(lambda t: run_sql("SELECT l_linestatus, count(*) AS n FROM ${l} GROUP BY l_linestatus", t.lineitem))
query("sql_09_default_names", "SELECT c_mktsegment, count(*) AS \"count_*\", max(c_acctbal) AS max_c_acctbal FROM customer GROUP BY 1 HAVING count(*) > 1")(
    lambda t: run_sql("SELECT c_mktsegment, count(*), max(c_acctbal) FROM ${c} GROUP BY c_mktsegment HAVING `count_*` > 1 ORDER BY max_c_acctbal", t.customer)
)
query("sql_18_dml_counts", "SELECT (SELECT count(*) FROM nation WHERE n_regionkey = 1) AS updated, (SELECT count(*) FROM nation WHERE n_regionkey > 2) AS deleted, 2::BIGINT AS inserted")(
    lambda t: told(
        t, "updated long, deleted long, inserted long",
        tuple(t.nation.update(x)[1] for x in ("UPDATE this SET n_name = 'x' WHERE n_regionkey = 1", "DELETE FROM this WHERE n_regionkey > 2", "INSERT INTO this (n_name) VALUES ('a'), ('b')")),
    )
)
query("sql_19_capabilities", "SELECT * FROM (VALUES ('CTE', true), ('WINDOW_FUNCTIONS', true)) v(name, supported)")(
    lambda t: told(t, "name string, supported boolean", *[(k, v) for k, v in engines.capabilities().items() if k in ("CTE", "WINDOW_FUNCTIONS")])
)
query("sql_20_comments", "SELECT r_name FROM region WHERE r_regionkey > 1")(lambda t: run_sql("SELECT r_name -- the name, FROM nowhere\nFROM ${r} /* not\nthis */ WHERE r_regionkey > 1 -- end", t.region))

# ---------------------------------------------------------------- functions of one's own, arrays, plots

query("udf_05_predicates", "SELECT n_nationkey, n_regionkey FROM nation WHERE n_regionkey IN (SELECT n_regionkey FROM nation GROUP BY 1 HAVING max(n_nationkey) > 22)")(
    lambda t: t.nation.group_by("n_regionkey").filter("n_nationkey", "max", lambda c: c > 22).select_by(lambda n: n.endswith("key"))
)
query("udf_06_udaf", "SELECT event_type, round(max(value) - min(value), 4) AS spread FROM events GROUP BY 1")(
    lambda t: t.events.group_by("event_type").agg_python("value", lambda x: float(x.max() - x.min()), "spread")
)
query("udf_06_udtf", "SELECT r_regionkey, unnest(string_split(r_name, 'A')) AS part FROM region")(
    lambda t: t.region.apply_table(lambda r: [(r[0], p) for p in r[1].split("A")], "r_regionkey int, part string")
)


class _Loud:
    """An engine that upper-cases names of its result."""

    name, version = "loud", "1"

    def query(self, text: str, tables: dict, this=None):
        out = engines.BuiltIn().query(text, tables, this)
        return Frame(out.df.toDF(*[n.upper() for n in out.df.columns]))

    def supports(self, capability: str) -> bool:
        return False


@query("udf_07_engine", "SELECT r_name AS R_NAME FROM region")
def _(t):
    engines.use_custom(_Loud())
    try:
        return engines.run("SELECT r_name FROM ${r}", r=t.region)
    finally:
        engines.reset()


@query("udf_08_statistics", "SELECT round(quantile_cont(value, 0.25), 4) AS m, round(avg(value), 4) AS again FROM events")
def _(t):
    """Another median while it is given, and the built-in mean after it."""
    stats.use_statistics(median=lambda x: F.percentile(x, F.lit(0.25)))
    try:
        given = t.events.col_median("value")
    finally:
        stats.reset_statistics()
    return told(t, "m double, again double", (given, t.events.col_mean("value")))


query("num_01_arrays", f"SELECT event_id, v::BIGINT AS whole, v IS NULL AS missing FROM ({_NULLS}) ORDER BY event_id LIMIT 40 OFFSET 10", digits=4)(
    lambda t: with_nulls(t).slice(10, 50).df.select("event_id", F.rint(A.kept(C("v"))).cast("bigint").alias("whole"), A.kept(C("v")).isNull().alias("missing"))
)
query("num_02_arithmetic", "SELECT n_nationkey, n_nationkey + n_regionkey AS a, n_nationkey - n_regionkey AS b, n_nationkey * n_regionkey AS c, round(n_nationkey / (n_regionkey + 1), 4) AS d FROM nation")(
    lambda t: t.nation.df.select("n_nationkey", *[A.arithmetic(op, C("n_nationkey"), C("n_regionkey")).alias(n) for n, op in (("a", "add"), ("b", "sub"), ("c", "mul"))], A.arithmetic("div", C("n_nationkey"), C("n_regionkey") + 1).alias("d"))
)
query("num_04_compare", f"SELECT event_id, coalesce(v > 50, false) AS gt, coalesce(v <= 50, false) AS le, coalesce(v = 10, false) AS eq, coalesce(v <> 10, true) AS ne FROM ({_NULLS})")(
    lambda t: (lambda f: f.df.select("event_id", F.coalesce(f.col_gt("v", 50), F.lit(False)).alias("gt"), F.coalesce(f.col_le("v", 50), F.lit(False)).alias("le"), F.coalesce(f.col_eq("v", 10), F.lit(False)).alias("eq"), F.coalesce(f.col_ne("v", 10), F.lit(True)).alias("ne")))(with_nulls(t))
)
query("num_06_nan_policy", f"SELECT round(avg(v), 4) AS skip, 'NaN' AS propagate FROM ({_NULLS})")(
    lambda t: with_nulls(t).df.agg(A.statistic(C("v"), "mean").alias("skip"), A.statistic(C("v"), "mean", "propagate").cast("string").alias("propagate"))
)
query("num_07_correlation", "SELECT round(covar_samp(l_quantity, l_discount), 6) AS cov, round(corr(l_quantity, l_discount), 6) AS r FROM lineitem", digits=6)(
    lambda t: t.lineitem.df.agg(stats.covariance(C("l_quantity"), C("l_discount")).alias("cov"), stats.pearson(C("l_quantity"), C("l_discount")).alias("r"))
)
query("num_09_matrix", "SELECT * FROM (VALUES (0::BIGINT, 0.6::DOUBLE, -0.7::DOUBLE, 1.0::DOUBLE), (1::BIGINT, -0.2::DOUBLE, 0.4::DOUBLE, 2.0::DOUBLE)) v(i, a, b, x)")(
    lambda t: (lambda m: told(t, "i long, a double, b double, x double", *[(i, *m.inverse().row(i), m.solve([18.0, 14.0])[i]) for i in range(2)]))(A.Matrix([[4.0, 7.0], [2.0, 6.0]]))
)
query("num_10_random", "SELECT 20000::BIGINT AS n, true AS unit, true AS whole, true AS near_mean, true AS near_half, true AS chosen")(
    lambda t: t.spark.range(20000).select(
        A.random_column("rand", 3).alias("u"), A.random_column("randint", 4, 5, 9).alias("i"), A.random_column("randn", 5).alias("z"), A.random_column("binomial", 6, n=10).alias("b")
    ).agg(
        F.count("*").alias("n"), (F.min("u").between(0, 1) & F.max("u").between(0, 1)).alias("unit"), ((F.min("i") == 5) & (F.max("i") == 8)).alias("whole"),
        (F.abs(F.avg("z")) < 0.05).alias("near_mean"), (F.abs(F.avg("b") - 5) < 0.1).alias("near_half"),
    ).crossJoin(A.choice(t.spark, ["a", "b"], 500, 7).agg((F.count_distinct("value") == 2).alias("chosen")))
)
query("viz_02_bar", "SELECT n_name, n_regionkey::DOUBLE AS n_regionkey FROM nation")(lambda t: t.nation.plot.bar("n_name", "n_regionkey"))
query("viz_02_pie", "SELECT p_name, p_retailprice FROM part")(lambda t: t.part.plot.pie("p_name", "p_retailprice"))
query(
    "viz_05_hexbin",
    """WITH e AS (SELECT min(l_quantity) x0, (max(l_quantity) - min(l_quantity)) / 8 dx, min(l_extendedprice) y0, (max(l_extendedprice) - min(l_extendedprice)) / 8 dy FROM lineitem),
       b AS (SELECT least(floor((l_quantity - x0) / dx), 7) AS i, least(floor((l_extendedprice - y0) / dy), 7) AS j, x0, dx, y0, dy FROM lineitem, e)
       SELECT round(x0 + (i + 0.5) * dx, 4) AS x, round(y0 + (j + 0.5) * dy, 4) AS y, count(*) AS count FROM b GROUP BY i, j, x0, dx, y0, dy""",
)(lambda t: t.lineitem.plot.hexbin("l_quantity", "l_extendedprice", 8))
query("viz_06_scatter_matrix", "SELECT p_size::DOUBLE AS p_size, p_retailprice FROM part")(lambda t: t.part.plot.scatter_matrix("p_size", "p_retailprice")[("p_size", "p_retailprice")])



def _drawn(t: Tables, kind: str, *names: str):
    path = scratch(t.spark, "plot") + ".svg"
    t.part.plot.save_svg(path, kind, *names)
    return t.spark.read.text(path)


query("viz_08_save", "SELECT count(*) AS points, 10::BIGINT AS bars FROM part")(
    lambda t: _drawn(t, "scatter", "p_size", "p_retailprice").agg(F.sum(C("value").startswith("<circle").cast("long")).alias("points")).crossJoin(
        _drawn(t, "hist", "p_retailprice").agg(F.sum(C("value").startswith("<rect").cast("long")).alias("bars"))
    )
)

# ---------------------------------------------------------------- databases


@query("rel_01_transactions", "SELECT r_regionkey, CASE r_regionkey WHEN 1 THEN 'changed' ELSE r_name END AS r_name FROM region")
def _(t):
    """A statement that is committed, and one of a block that fails."""
    engine, table = _table_in(t, "region")
    with jdbc.Connection(t.spark, engine) as c:
        with c.transaction():
            c.execute('UPDATE region SET "r_name" = ? WHERE "r_regionkey" = ?', "changed", 1)
        try:
            with c.transaction():
                c.execute("DELETE FROM region")
                raise FrameError("on purpose")
        except FrameError:
            pass
        return told(t, "r_regionkey int, r_name string", *[tuple(r.values()) for r in c.fetch("SELECT * FROM region")])


query("rel_02_configuration", "SELECT 'jdbc:postgresql://db:5433/sales' AS url, 'me' AS usr, 'jdbc:x://***@h/d?password=***' AS masked")(
    lambda t: (lambda e: told(t, "url string, usr string, masked string", (e.url(), e.user, jdbc.sanitized("jdbc:x://u:p@h/d?password=q"))))(jdbc.Engine.from_url("postgres://me:pw@db:5433/sales"))
)
query(
    "rel_03_databases",
    """SELECT * FROM (VALUES ('access', 'jdbc:ucanaccess://p'), ('doris', 'jdbc:mysql://h:9030/d'), ('h2', 'jdbc:h2:p'), ('mysql', 'jdbc:mysql://h:3306/d'),
       ('oracle', 'jdbc:oracle:thin:@//h:1521/d'), ('postgresql', 'jdbc:postgresql://h:5432/d'), ('sqlite', 'jdbc:sqlite:p')) v(kind, url)""",
)(lambda t: told(t, "kind string, url string", *[(k, jdbc.Engine(k, "h", database="d", path="p").url()) for k in jdbc.DATABASES if k != "derby"]))


@query("rel_04_sql_builder", "SELECT n_name, n_regionkey::INTEGER AS n_regionkey FROM nation WHERE n_regionkey IN (0, 4)")
def _(t):
    engine, _ = _table_in(t, "nation")
    with jdbc.Connection(t.spark, engine) as c:
        c.execute('DELETE FROM nation WHERE "n_regionkey" BETWEEN ? AND ?', 1, 3)
        return told(t, "n_name string, n_regionkey int", *[(r["n_name"], r["n_regionkey"]) for r in c.fetch("SELECT * FROM nation")])


@dataclass
class Item:
    id: int
    name: str


@query("rel_05_session", "SELECT * FROM (VALUES (1, 'one'), (3, 'three!'), (4, 'four')) v(id, name)")
def _(t):
    with jdbc.Connection(t.spark, _database(t)) as c:
        c.execute("CREATE TABLE items (id INT PRIMARY KEY, name VARCHAR(40))")
        items = jdbc.Session(c, Item, "items", "id")
        for i, name in enumerate(("one", "two", "three", "four"), 1):
            items.insert(Item(i, name))
        third = items.find_by_id(3)
        items.update(Item(3, third.name + "!"))
        items.delete(2)
        return told(t, "id int, name string", *[(x.id, x.name) for x in items.list()])
