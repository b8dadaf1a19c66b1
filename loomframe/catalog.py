"""The registered queries, in the order of the operator inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.frame import Frame, concat
from loomframe.plans.sql import sql as run_sql
from loomframe.registry import Tables, query

C = F.col

# ---------------------------------------------------------------- flagship and bench queries


@query(
    "flagship",
    """SELECT l_returnflag, round(sum(l_extendedprice), 4) AS l_extendedprice_sum, round(avg(l_discount), 4) AS l_discount_mean,
       count(l_quantity) AS l_quantity_count FROM lineitem WHERE l_quantity > 25 AND l_discount BETWEEN 0.05 AND 0.07
       GROUP BY l_returnflag ORDER BY l_extendedprice_sum DESC LIMIT 10""",
)
def _(t: Tables):
    rows = t.lineitem.query("l_quantity > 25 and l_discount between 0.05 and 0.07")
    sums = rows.group_by("l_returnflag").agg({"l_extendedprice": "sum", "l_discount": "mean", "l_quantity": "count"})
    return sums.nlargest(10, "l_extendedprice_sum")


@query(
    "bench_filter_group",
    "SELECT l_returnflag AS k, count(*) AS \"count_*\", round(sum(l_quantity), 4) AS sum_l_quantity FROM lineitem WHERE l_orderkey % 10 = 0 GROUP BY 1",
)
def _(t):
    return run_sql("SELECT l_returnflag AS k, count(*), sum(l_quantity) FROM ${t} WHERE l_orderkey % 10 = 0 GROUP BY l_returnflag", t.lineitem)


@query(
    "bench_compound_join",
    """SELECT count(*) AS n FROM orders a JOIN lineitem b ON a.o_orderkey = b.l_orderkey
       JOIN part c ON (b.l_partkey + 0) = c.p_partkey AND (b.l_returnflag || b.l_linestatus) <> c.p_brand""",
)
def _(t):
    lines = t.lineitem.eval("pk = l_partkey + 0; rs = l_returnflag + l_linestatus").astype("pk", "long")
    joined = t.orders.merge(lines, left_on="o_orderkey", right_on="l_orderkey").merge(t.part, left_on="pk", right_on="p_partkey")
    return joined.query("rs != p_brand").df.agg(F.count("*").alias("n"))


@query(
    "bench_compound_key_join",
    """SELECT count(*) AS n FROM orders a JOIN lineitem b ON a.o_orderkey = b.l_orderkey
       JOIN (SELECT p_partkey AS k1, CASE p_size % 3 WHEN 0 THEN 'AF' WHEN 1 THEN 'NO' ELSE 'RF' END AS k2 FROM part) c
       ON (b.l_partkey + b.l_linenumber) = c.k1 AND (b.l_returnflag || b.l_linestatus) = c.k2""",
)
def _(t):
    """A computed number and a joined text make the key."""
    flags = F.when(C("p_size") % 3 == 0, "AF").when(C("p_size") % 3 == 1, "NO").otherwise("RF")
    keys = Frame(t.part.df.select(C("p_partkey").alias("k1"), flags.alias("k2")))
    return run_sql(
        "SELECT count(*) AS n FROM ${a} a JOIN ${b} b ON a.o_orderkey = b.l_orderkey JOIN ${c} c ON b.l_partkey + b.l_linenumber = c.k1 AND b.l_returnflag + b.l_linestatus = c.k2",
        t.orders, t.lineitem, keys,
    )


@query(
    "bench_three_table_join",
    "SELECT count(*) AS n FROM orders a JOIN lineitem b ON a.o_orderkey = b.l_orderkey JOIN customer c ON a.o_custkey = c.c_custkey",
)
def _(t):
    return run_sql(
        "SELECT count(*) AS n FROM ${a} a JOIN ${b} b ON a.o_orderkey = b.l_orderkey JOIN ${c} c ON a.o_custkey = c.c_custkey",
        t.orders, t.lineitem, t.customer,
    )


# ---------------------------------------------------------------- projection

query("proj_01_select", "SELECT o_orderkey, o_totalprice FROM orders")(lambda t: t.orders.select("o_orderkey", "o_totalprice"))
query("proj_02_select_by", "SELECT c_custkey, c_name, c_nationkey FROM customer")(lambda t: t.customer.select_by(lambda n: n in ("c_custkey", "c_name", "c_nationkey")))
query("proj_03_select_dtypes", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")(lambda t: t.customer.select_dtypes(["int", "long", "double"]))
query("proj_04_drop", "SELECT c_custkey, c_nationkey FROM customer")(lambda t: t.customer.drop("c_name", "c_acctbal", "c_mktsegment", "none_such"))
query("proj_05_insert", "SELECT n_nationkey, n_regionkey * 2 AS twice, n_name, n_regionkey FROM nation")(lambda t: t.nation.insert(1, "twice", C("n_regionkey") * 2))
query("proj_05_pop", "SELECT n_name FROM nation")(lambda t: t.nation.pop("n_name"))
query("proj_06_assign", "SELECT *, round(s_acctbal * 2.0 + 1.0, 4) AS y FROM supplier")(lambda t: t.supplier.assign(y="s_acctbal * 2 + 1"))
query("proj_07_rename", "SELECT n_nationkey AS k, n_name AS name, n_regionkey FROM nation")(lambda t: t.nation.rename_columns({"n_nationkey": "k", "n_name": "name"}))
query("proj_08_prefix_suffix", "SELECT r_regionkey AS a_r_regionkey_z, r_name AS a_r_name_z FROM region")(lambda t: t.region.add_prefix("a_").add_suffix("_z"))
query("proj_09_set_axis", "SELECT r_regionkey AS x, r_name AS y FROM region")(lambda t: t.region.rename_axis("rows").set_axis(["x", "y"]))
query(
    "proj_10_astype",
    """SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS o_totalprice, CAST(o_custkey AS VARCHAR) AS o_custkey,
       CAST(o_orderdate AS DATE) AS o_orderdate FROM orders""",
)(lambda t: t.orders.astype("o_totalprice", "long").astype("o_custkey", "string").astype("o_orderdate", "date").select("o_orderkey", "o_totalprice", "o_custkey", "o_orderdate"))
query("proj_11_infer_objects", "SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events")(
    lambda t: Frame(t.events.df.select("event_id", F.regexp_extract("props", "([0-9]+)", 1).alias("k"))).infer_objects()
)
query("proj_12_clone", "SELECT *, n_name AS again FROM nation")(lambda t: t.nation.with_column_clone("n_name", "again"))
query("proj_16_set_cell", "SELECT r_regionkey, CASE WHEN r_regionkey = 2 THEN 'X' ELSE r_name END AS r_name FROM region")(lambda t: t.region.isetitem(2, "r_name", "X"))
query("proj_20_reset_index", "SELECT r_name, r_regionkey, row_number() OVER (ORDER BY r_regionkey) - 1 AS idx FROM region")(lambda t: t.region.reset_index("idx"))
query("proj_20_set_index", "SELECT r_regionkey, r_name AS __idx__ FROM region")(lambda t: t.region.set_index("r_name"))
query("proj_21_loc", "SELECT n_name, n_nationkey FROM nation WHERE n_regionkey IN (3, 1)")(lambda t: t.nation.loc([3, 1], "n_regionkey").df.select("n_name", "n_nationkey"))
query("proj_21_iloc", "SELECT n_name, n_nationkey FROM nation WHERE n_nationkey IN (4, 0)")(lambda t: t.nation.iloc(4, 0).df.select("n_name", "n_nationkey"))
query("proj_22_reindex", "SELECT x.k AS r_regionkey, r.r_name FROM (VALUES (1), (9), (0)) x(k) LEFT JOIN region r ON r.r_regionkey = x.k")(
    lambda t: t.region.reindex([1, 9, 0], "r_regionkey").df.select("r_regionkey", "r_name")
)

# ---------------------------------------------------------------- filters and expressions

query("filt_01_mask", "SELECT * FROM region WHERE r_regionkey IN (0, 3)")(lambda t: t.region.filter([True, False, False, True, False]))
query("filt_02_query", "SELECT o_orderkey FROM orders WHERE (o_totalprice > 400000 AND o_orderstatus <> 'F') OR o_orderpriority LIKE '1-%'")(
    lambda t: t.orders.query("o_totalprice > 400000 && o_orderstatus != 'F' || o_orderpriority like '1-%'").select("o_orderkey")
)
query("filt_03_compare", "SELECT event_id FROM events WHERE value >= 50 AND event_type <> 'view'")(
    lambda t: t.events.filter(t.events.col_ge("value", 50) & t.events.col_ne("event_type", "view")).select("event_id")
)
query("filt_04_isin", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")(
    lambda t: t.customer.filter(t.customer.col_isin("c_mktsegment", "BUILDING", "MACHINERY", None)).select("c_custkey")
)
query("filt_04_isin_frame", "SELECT r_regionkey IN (1, 2) AS r_regionkey, r_name IN ('ASIA') AS r_name FROM region")(lambda t: t.region.isin(1, 2, "ASIA"))
query("filt_05_between", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20")(lambda t: t.part.filter(t.part.between("p_size", 10, 20)).select("p_partkey"))
query("filt_06_where", "SELECT CASE WHEN n_regionkey > 1 THEN n_nationkey END AS n_nationkey, CASE WHEN n_regionkey > 1 THEN n_regionkey END AS n_regionkey FROM nation")(
    lambda t: t.nation.select("n_nationkey", "n_regionkey").where(C("n_regionkey") > 1)
)
query("filt_06_mask", "SELECT CASE WHEN n_regionkey > 1 THEN -1 ELSE n_nationkey END AS n_nationkey, CASE WHEN n_regionkey > 1 THEN -1 ELSE n_regionkey END AS n_regionkey FROM nation")(
    lambda t: t.nation.select("n_nationkey", "n_regionkey").mask(C("n_regionkey") > 1, -1)
)
query("filt_07_head", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 7")(lambda t: t.orders.head(7))
query("filt_07_tail", "SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 7")(lambda t: t.orders.tail(7))
query("filt_08_slice", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 100")(lambda t: t.orders.slice(100, 120))
query("filt_08_slice_negative", "SELECT * FROM nation ORDER BY n_nationkey LIMIT 3 OFFSET 20")(lambda t: t.nation.slice(-5, -2))
query("filt_09_sample")(lambda t: t.orders.sample(50, seed=3))
query("filt_09_sample_replace")(lambda t: t.nation.sample(50, replace=True, seed=3))
query("filt_10_between_time", "SELECT event_id FROM events WHERE CAST(ts AS TIME) >= TIME '22:00:00' OR CAST(ts AS TIME) <= TIME '01:30:00'")(
    lambda t: t.events.between_time("ts", "22:00", "01:30").select("event_id")
)
query("filt_10_at_time", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS TIME) = TIME '00:00:00'")(lambda t: t.orders.at_time("o_orderdate", "00:00").select("o_orderkey"))
query("filt_11_asof", "SELECT * FROM events WHERE ts <= TIMESTAMP '2024-01-10 12:00:00' ORDER BY event_id DESC LIMIT 1")(lambda t: t.events.asof("ts", "2024-01-10 12:00:00"))
query("expr_02_precedence", "SELECT o_orderkey FROM orders WHERE NOT (o_totalprice + 10 * 2 > 50000) OR (o_custkey < 100 AND o_orderstatus = 'O')")(
    lambda t: t.orders.query("not o_totalprice + 10 * 2 > 50000 or o_custkey < 100 and o_orderstatus = 'O'").select("o_orderkey")
)
query(
    "expr_03_arithmetic",
    """SELECT p_partkey, round(p_retailprice / p_size, 4) AS d, CAST(p_size AS DOUBLE) % 7 AS m, p_brand || '-' || CAST(p_size AS VARCHAR) AS s,
       CASE WHEN p_size - 11 = 0 THEN 'infinity'::DOUBLE ELSE round(p_retailprice / (p_size - 11), 4) END AS z FROM part""",
)(lambda t: t.part.eval("d = p_retailprice / p_size; m = p_size % 7; s = p_brand + '-' + p_size; z = p_retailprice / (p_size - 11)").select("p_partkey", "d", "m", "s", "z"))
_NULLS = "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS e FROM events"


def with_nulls(t: Tables) -> Frame:
    """events with a third of the values and a fifth of the types missing, the former as NaN."""
    df = t.events.df.select(
        "event_id",
        F.when(C("event_id") % 3 == 0, F.lit(float("nan"))).otherwise(C("value")).alias("v"),
        F.when(C("event_id") % 5 != 0, C("event_type")).alias("e"),
        "ts",
    )
    return Frame(df, "event_id")


query("expr_04_missing_compare", f"SELECT event_id FROM ({_NULLS}) WHERE (v IS NULL OR v <> 10) AND NOT coalesce(v > 50, false)")(
    lambda t: with_nulls(t).query("v != 10 and not v > 50").select("event_id")
)
query("expr_07_ternary", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS size FROM orders")(
    lambda t: t.orders.eval("size = o_totalprice > 300000 ? 'big' : o_totalprice > 100000 ? 'mid' : 'small'").select("o_orderkey", "size")
)
query("expr_08_between", f"SELECT event_id FROM ({_NULLS}) WHERE v IS NOT NULL AND NOT (v BETWEEN 10 AND 60)")(lambda t: with_nulls(t).query("v not between 10 and 60").select("event_id"))
query("expr_09_like", f"SELECT event_id FROM ({_NULLS}) WHERE e LIKE '%i%' AND e NOT LIKE 'v__w'")(lambda t: with_nulls(t).query("e like '%i%' and e not like 'v__w'").select("event_id"))
query("expr_10_in", f"SELECT event_id FROM ({_NULLS}) WHERE e IN ('view', 'click') OR e IS NULL")(lambda t: with_nulls(t).query("e in ('view', 'click', null)").select("event_id"))
query("expr_10_not_in", f"SELECT event_id FROM ({_NULLS}) WHERE e IS NULL OR e NOT IN ('view', 'click')")(lambda t: with_nulls(t).query("e not in ('view', 'click')").select("event_id"))
query("expr_11_is", f"SELECT event_id FROM ({_NULLS}) WHERE v IS NULL AND e IS NOT NULL")(lambda t: with_nulls(t).query("v is null and e is not null").select("event_id"))
query("expr_12_nvl", f"SELECT event_id, coalesce(v, -1) AS w, coalesce(e, 'none') AS x FROM ({_NULLS})")(
    lambda t: with_nulls(t).eval("w = nvl(v, -1.0); x = coalesce(e, 'none')").select("event_id", "w", "x")
)
query("expr_13_params", "SELECT o_orderkey FROM orders WHERE o_totalprice > 250000.5 AND o_orderstatus = 'P'")(
    lambda t: t.orders.query("o_totalprice > ${low} and o_orderstatus = ${s}", low=250000.5, s="P").select("o_orderkey")
)
query("expr_14_eval", "SELECT n_nationkey, n_regionkey * 10::DOUBLE AS a, n_regionkey * 10::DOUBLE + n_nationkey AS b FROM nation")(
    lambda t: t.nation.eval("a = n_regionkey * 10\nb = a + n_nationkey").select("n_nationkey", "a", "b")
)

# ---------------------------------------------------------------- joins

query("join_01_inner", "SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000")(
    lambda t: t.orders.query("o_totalprice > 300000").merge(t.customer, left_on="o_custkey", right_on="c_custkey").select("o_orderkey", "o_custkey", "c_name", "c_mktsegment")
)


def _keyed(t, table: str, key: str, keep, name: str = "k"):
    df = getattr(t, table).df
    return Frame(df.select(F.nullif(C(key) % keep, F.lit(0)).alias(name), C(key).alias("id")), "id")


query(
    "join_01_null_keys_and_suffixes",
    """SELECT l.k, l.id AS id_x, r.id AS id_y FROM (SELECT nullif(n_nationkey % 6, 0) AS k, n_nationkey AS id FROM nation) l
       JOIN (SELECT nullif(r_regionkey % 4, 0) AS k, r_regionkey AS id FROM region) r ON l.k IS NOT DISTINCT FROM r.k""",
)(lambda t: _keyed(t, "nation", "n_nationkey", 6).merge(_keyed(t, "region", "r_regionkey", 4), on="k"))
query("join_01_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")(
    lambda t: t.customer.merge(t.orders, "left", left_on="c_custkey", right_on="o_custkey").select("c_custkey", "o_orderkey")
)
query(
    "join_02_right",
    """SELECT r.k, l.id AS id_x, r.id AS id_y FROM (SELECT nullif(r_regionkey % 4, 0) AS k, r_regionkey AS id FROM region) l
       RIGHT JOIN (SELECT nullif(n_nationkey % 9, 0) AS k, n_nationkey AS id FROM nation) r ON l.k IS NOT DISTINCT FROM r.k""",
)(lambda t: _keyed(t, "region", "r_regionkey", 4).merge(_keyed(t, "nation", "n_nationkey", 9), "right", on="k"))
query(
    "join_03_outer",
    """SELECT coalesce(l.k, r.k) AS k, l.id AS id_x, r.id AS id_y FROM (SELECT nullif(n_nationkey % 13, 0) AS k, n_nationkey AS id FROM nation) l
       FULL JOIN (SELECT nullif(c_custkey % 17, 0) AS k, c_custkey AS id FROM customer) r ON l.k IS NOT DISTINCT FROM r.k""",
)(lambda t: _keyed(t, "nation", "n_nationkey", 13).astype("k", "long").merge(_keyed(t, "customer", "c_custkey", 17), "outer", on="k"))
query("join_07_join", "SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")(
    lambda t: t.nation.rename_columns({"n_regionkey": "r_regionkey"}).join(t.region, on="r_regionkey").select("n_name", "r_name")
)
query(
    "join_08_asof",
    """SELECT e.event_id, o.o_orderkey AS k FROM (SELECT event_id, ts - INTERVAL 9000 DAY AS t FROM events) e
       ASOF LEFT JOIN (SELECT o_orderkey, o_orderdate + o_orderkey * INTERVAL 1 SECOND AS t FROM orders) o ON e.t >= o.t""",
)(
    lambda t: Frame(t.events.df.select("event_id", (C("ts") - F.expr("INTERVAL 9000 DAYS")).alias("t")), "event_id")
    .merge_asof(Frame(t.orders.df.select((C("o_orderdate") + F.make_interval(secs=C("o_orderkey"))).alias("t"), C("o_orderkey").alias("k")), "k"), on="t")
    .select("event_id", "k")
)
query(
    "join_08_asof_by",
    """SELECT e.event_id, p.event_id AS prev, p.value AS prev_value FROM (SELECT * FROM events WHERE event_type = 'purchase') e
       ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') p ON e.user_id = p.user_id AND e.ts >= p.ts""",
)(
    lambda t: t.events.query("event_type = 'purchase'").select("event_id", "user_id", "ts")
    .merge_asof(Frame(t.events.query("event_type = 'click'").df.select("user_id", "ts", C("event_id").alias("prev"), C("value").alias("prev_value"))), on="ts", by="user_id")
    .select("event_id", "prev", "prev_value")
)
query("join_09_sql_on", "SELECT o.o_orderkey, c.c_name FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey")(
    lambda t: run_sql("SELECT o.o_orderkey, c.c_name FROM ${o} o LEFT JOIN ${c} c ON c.c_custkey = o.o_custkey", t.orders, t.customer)
)
query("join_10_on_residual", "SELECT o.o_orderkey, c.c_name FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 5000")(
    lambda t: run_sql("SELECT o.o_orderkey, c.c_name FROM ${o} o LEFT JOIN ${c} c ON o.o_custkey = c.c_custkey AND c.c_acctbal > 5000", t.orders, t.customer)
)
query("join_11_chain", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")(
    lambda t: run_sql(
        "SELECT c_custkey, n_name, r_name FROM ${c} c JOIN ${n} n ON c.c_nationkey = n.n_nationkey JOIN ${r} r ON n.n_regionkey = r.r_regionkey", t.customer, t.nation, t.region
    )
)
query("join_12_using", "SELECT n_name, r_name FROM (SELECT n_name, n_regionkey AS r_regionkey FROM nation) JOIN region USING (r_regionkey)")(
    lambda t: run_sql("SELECT n_name, r_name FROM ${n} n JOIN ${r} r USING (r_regionkey)", t.nation.rename_columns({"n_regionkey": "r_regionkey"}), t.region)
)
query("join_13_cross", "SELECT a.r_name AS r_name, b.r_name AS r_name_r FROM region a CROSS JOIN region b")(lambda t: run_sql("SELECT r_name, r_name_r FROM ${a} CROSS JOIN ${b}", t.region, t.region))
query("join_14_combine_first", "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END, value * 10) AS v FROM events")(
    lambda t: with_nulls(t).select("event_id", "v").combine_first(Frame(t.events.df.select("event_id", (C("value") * 10).alias("v")), "event_id"))
)
query("join_15_concat_columns", "SELECT n_nationkey, n_name, n_nationkey * 2 AS twice FROM nation")(
    lambda t: concat(t.nation.select("n_nationkey", "n_name"), Frame(t.nation.df.select((C("n_nationkey") * 2).alias("twice")), "twice"), axis=1)
)
query("join_16_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")(
    lambda t: t.customer.semi_join(t.orders.query("o_totalprice > 450000"), left_on="c_custkey", right_on="o_custkey").select("c_custkey")
)
query("join_16_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")(
    lambda t: t.customer.anti_join(t.orders, left_on="c_custkey", right_on="o_custkey").select("c_custkey")
)

# ---------------------------------------------------------------- aggregates

query(
    "agg_03_group_agg",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS l_quantity_sum, count(l_tax) AS l_tax_count, round(avg(l_discount), 4) AS l_discount_mean,
       min(l_extendedprice) AS l_extendedprice_min, max(l_extendedprice) AS l_extendedprice_max, count(DISTINCT l_suppkey) AS l_suppkey_nunique
       FROM lineitem GROUP BY 1, 2""",
)(lambda t: t.lineitem.group_by("l_returnflag", "l_linestatus").agg({"l_quantity": "sum", "l_tax": "count", "l_discount": "mean", "l_extendedprice": ["min", "max"], "l_suppkey": "nunique"}))
query("agg_01_null_groups", f"SELECT e, count(v) AS v_count, round(coalesce(sum(v), 0), 4) AS v_sum FROM ({_NULLS}) GROUP BY e")(lambda t: with_nulls(t).group_by("e").agg({"v": ["count", "sum"]}))
query("agg_06_sum_bool", "SELECT event_type, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END)::BIGINT AS big_sum FROM events GROUP BY 1")(
    lambda t: Frame(t.events.df.withColumn("big", C("value") > 50)).group_by("event_type").agg("big", "sum")
)
query("agg_06_sum_text", "SELECT n_regionkey, string_agg(n_name, '' ORDER BY n_nationkey) AS n_name_sum FROM nation GROUP BY 1")(lambda t: t.nation.group_by("n_regionkey").agg("n_name", "sum"))
query(
    "agg_09_first_last",
    f"SELECT e, arg_min(v, event_id) FILTER (v IS NOT NULL) AS v_first, arg_max(v, event_id) FILTER (v IS NOT NULL) AS v_last FROM ({_NULLS}) GROUP BY e",
)(lambda t: with_nulls(t).group_by("e").agg({"v": ["first", "last"]}))
query(
    "agg_10_median_std_var",
    "SELECT event_type, round(median(value), 4) AS value_median, round(stddev_samp(value), 4) AS value_std, round(var_samp(value), 4) AS value_var FROM events GROUP BY 1",
)(lambda t: t.events.group_by("event_type").agg({"value": ["median", "std", "var"]}))
query("agg_11_size", "SELECT o_orderstatus, o_orderpriority, count(*) AS size FROM orders GROUP BY 1, 2")(lambda t: t.orders.group_by("o_orderstatus", "o_orderpriority").size())
query("agg_12_group_filter", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING sum(o_totalprice) > 3000000)")(
    lambda t: t.orders.group_by("o_custkey").filter("o_totalprice", "sum", lambda c: c > 3000000).select("o_orderkey")
)
query("agg_13_transform", "SELECT n_nationkey, max(n_nationkey) OVER (PARTITION BY n_regionkey)::DOUBLE AS m FROM nation")(
    lambda t: t.nation.group_by("n_regionkey").transform("n_nationkey", "max", "m").select("n_nationkey", "m")
)
query("agg_14_apply_groups", "SELECT event_type, max(value) - min(value) AS spread FROM events GROUP BY 1")(
    lambda t: t.events.group_by("event_type").apply(
        lambda p: p.groupby("event_type", as_index=False).agg(spread=("value", lambda v: v.max() - v.min())), "event_type string, spread double"
    )
)
query(
    "agg_16_column_stats",
    f"""SELECT round(coalesce(sum(v), 0), 4) AS v_sum, round(avg(v), 4) AS v_mean, round(stddev_samp(v), 4) AS v_std, min(v) AS v_min, max(v) AS v_max,
        round(median(v), 4) AS v_median, count(v) AS v_count, round(var_samp(v), 4) AS v_var FROM ({_NULLS})""",
)(lambda t: with_nulls(t).summary({"v": ["sum", "mean", "std", "min", "max", "median", "count", "var"]}))
query("agg_18_quantile", "SELECT round(quantile_cont(value, 0.95), 4) AS q FROM events")(lambda t: t.events.df.agg(t.events.stat("value", "quantile", 0.95).alias("q")))
# Over the whole table; about the mean tax, so that the product stays small at every size.
query("agg_19_product_whole", "SELECT round(product(1 + (l_tax - 0.04) / 1000), 4) AS p FROM lineitem")(
    lambda t: (f := t.lineitem.eval("x = 1 + (l_tax - 0.04) / 1000")).df.agg(f.stat("x", "prod").alias("p"))
)
query("agg_20_nunique", "SELECT count(DISTINCT o_custkey) AS o_custkey, count(DISTINCT o_orderstatus) AS o_orderstatus FROM orders")(lambda t: t.orders.select("o_custkey", "o_orderstatus").col_nunique_df())
query("agg_22_skew_kurt", "SELECT round(skewness(o_totalprice), 4) AS s, round(kurtosis(o_totalprice), 4) AS k, round(stddev_samp(o_totalprice) / sqrt(count(o_totalprice)), 4) AS e FROM orders")(
    lambda t: t.orders.df.agg(t.orders.stat("o_totalprice", "skew").alias("s"), t.orders.stat("o_totalprice", "kurt").alias("k"), t.orders.stat("o_totalprice", "sem").alias("e"))
)
query("agg_24_mad", "SELECT round(avg(abs(value - (SELECT avg(value) FROM events))), 4) AS value_mad FROM events")(lambda t: t.events.mad_frame("value"))
query("agg_26_corr", "SELECT round(corr(l_quantity, l_extendedprice), 4) AS corr FROM lineitem")(lambda t: t.lineitem.corr_frame("l_quantity", "l_extendedprice"))
query(
    "agg_26_spearman",
    """SELECT round(corr(a, b), 4) AS corr FROM (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a,
       rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS b FROM lineitem)""",
)(lambda t: t.lineitem.corr_frame("l_quantity", "l_discount", "spearman"))
query(
    "agg_28_cov_matrix",
    """SELECT 'l_quantity' AS _index_, round(covar_samp(l_quantity, l_quantity), 4) AS l_quantity, round(covar_samp(l_quantity, l_tax), 4) AS l_tax FROM lineitem
       UNION ALL SELECT 'l_tax', round(covar_samp(l_tax, l_quantity), 4), round(covar_samp(l_tax, l_tax), 4) FROM lineitem""",
)(lambda t: t.lineitem.cov_matrix(["l_quantity", "l_tax"]))
query(
    "agg_28_corr_matrix",
    """SELECT 'l_quantity' AS _index_, 1.0::DOUBLE AS l_quantity, round(corr(l_quantity, l_tax), 4) AS l_tax FROM lineitem
       UNION ALL SELECT 'l_tax', round(corr(l_tax, l_quantity), 4), 1.0 FROM lineitem""",
)(lambda t: t.lineitem.corr_matrix(names=["l_quantity", "l_tax"]))
query(
    "agg_29_describe",
    """SELECT s.stat, round(CASE s.stat WHEN 'count' THEN c WHEN 'mean' THEN m WHEN 'std' THEN d WHEN 'min' THEN lo WHEN '25%' THEN q1 WHEN '50%' THEN q2
       WHEN '75%' THEN q3 ELSE hi END, 4) AS value FROM (VALUES ('count'), ('mean'), ('std'), ('min'), ('25%'), ('50%'), ('75%'), ('max')) s(stat),
       (SELECT count(value)::DOUBLE c, avg(value) m, stddev_samp(value) d, min(value) lo, max(value) hi, quantile_cont(value, 0.25) q1,
       quantile_cont(value, 0.5) q2, quantile_cont(value, 0.75) q3 FROM events)""",
)(lambda t: t.events.describe(["value"]))
query("agg_31_value_counts", "SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY 1")(lambda t: t.orders.col_value_counts("o_orderpriority"))
query("agg_30_mode", "SELECT p_brand, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, min(p_partkey) LIMIT 1")(lambda t: t.part.col_value_counts("p_brand").df.limit(1))
query("agg_35_rollup", "SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 4) AS o_totalprice_sum, grouping_id(o_orderstatus, o_orderpriority)::BIGINT AS grouping_id FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")(
    lambda t: t.orders.group_by("o_orderstatus", "o_orderpriority").rollup({"o_totalprice": "sum"})
)
query("agg_35_cube", "SELECT l_returnflag, l_linestatus, count(l_tax) AS l_tax_count, grouping_id(l_returnflag, l_linestatus)::BIGINT AS grouping_id FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")(
    lambda t: t.lineitem.group_by("l_returnflag", "l_linestatus").cube({"l_tax": "count"})
)
query("agg_35_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1")(lambda t: run_sql("SELECT l_returnflag, count(DISTINCT l_partkey) AS n FROM ${l} GROUP BY l_returnflag", t.lineitem))

# ---------------------------------------------------------------- order-dependent functions

for _method, _rank in {
    "average": "rank() OVER w + (count(*) OVER (PARTITION BY v) - 1) / 2.0",
    "min": "rank() OVER w",
    "max": "rank() OVER w + count(*) OVER (PARTITION BY v) - 1",
    "dense": "dense_rank() OVER w",
    "first": "row_number() OVER (ORDER BY v, event_id)",
}.items():
    query(f"win_01_rank_{_method}", f"SELECT event_id, CASE WHEN v IS NOT NULL THEN ({_rank})::DOUBLE END AS r FROM ({_NULLS}) WINDOW w AS (ORDER BY v)")(
        lambda t, m=_method: with_nulls(t).col_rank("v", m, "r").select("event_id", "r")
    )
query("win_02_rank_text", f"SELECT event_id, CASE WHEN e IS NOT NULL THEN dense_rank() OVER (ORDER BY e)::DOUBLE END AS r FROM ({_NULLS})")(lambda t: with_nulls(t).col_rank("e", "dense", "r").select("event_id", "r"))
query("win_03_cumsum", f"SELECT event_id, CASE WHEN v IS NOT NULL THEN round(sum(v) OVER (ORDER BY event_id), 4) END AS c FROM ({_NULLS})")(lambda t: with_nulls(t).col_cumsum("v", "c").select("event_id", "c"))
query("win_03_cumprod", "SELECT n_nationkey, round(exp(sum(ln(1 + n_regionkey / 10.0)) OVER (ORDER BY n_nationkey)), 2) AS c FROM nation", digits=2)(
    lambda t: t.nation.eval("x = 1 + n_regionkey / 10").col_cumprod("x", "c").select("n_nationkey", "c")
)
query("win_03_cummax_cummin", f"SELECT event_id, CASE WHEN v IS NOT NULL THEN max(v) OVER w END AS a, CASE WHEN v IS NOT NULL THEN min(v) OVER w END AS b FROM ({_NULLS}) WINDOW w AS (ORDER BY event_id)")(
    lambda t: with_nulls(t).col_cummax("v", "a").col_cummin("v", "b").select("event_id", "a", "b")
)
query("win_03_cumsum_partitioned", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 4) AS c FROM orders")(
    lambda t: t.orders.col_cumsum("o_totalprice", "c", partition_by="o_custkey").select("o_orderkey", "c")
)
query("win_04_diff", "SELECT event_id, round(value - lag(value, 2) OVER (ORDER BY event_id), 4) AS d, round(value - lead(value) OVER (ORDER BY event_id), 4) AS e FROM events")(
    lambda t: t.events.col_diff("value", 2, "d").col_diff("value", -1, "e").select("event_id", "d", "e")
)
query("win_05_pct_change", "SELECT event_id, round((value - lag(value) OVER (ORDER BY event_id)) / nullif(lag(value) OVER (ORDER BY event_id), 0), 4) AS p FROM events")(
    lambda t: t.events.col_pct_change("value", 1, "p").select("event_id", "p")
)
query("win_06_shift", "SELECT event_id, lag(value, 3) OVER (ORDER BY event_id) AS s FROM events")(lambda t: t.events.shift("value", 3, "s").select("event_id", "s"))
for _fn in ("mean", "sum", "min", "max", "std", "count"):
    _call = {"mean": "avg(v)", "std": "stddev_samp(v)", "count": "count(v)::DOUBLE"}.get(_fn, f"{_fn}(v)")
    _over = _call.replace("::DOUBLE", " OVER w::DOUBLE") if _fn == "count" else f"{_call} OVER w"
    query(f"win_07_rolling_{_fn}", f"SELECT event_id, CASE WHEN count(v) OVER w >= 3 THEN round({'(count(v) OVER w)::DOUBLE' if _fn == 'count' else _over}, 4) END AS r FROM ({_NULLS}) WINDOW w AS (ORDER BY event_id ROWS 4 PRECEDING)")(
        lambda t, f=_fn: getattr(with_nulls(t).rolling("v", 5, 3), f)("r").select("event_id", "r")
    )
query("win_09_expanding", f"SELECT event_id, round(sum(v) OVER w, 4) AS a, max(v) OVER w AS b FROM ({_NULLS}) WINDOW w AS (ORDER BY event_id)")(
    lambda t: with_nulls(t).expanding("v").sum("a").expanding("v").max("b").select("event_id", "a", "b")
)
query(
    "win_10_ewm_mean",
    """WITH RECURSIVE r AS (SELECT n_nationkey AS k, n_regionkey::DOUBLE AS m FROM nation WHERE n_nationkey = 0
       UNION ALL SELECT n.n_nationkey, 0.3::DOUBLE * n.n_regionkey + 0.7::DOUBLE * r.m FROM r JOIN nation n ON n.n_nationkey = r.k + 1)
       SELECT k AS n_nationkey, round(m, 4) AS m FROM r""",
)(lambda t: t.nation.ewm("n_regionkey", 0.3).mean("m").select("n_nationkey", "m"))
query("win_11_ewm_std")(lambda t: t.events.ewm("value", 0.2, partition_by="event_type").std("s").select("event_id", "s"))
query("win_12_ffill", f"SELECT event_id, last_value(v IGNORE NULLS) OVER (ORDER BY event_id) AS v, last_value(e IGNORE NULLS) OVER (ORDER BY event_id) AS e FROM ({_NULLS})")(lambda t: with_nulls(t).drop("ts").ffill())
query("win_13_bfill", f"SELECT event_id, first_value(v IGNORE NULLS) OVER w AS v, first_value(e IGNORE NULLS) OVER w AS e FROM ({_NULLS}) WINDOW w AS (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")(
    lambda t: with_nulls(t).drop("ts").bfill()
)
query(
    "win_14_interpolate",
    f"""SELECT event_id, round(coalesce(v, pv + (nv - pv) * (event_id - pi) / (ni - pi)), 4) AS v FROM (SELECT event_id, v,
        last_value(v IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER b AS pi,
        first_value(v IGNORE NULLS) OVER f AS nv, first_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER f AS ni FROM ({_NULLS})
        WINDOW b AS (ORDER BY event_id), f AS (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
)(lambda t: with_nulls(t).select("event_id", "v").interpolate("v"))
query("win_15_duplicated", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) > 1 AS d, count(*) OVER (PARTITION BY o_custkey) > 1 AS a FROM orders")(
    lambda t: t.orders.duplicated("o_custkey", "first", "d").duplicated("o_custkey", "none", "a").select("o_orderkey", "d", "a")
)
query("win_16_sql_windows", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM orders")(
    lambda t: run_sql(
        "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM ${o}", t.orders
    )
)

# ---------------------------------------------------------------- sort, top-k, duplicates, sets

query("sort_01_sort_by_whole", f"SELECT event_id, v, e FROM ({_NULLS}) ORDER BY e DESC NULLS LAST, v NULLS LAST, event_id")(
    lambda t: with_nulls(t).sort_by(["e", "v"], [False, True]).select("event_id", "v", "e")
)
query("sort_04_sort_indices", "SELECT n_nationkey::BIGINT AS position FROM nation")(lambda t: t.nation.sort_indices("n_name", False))
query("sort_05_nlargest", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")(lambda t: t.orders.nlargest(15, "o_totalprice"))
query("sort_05_nsmallest", "SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 15")(lambda t: t.orders.nsmallest(15, "o_totalprice"))
query("sort_05_top_k_per_group", "SELECT o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 3")(
    lambda t: t.orders.top_k_by(["o_orderpriority"], 3, "o_totalprice").select("o_orderkey")
)
query("sort_06_drop_duplicates_first", "SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) = 1")(lambda t: t.orders.drop_duplicates(["o_custkey", "o_orderstatus"]))
query("sort_06_drop_duplicates_last", "SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")(lambda t: t.orders.drop_duplicates("o_custkey", keep="last"))
query("sort_06_drop_duplicates_none", "SELECT * FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) = 1")(lambda t: t.orders.drop_duplicates("o_custkey", keep="none"))
query("sort_08_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")(
    lambda t: run_sql("SELECT o_orderkey, o_totalprice FROM ${o} ORDER BY o_totalprice DESC, o_orderkey OFFSET 5 ROWS FETCH FIRST 10 ROWS ONLY", t.orders)
)
query("sort_09_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")(lambda t: run_sql("SELECT DISTINCT o_orderstatus, o_orderpriority FROM ${o}", t.orders))
query("set_01_concat", "SELECT n_nationkey::BIGINT AS k, n_name AS name, NULL::DOUBLE AS bal FROM nation UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer")(
    lambda t: concat(
        t.nation.rename_columns({"n_nationkey": "k", "n_name": "name"}).drop("n_regionkey"),
        t.customer.rename_columns({"c_custkey": "k", "c_name": "name", "c_acctbal": "bal"}).select("bal", "name", "k"),
    )
)
query("set_02_union_all", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")(lambda t: run_sql("SELECT n_nationkey AS k FROM ${n} UNION ALL SELECT r_regionkey AS k FROM ${r}", t.nation, t.region))
query("set_03_union", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region")(lambda t: run_sql("SELECT n_regionkey AS k FROM ${n} UNION SELECT r_regionkey AS k FROM ${r}", t.nation, t.region))
query("set_04_intersect", "SELECT n_nationkey AS k FROM nation INTERSECT SELECT r_regionkey FROM region")(lambda t: run_sql("SELECT n_nationkey AS k FROM ${n} INTERSECT SELECT r_regionkey AS k FROM ${r}", t.nation, t.region))
query("set_05_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT r_regionkey FROM region")(lambda t: run_sql("SELECT n_nationkey AS k FROM ${n} MINUS SELECT r_regionkey AS k FROM ${r}", t.nation, t.region))
query("set_06_left_fold", "(SELECT n_nationkey AS k FROM nation UNION SELECT 100) INTERSECT SELECT r_regionkey FROM region")(
    lambda t: run_sql("SELECT n_nationkey AS k FROM ${n} UNION SELECT 100 AS k FROM DUAL INTERSECT SELECT r_regionkey AS k FROM ${r}", t.nation, t.region)
)
query("set_07_all", "SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT r_regionkey FROM region")(lambda t: t.nation.select("n_regionkey").rename_columns({"n_regionkey": "k"}).except_all(t.region.select("r_regionkey")))

# ---------------------------------------------------------------- missing data, reshaping

query("na_01_isna", f"SELECT event_id IS NULL AS event_id, v IS NULL AS v, e IS NULL AS e FROM ({_NULLS})")(lambda t: with_nulls(t).drop("ts").isna())
query("na_01_notna", f"SELECT event_id IS NOT NULL AS event_id, v IS NOT NULL AS v, e IS NOT NULL AS e FROM ({_NULLS})")(lambda t: with_nulls(t).drop("ts").notna())
query("na_02_dropna_any", f"SELECT * FROM ({_NULLS}) WHERE v IS NOT NULL AND e IS NOT NULL")(lambda t: with_nulls(t).drop("ts").dropna())
query("na_02_dropna_all", f"SELECT event_id FROM ({_NULLS}) WHERE v IS NOT NULL OR e IS NOT NULL")(lambda t: with_nulls(t).dropna("all", ["v", "e"]).select("event_id"))
query("na_04_fillna_map", f"SELECT event_id, coalesce(v, 0.5) AS v, coalesce(e, '?') AS e FROM ({_NULLS})")(lambda t: with_nulls(t).drop("ts").fillna({"v": 0.5, "e": "?"}))
query("na_03_fillna", f"SELECT coalesce(e, '7') AS e FROM ({_NULLS})")(lambda t: with_nulls(t).select("e").fillna(7))
query("rsh_01_pivot_table", "SELECT l_returnflag, round(sum(l_quantity) FILTER (l_linestatus = 'F'), 4) AS F, round(sum(l_quantity) FILTER (l_linestatus = 'O'), 4) AS O FROM lineitem GROUP BY 1")(
    lambda t: t.lineitem.pivot_table("l_returnflag", "l_linestatus", "l_quantity", "sum")
)
query("rsh_01_pivot_count", "SELECT o_orderstatus, count(o_orderkey) FILTER (o_orderpriority = '1-URGENT') AS \"1-URGENT\", count(o_orderkey) FILTER (o_orderpriority = '5-LOW') AS \"5-LOW\" FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY 1")(
    lambda t: t.orders.query("o_orderpriority in ('1-URGENT', '5-LOW')").pivot_table("o_orderstatus", "o_orderpriority", "o_orderkey", "count")
)
query("rsh_02_pivot_whole", "SELECT n_nationkey, " + ", ".join(f'max(n_name) FILTER (n_regionkey = {i}) AS "{i}"' for i in range(5)) + " FROM nation GROUP BY 1")(
    lambda t: t.nation.pivot("n_nationkey", "n_regionkey", "n_name")
)
query("rsh_03_melt", "SELECT s_suppkey, 'n' AS variable, s_nationkey::DOUBLE AS value FROM supplier UNION ALL SELECT s_suppkey, 's_acctbal', s_acctbal FROM supplier")(
    lambda t: t.supplier.rename_columns({"s_nationkey": "n"}).melt(["s_suppkey"], ["n", "s_acctbal"])
)
query("rsh_05_transpose", "SELECT 'r_regionkey' AS _index, '0' AS \"0\", '1' AS \"1\", '2' AS \"2\", '3' AS \"3\", '4' AS \"4\" UNION ALL SELECT 'r_name', max(r_name) FILTER (r_regionkey = 0), max(r_name) FILTER (r_regionkey = 1), max(r_name) FILTER (r_regionkey = 2), max(r_name) FILTER (r_regionkey = 3), max(r_name) FILTER (r_regionkey = 4) FROM region")(
    lambda t: t.region.transpose()
)
query("rsh_06_explode_whole", "SELECT vec_id, unnest(embedding) AS x FROM embeddings")(lambda t: Frame(t.embeddings.df.select("vec_id", C("embedding").alias("x"))).explode("x"))

# ---------------------------------------------------------------- scalar functions

query("math_01_column_arithmetic", "SELECT p_partkey, round(p_retailprice + p_size, 4) AS a, round(p_retailprice - p_size, 4) AS s, round(p_retailprice * p_size, 4) AS m, round(p_retailprice / p_size, 4) AS d FROM part")(
    lambda t: t.part.col_add("a", "p_retailprice", "p_size").col_sub("s", "p_retailprice", "p_size").col_mul("m", "p_retailprice", "p_size").col_div("d", "p_retailprice", "p_size").select("p_partkey", "a", "s", "m", "d")
)
query("math_03_scalar_all", "SELECT n_nationkey, n_regionkey, n_nationkey * 3.0::DOUBLE AS n_nationkey_mul, n_regionkey * 3.0::DOUBLE AS n_regionkey_mul FROM nation")(lambda t: t.nation.drop("n_name").mul_scalar_all_columns(3))
query("math_04_abs", "SELECT s_suppkey, abs(s_acctbal - 5000) AS x FROM supplier")(lambda t: t.supplier.eval("x = s_acctbal - 5000").select("s_suppkey", "x").abs())
query("math_05_clip", "SELECT event_id, least(greatest(value, 10), 60) AS value_clip FROM events")(lambda t: t.events.col_clip("value", 10, 60).select("event_id", "value_clip"))
query("math_06_round", "SELECT event_id, round_even(value, 1) AS r FROM events")(lambda t: t.events.col_round("value", 1, "r").select("event_id", "r"))
query(
    "str_01_text",
    """SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, contains(p_name, 'ring') AS c, starts_with(p_name, 'red') AS s, ends_with(p_name, 'et') AS e,
       replace(p_name, ' ', '_') AS r, length(p_name) AS n FROM part""",
)(
    lambda t: (lambda f, s, b: f.assign(u=s.upper(), l=b.lower(), c=s.contains("ring"), s=s.starts_with("red"), e=s.ends_with("et"), r=s.replace(" ", "_"), n=s.length()))(
        t.part, t.part.str("p_name"), t.part.str("p_brand")
    ).select("p_partkey", "u", "l", "c", "s", "e", "r", "n")
)
query(
    "str_04_more_text",
    """SELECT p_partkey, repeat(p_type, 2) AS rp, substr(p_name, 2, 3) AS sl, CASE WHEN length(p_brand) >= 10 THEN p_brand ELSE lpad(p_brand, 10, '*') END AS pl,
       regexp_replace(p_name, '[aeiou]', '#', 'g') AS rx, regexp_matches(p_brand, '#1[0-9]') AS m, lower(p_type) = 'economy' AS q FROM part""",
)(
    lambda t: (lambda f, n, b, y: f.assign(rp=y.repeat(2), sl=n.slice(1, 4), pl=b.pad_left(10, "*"), rx=n.replace_regex("[aeiou]", "#"), m=b.contains_regex("#1[0-9]"), q=y.equals_ignore_case("Economy")))(
        t.part, t.part.str("p_name"), t.part.str("p_brand"), t.part.str("p_type")
    ).select("p_partkey", "rp", "sl", "pl", "rx", "m", "q")
)
query(
    "date_01_parts",
    """SELECT event_id, year(ts)::DOUBLE AS y, month(ts)::DOUBLE AS mo, day(ts)::DOUBLE AS d, hour(ts)::DOUBLE AS h, minute(ts)::DOUBLE AS mi,
       second(ts)::DOUBLE AS s, isodow(ts)::DOUBLE AS w, dayofyear(ts)::DOUBLE AS j FROM events""",
)(
    lambda t: (lambda f, x: f.assign(y=x.year(), mo=x.month(), d=x.day(), h=x.hour(), mi=x.minute(), s=x.second(), w=x.day_of_week(), j=x.day_of_year()))(t.events, t.events.dt("ts")).select(
        "event_id", "y", "mo", "d", "h", "mi", "s", "w", "j"
    )
)
query("date_02_zones", "SELECT event_id, ts - INTERVAL 8 HOUR AS utc, ts - INTERVAL 3 HOUR AS karachi FROM events")(
    lambda t: t.events.select("event_id", "ts").tz_localize("ts", "Asia/Shanghai").tz_convert("ts", "Asia/Karachi").tz_text("ts", "karachi").rename_columns({"ts": "utc"})
)

# ---------------------------------------------------------------- time series

_BIN = "floor((epoch_us(ts) - s) / 3600000000.0)::BIGINT"
_HOURS = """SELECT make_timestamp((s + g.i * 3600000000)::BIGINT) AS _bucket_, {cols} FROM (SELECT unnest(range((max(epoch_us(ts)) - min(epoch_us(ts))) // 3600000000 + 1)) AS i FROM events) g
    CROSS JOIN (SELECT min(epoch_us(ts)) AS s FROM events) LEFT JOIN (SELECT """ + _BIN + """ AS b, {aggs} FROM events, (SELECT min(epoch_us(ts)) AS s FROM events) GROUP BY 1) a ON a.b = g.i"""
query("ts_04_resample_mean", _HOURS.format(cols="value_mean", aggs="round(avg(value), 4) AS value_mean"))(lambda t: t.events.resample("ts", "1h").mean("value"))
query("ts_03_resample_all", _HOURS.format(cols="event_id_sum, user_id_sum, value_sum", aggs="sum(event_id)::BIGINT AS event_id_sum, sum(user_id)::BIGINT AS user_id_sum, round(sum(value), 4) AS value_sum"))(
    lambda t: t.events.resample("ts", "1h").sum()
)
query("ts_05_resample_agg", _HOURS.format(cols="count_value, std_value, last_user_id", aggs="count(value) AS count_value, round(stddev_samp(value), 4) AS std_value, arg_max(user_id, ts) AS last_user_id"))(
    lambda t: Frame(t.events.resample("ts", "1h").agg({"value": "count"}).df.join(t.events.resample("ts", "1h").agg({"value": "std", "user_id": "last"}).df, "_bucket_"))
)
query("ts_06_ohlc", _HOURS.format(cols="value_open, value_high, value_low, value_close", aggs="arg_min(value, ts) AS value_open, max(value) AS value_high, min(value) AS value_low, arg_max(value, ts) AS value_close"))(
    lambda t: t.events.resample("ts", "1h").ohlc("value")
)
query(
    "ts_01_resample_months",
    """SELECT m AS _bucket_, round(avg(o_totalprice), 4) AS o_totalprice_mean FROM (SELECT unnest(generate_series((SELECT date_trunc('month', min(o_orderdate)) FROM orders),
       (SELECT max(o_orderdate) FROM orders), INTERVAL 1 MONTH))::TIMESTAMP AS m) LEFT JOIN orders ON date_trunc('month', o_orderdate) = m GROUP BY 1""",
)(lambda t: t.orders.resample("o_orderdate", "1MS").mean("o_totalprice"))

# ---------------------------------------------------------------- SQL

query("sql_01_select_list_whole", "SELECT o_orderkey, o_totalprice * 2.0 AS twice, o_orderstatus AS st FROM orders")(
    lambda t: run_sql("SELECT o_orderkey, o_totalprice * 2 AS twice, o_orderstatus AS st FROM this", this=t.orders)
)
query("sql_05_aggregates", "SELECT o_orderstatus, round(avg(o_totalprice), 4) AS avg_o_totalprice, round(median(o_totalprice), 4) AS med, round(stddev_samp(o_totalprice), 4) AS sd, count(DISTINCT o_custkey) AS nunique_o_custkey FROM orders GROUP BY 1")(
    lambda t: run_sql("SELECT o_orderstatus, avg(o_totalprice), median(o_totalprice) AS med, std(o_totalprice) AS sd, nunique(o_custkey) FROM ${o} GROUP BY o_orderstatus", t.orders)
)
query("sql_07_global", "SELECT count(*) AS n, round(sum(o_totalprice), 4) AS s FROM orders WHERE o_orderkey < 0 OR o_orderstatus = 'F'")(
    lambda t: run_sql("SELECT count(*) AS n, sum(o_totalprice) AS s FROM ${o} WHERE o_orderkey < 0 OR o_orderstatus = 'F'", t.orders)
)
query("sql_08_having", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 4) AS total FROM orders GROUP BY 1 HAVING count(*) > 15 AND sum(o_totalprice) > 3000000")(
    lambda t: run_sql("SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM ${o} GROUP BY o_custkey HAVING n > 15 AND total > 3000000 ORDER BY total DESC", t.orders)
)
query("sql_10_scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")(
    lambda t: run_sql("SELECT o_orderkey FROM ${o} WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 AS x FROM ${o})", t.orders)
)
query("sql_10_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 480000) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice < 2000)")(
    lambda t: run_sql(
        "SELECT c_custkey FROM ${c} WHERE c_custkey IN (SELECT o_custkey FROM ${o} WHERE o_totalprice > 480000) AND c_custkey NOT IN (SELECT o_custkey FROM ${o} WHERE o_totalprice < 2000)",
        t.customer, t.orders,
    )
)
query("sql_10_in_subquery_or", "SELECT c_custkey FROM customer WHERE c_acctbal > 9000 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 480000)")(
    lambda t: run_sql("SELECT c_custkey FROM ${c} WHERE c_acctbal > 9000 OR c_custkey IN (SELECT o_custkey FROM ${o} WHERE o_totalprice > 480000)", t.customer, t.orders)
)
query("sql_11_cte", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 300000) SELECT o_custkey, count(*) AS n FROM big GROUP BY 1")(
    lambda t: run_sql("WITH big AS (SELECT o_custkey, o_totalprice FROM ${o} WHERE o_totalprice > 300000) SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey", t.orders)
)
query("sql_12_derived", "SELECT o_orderstatus, max(n)::DOUBLE AS m FROM (SELECT o_orderstatus, o_custkey, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")(
    lambda t: run_sql("SELECT o_orderstatus, max(n) AS m FROM (SELECT o_orderstatus, o_custkey, count(*) AS n FROM ${o} GROUP BY o_orderstatus, o_custkey) x GROUP BY o_orderstatus", t.orders)
)
query("sql_13_case", "SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'a' ELSE CASE WHEN o_totalprice > 200000 THEN 'b' ELSE 'c' END END AS g FROM orders")(
    lambda t: run_sql("SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'a' WHEN o_totalprice > 200000 THEN 'b' ELSE 'c' END AS g FROM ${o}", t.orders)
)
query("sql_14_rownum", "SELECT count(*) AS n FROM (SELECT * FROM orders LIMIT 25)")(lambda t: run_sql("SELECT count(*) AS n FROM (SELECT o_orderkey FROM ${o} WHERE ROWNUM <= 25) x", t.orders))
query("sql_15_insert", "SELECT * FROM region UNION ALL SELECT 5, 'ATLANTIS' UNION ALL SELECT 6, NULL")(lambda t: t.region.update("INSERT INTO this (r_regionkey, r_name) VALUES (5, 'ATLANTIS'), (6, null)")[0])
query("sql_16_update", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN n_name || '!' ELSE n_name END AS n_name, CASE WHEN n_regionkey = 1 THEN 10 ELSE n_regionkey END AS n_regionkey FROM nation")(
    lambda t: t.nation.update("UPDATE this SET n_name = n_name + '!', n_regionkey = n_regionkey * 10 WHERE n_regionkey = 1")[0]
)
query("sql_17_delete", "SELECT * FROM nation WHERE NOT (n_regionkey = 2 OR n_name LIKE '%1%')")(lambda t: t.nation.update("DELETE FROM this WHERE n_regionkey = 2 OR n_name LIKE '%1%'")[0])

# ---------------------------------------------------------------- Python functions, arrays, plots

query("udf_01_apply_numeric", "SELECT n_nationkey, n_regionkey * 2::DOUBLE + 1 AS y FROM nation")(lambda t: t.nation.apply_numeric("n_regionkey", lambda x: 2 * x + 1, "y").select("n_nationkey", "y"))
query("udf_02_apply_str", "SELECT n_nationkey, reverse(n_name) AS y FROM nation")(lambda t: t.nation.apply_str("n_name", lambda s: s[::-1], "y").select("n_nationkey", "y"))
query("udf_03_apply_row", "SELECT n_nationkey, (n_nationkey + n_regionkey)::DOUBLE AS y FROM nation")(lambda t: t.nation.apply_row("y", lambda r: float(r[0] + r[2])).select("n_nationkey", "y"))
query("udf_04_by_row", "SELECT n_nationkey, (row_number() OVER (ORDER BY n_nationkey) - 1) * 1.5::DOUBLE AS y FROM nation")(lambda t: t.nation.assign_by_row("y", lambda i: i * 1.5).select("n_nationkey", "y"))
query("num_08_linear_fit", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 4) AS r2 FROM lineitem")(
    lambda t: t.lineitem.linear_fit("l_quantity", "l_extendedprice")
)
query("viz_01_line", f"SELECT event_id::DOUBLE AS event_id, v FROM ({_NULLS}) WHERE v IS NOT NULL")(lambda t: with_nulls(t).plot.line("event_id", "v"))
query(
    "viz_03_hist",
    """WITH e AS (SELECT min(value) lo, (max(value) - min(value)) / 10 w FROM events) SELECT b.i AS bin, round(lo + b.i * w, 4) AS left, round(lo + (b.i + 1) * w, 4) AS right,
       count(value) AS count FROM range(10) b(i) CROSS JOIN e LEFT JOIN events ON least(floor((value - lo) / w), 9) = b.i GROUP BY b.i, lo, w""",
)(lambda t: t.events.plot.hist("value", 10))
query("viz_04_box", "SELECT event_type, min(value) AS min, round(median(value), 4) AS median, max(value) AS max FROM events GROUP BY 1")(lambda t: t.events.plot.box("value", "event_type"))
query(
    "viz_07_autocorrelation",
    """WITH x AS (SELECT value, avg(value) OVER () m, var_pop(value) OVER () v, lead(value, 1) OVER w AS a, lead(value, 2) OVER w AS b FROM events WINDOW w AS (ORDER BY event_id))
       SELECT 0 AS lag, 1.0::DOUBLE AS r UNION ALL SELECT 1, round(avg((value - m) * (a - m)) / max(v), 4) FROM x UNION ALL SELECT 2, round(avg((value - m) * (b - m)) / max(v), 4) FROM x""",
)(lambda t: t.events.plot.autocorrelation("value", 2))
query("viz_07_lag_plot", "SELECT value AS x, y FROM (SELECT value, lead(value, 3) OVER (ORDER BY event_id) AS y FROM events) WHERE y IS NOT NULL")(lambda t: t.events.plot.lag_plot("value", 3))

# ---------------------------------------------------------------- sources and sinks, arrays, streams


def _round_trip(t: Tables, frame: Frame, suffix: str, **options) -> Frame:
    """Written to a scratch folder and read back."""
    from loomframe.sources.dispatch import read, write
    from loomframe.functions.scratch import scratch

    path = f"{scratch(t.spark, 'io')}.{suffix}"
    write(frame, path)
    return read(t.spark, path, **options)


query("src_03_csv", "SELECT * FROM customer")(lambda t: _round_trip(t, t.customer, "csv", schema=t.customer.df.schema))
query("src_05_tsv", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")(lambda t: _round_trip(t, t.supplier, "tsv"))
query("src_07_json", "SELECT * FROM part")(lambda t: _round_trip(t, t.part, "json", lines=True, schema=t.part.df.schema))
query("src_07_json_split", "SELECT n_nationkey, n_name, n_regionkey FROM nation")(lambda t: _json_split(t))
query("src_09_json_normalize_whole", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")(lambda t: _normalized(t))
query("src_10_excel", "SELECT n_nationkey, n_name, n_regionkey FROM nation")(lambda t: _round_trip(t, t.nation, "xlsx"))
query("src_13_html", "SELECT n_nationkey, n_name, n_regionkey FROM nation")(lambda t: _round_trip(t, t.nation, "html"))
query("src_15_xml", "SELECT r_name, r_regionkey::BIGINT AS r_regionkey FROM region")(lambda t: _round_trip(t, t.region, "xml"))
query("src_17_parquet", "SELECT * FROM orders WHERE o_totalprice > 200000")(lambda t: _round_trip(t, t.orders, "parquet").query("o_totalprice > 200000"))
query("src_19_orc", "SELECT * FROM customer")(lambda t: _round_trip(t, t.customer, "orc"))
query("src_21_container", "SELECT * FROM nation")(lambda t: _round_trip(t, t.nation, "jpk"))
query("num_05_legacy_percentile", "SELECT n_regionkey, quantile_cont(n_nationkey, 0.5) AS p FROM nation GROUP BY 1")(
    lambda t: t.nation.df.groupBy("n_regionkey").agg(_arrays().percentile(C("n_nationkey"), 50).alias("p"))
)
query("num_03_logic", f"SELECT event_id, CASE WHEN v IS NOT NULL AND e IS NOT NULL THEN v > 50 AND e = 'view' END AS x FROM ({_NULLS})")(
    lambda t: (lambda f: f.df.select("event_id", _arrays().logical("and", F.nanvl("v", F.lit(None)) > 50, C("e") == "view").alias("x")))(with_nulls(t))
)
query("strm_01_tumbling", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")(lambda t: _tumbling(t))


def _arrays():
    from loomframe.functions import arrays

    return arrays


def _scratch(t: Tables, name: str) -> str:
    from loomframe.functions.scratch import scratch

    return f"{scratch(t.spark, 'io')}-{name}"


def _json_split(t: Tables):
    from loomframe.sources.jsons import read_json, write_json

    path = _scratch(t, "split.json")
    write_json(t.nation, path, "split")
    return read_json(t.spark, path, "split")


def _normalized(t: Tables):
    from loomframe.sources.jsons import json_normalize

    rows = t.events.df.select(F.to_json(F.struct("event_id", F.from_json("props", "k bigint").alias("p"))).alias("v"))
    return json_normalize(rows, "v", schema="event_id bigint, p struct<k: bigint>").rename_columns({"p.k": "k"})


def _tumbling(t: Tables):
    """A stream over the events file, to its end; complete windows are taken from the last batch."""
    from loomframe.functions.scratch import scratch
    from loomframe.streaming import windows as S

    stream = S.event_stream(t.spark, t.dir, "events.parquet", t.events.df.schema)
    made = S.windowed(stream, "ts", "1 day", None, ["event_type"], "1 hour", n=F.count("*"), total=F.sum("value"))
    out = S.run_to_batches(made, scratch(t.spark, "sink"), scratch(t.spark, "state"))
    return out.select(C("start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")
