"""The SQL dialect: clauses, names, binding, and its errors."""

import pytest

from loomframe import frame, sql
from loomframe.functions.values import FrameError


@pytest.fixture(scope="module")
def emp(spark):
    return frame({"name": ["ann", "bob", "cyd", "dan", "eve", "fay"], "dept_id": [1, 1, 2, 3, 2, 9], "pay": [10, 20, 30, 40, 50, 60]}, spark=spark).drop("__pos__")


@pytest.fixture(scope="module")
def dept(spark):
    return frame({"dept_id": [1, 2, 3, 4], "dept": ["it", "hr", "ops", "law"]}, spark=spark).drop("__pos__")


def rows(f):
    return [tuple(r) for r in f.df.collect()]


def test_joins(emp, dept):
    assert len(rows(sql("SELECT name, dept FROM ${e} e JOIN ${d} d ON e.dept_id = d.dept_id", emp, dept))) == 5
    left = rows(sql("SELECT e.name, d.dept FROM ${e} e LEFT JOIN ${d} d ON d.dept_id = e.dept_id", emp, dept))
    assert len(left) == 6 and ("fay", None) in left
    assert len(rows(sql("SELECT name FROM ${e} e LEFT JOIN ${d} d ON e.dept_id = d.dept_id AND d.dept = 'it'", emp, dept))) == 2
    assert len(rows(sql("SELECT * FROM ${e} CROSS JOIN ${d}", emp, dept))) == 24
    with pytest.raises(FrameError):
        sql("SELECT name FROM ${e} e JOIN ${d} d ON e.dept_id > d.dept_id", emp, dept)


def test_suffixed_columns_by_alias(emp):
    got = rows(sql("SELECT a.name AS x, b.name AS y FROM ${a} a JOIN ${b} b ON a.dept_id = b.dept_id WHERE a.pay < b.pay ORDER BY x", a=emp, b=emp))
    assert got == [("ann", "bob"), ("cyd", "eve")]


def test_groups_and_default_names(emp):
    out = sql("SELECT dept_id, sum(pay), count(*) FROM this GROUP BY dept_id HAVING sum_pay > 35 ORDER BY sum_pay DESC", this=emp)
    assert out.df.columns == ["dept_id", "sum_pay", "count_*"]
    assert rows(out) == [(2, 80.0, 2), (9, 60.0, 1), (3, 40.0, 1)]
    assert rows(sql("SELECT max(pay) - min(pay) AS spread, avg(pay) AS m FROM this", this=emp)) == [(50.0, 35.0)]
    with pytest.raises(FrameError):
        sql("SELECT name, sum(pay) FROM this", this=emp)


def test_order_by_a_column_that_is_left_out(emp):
    assert rows(sql("SELECT name FROM this ORDER BY pay DESC LIMIT 2", this=emp)) == [("fay",), ("eve",)]
    assert rows(sql("SELECT name, pay FROM this ORDER BY 2 LIMIT 1 OFFSET 1", this=emp)) == [("bob", 20)]
    assert rows(sql("SELECT name FROM this ORDER BY name OFFSET 4 ROWS FETCH NEXT 9 ROWS ONLY", this=emp)) == [("eve",), ("fay",)]


def test_subqueries(emp, dept):
    assert rows(sql("SELECT name FROM ${e} WHERE pay > (SELECT avg(pay) AS m FROM ${e}) AND dept_id IN (SELECT dept_id FROM ${d})", emp, dept)) == [("dan",), ("eve",)]
    assert rows(sql("SELECT name FROM ${e} WHERE dept_id NOT IN (SELECT dept_id FROM ${d}) OR pay = 10 ORDER BY name", emp, dept)) == [("ann",), ("fay",)]
    assert rows(sql("SELECT name FROM ${e} WHERE NOT (dept_id IN (SELECT dept_id FROM ${d})) OR pay = 10 ORDER BY name", emp, dept)) == [("ann",), ("fay",)]
    assert rows(sql("WITH rich AS (SELECT * FROM ${e} WHERE pay > 30), r2 AS (SELECT * FROM rich WHERE pay < 60) SELECT count(*) AS n FROM r2", e=emp)) == [(2,)]
    assert rows(sql("SELECT m FROM (SELECT dept_id, max(pay) AS m FROM this GROUP BY dept_id) x WHERE m > 45 ORDER BY m", this=emp)) == [(50.0,), (60.0,)]


def test_set_operations_fold_from_the_left(emp, dept):
    text = "SELECT dept_id FROM ${e} UNION SELECT dept_id FROM ${d} INTERSECT SELECT dept_id FROM ${e}"
    assert sorted(rows(sql(text, emp, dept))) == [(1,), (2,), (3,), (9,)]
    assert sorted(rows(sql(text, emp, dept, mode="ansi"))) == [(1,), (2,), (3,), (9,)]
    assert sorted(rows(sql("SELECT dept_id FROM ${d} EXCEPT SELECT dept_id FROM ${e}", dept, emp))) == [(4,)]
    by_name = sql("SELECT name, pay FROM ${e} UNION ALL SELECT pay, name FROM ${e}", emp)
    assert by_name.row_count() == 12 and by_name.dtypes()["pay"] == "long"


def test_case_cast_and_windows(emp):
    got = rows(sql("SELECT name, CASE WHEN pay > 40 THEN 'hi' WHEN pay > 20 THEN 'mid' ELSE 'lo' END AS c FROM this WHERE ROWNUM <= 10 ORDER BY name", this=emp))
    assert [c for _, c in got] == ["lo", "lo", "mid", "mid", "hi", "hi"]
    assert rows(sql("SELECT CAST(pay AS string) AS p FROM this WHERE name = 'ann'", this=emp)) == [("10",)]
    top = sql("SELECT name, rank() OVER (PARTITION BY dept_id ORDER BY pay DESC) AS r FROM this", this=emp).query("r == 1")
    assert sorted(r[0] for r in rows(top)) == ["bob", "dan", "eve", "fay"]


def test_dml(emp):
    more, n = emp.update("INSERT INTO this (name, pay) VALUES ('gus', 1 + 2), ('hal', null)")
    assert n == 2 and more.row_count() == 8 and more.query("name == 'gus'").df.first()["pay"] == 3
    new, n = emp.update("UPDATE this SET pay = pay * 2, name = name + '!' WHERE dept_id = 1")
    assert n == 2 and sorted(r[0] for r in new.query("pay in (20, 40)").df.select("name").collect()) == ["ann!", "bob!", "dan"]
    left, n = emp.update("DELETE FROM this WHERE pay > 30")
    assert n == 3 and left.row_count() == 3
    for bad in ("DELETE FROM this", "UPDATE this SET pay = 1", "INSERT INTO this VALUES (1)", "DROP TABLE this"):
        with pytest.raises(FrameError):
            emp.update(bad)


def test_binding(emp):
    with pytest.raises(FrameError):
        sql("SELECT * FROM ${a} JOIN ${b} ON a.x = b.x", emp)
    with pytest.raises(FrameError):
        sql("SELECT * FROM somewhere", this=emp)
    assert rows(sql("SELECT name FROM this WHERE name = '${x} limit 1' OR pay = 10", this=emp)) == [("ann",)]
    assert sql("SELECT name FROM {this} WHERE pay > 40".replace("{this}", "this"), this=emp, mode="spark").row_count() == 2


@pytest.mark.parametrize("text", ["", "SELECT", "SELECT a FROM", "SELECT a FROM this WHERE", "SELEC a FROM this", "SELECT a FROM this GROUP dept", "SELECT a + 1 FROM this", "SELECT * FROM this LIMIT x"])
def test_malformed(emp, text):
    with pytest.raises(FrameError):
        sql(text, this=emp)
