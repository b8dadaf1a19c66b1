"""The expression language: truth tables for missing values, precedence, kinds, errors."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomframe import Frame, frame
from loomframe.functions.expressions import ExpressionError, like_pattern, parse, tokens_of, unquoted

NAN = float("nan")


@pytest.fixture(scope="module")
def data(spark):
    rows = [(0, 1.0, "a%c", True), (1, NAN, "abc", False), (2, None, None, None), (3, -2.5, "x\ny", True), (4, 0.0, "it's", False)]
    return Frame(spark.createDataFrame(rows, "i long, x double, s string, b boolean"), "i")


def ids(f: Frame) -> list[int]:
    return sorted(r[0] for r in f.df.select("i").collect())


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("x > 0", [0]),
        ("x != 1", [1, 2, 3, 4]),
        ("not x > 0", [1, 2, 3, 4]),
        ("!(x > 0) && x is not null", [3, 4]),
        ("x is null", [1, 2]),
        ("x == null", []),
        ("x != null", [0, 1, 2, 3, 4]),
        ("x between -3 and 0", [3, 4]),
        ("x not between -3 and 0", [0]),
        ("x in (1, 0)", [0, 4]),
        ("x in (1, null)", [0, 1, 2]),
        ("x not in (1, null)", [3, 4]),
        ("2 not in (1, null)", [0, 1, 2, 3, 4]),
        ("s like 'a\\%c'", [0]),
        ("s like 'a%c'", [0, 1]),
        ("s not like 'a%'", [3, 4]),
        ("s like 'x%y'", []),
        ("s == 'it''s'", [4]),
        ("s = \"it's\"", [4]),
        ("b", [0, 3]),
        ("not b", [1, 2, 4]),
        ("b is true or b is null", [0, 2, 3]),
        ("b is not false", [0, 2, 3]),
        ("x > 0 or i > 2 and b", [0, 3]),
        ("i % 2 == 0 && !b", [2, 4]),
        ("(x > 0 ? 1 : 2) == 2", [1, 2, 3, 4]),
        ("nvl(x, -9) == -9", [1, 2]),
        ("1 + 2 * 3 == 7 and -i <= -3", [3, 4]),
        ("`i` <> 1 and i notin (2, 3)", [0, 4]),
    ],
)
def test_conditions(data, text, expected):
    assert ids(data.query(text)) == expected


def test_arithmetic_is_double_and_divides_by_zero(data):
    out = {r["i"]: r for r in data.eval("a = i / 0; d = 0 / 0; m = i % 2; t = 'n' + i; u = a > 5").df.collect()}
    assert out[3]["a"] == math.inf and math.isnan(out[0]["a"])
    assert all(math.isnan(r["d"]) for r in out.values())
    assert out[3]["m"] == 1.0 and isinstance(out[3]["m"], float)
    assert out[3]["t"] == "n3" and out[3]["u"] is True and out[0]["u"] is False


def test_later_statements_see_earlier_ones(data):
    assert data.eval("a = i + 1\nb2 = a * 2").df.where("i = 3").first()["b2"] == 8.0


@pytest.mark.parametrize("text", ["s > 1", "x and b", "b + 1", "nope == 1", "i ==", "f(i)", "i between 'a' and 2", "99999999999999999999 > i", "(i", "i @ 2", "x"])
def test_errors(data, text):
    with pytest.raises(ExpressionError):
        data.query(text)


def test_mixed_kinds_compare_unequal(data):
    assert ids(data.query("s == 1")) == [] and len(ids(data.query("s != 1"))) == 5


def test_parameters_are_values_not_text(data):
    assert ids(data.query("s == ${v}", v="abc' or 1 == 1")) == []
    assert ids(data.query("i == ${v}", v=3)) == [3]


def test_pushdown_keeps_bare_comparisons(spark, tmp_path):
    spark.range(10).selectExpr("id AS i", "double(id) AS x", "string(id) AS s").write.parquet(str(tmp_path / "p"))
    f = Frame(spark.read.parquet(str(tmp_path / "p")))
    plan = f.query("x > 3 and s == '5' and i in (1, 5)").df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(x,3" in plan and "EqualTo(s,5)" in plan and "In(i" in plan


@given(st.text(alphabet="ab%_\\.*\n", max_size=8), st.text(alphabet="ab%_\\.*\n", max_size=8))
@settings(max_examples=200, deadline=None)
def test_like_pattern_agrees_with_a_plain_matcher(pattern, text):
    import re

    def match(p, t):
        if not p:
            return not t
        if p[0] == "%":
            return match(p[1:], t) or bool(t) and t[0] != "\n" and match(p, t[1:])
        if p[0] == "\\" and len(p) > 1 and p[1] in "%_\\":
            return bool(t) and t[0] == p[1] and match(p[2:], t[1:])
        if p[0] == "_":
            return bool(t) and t[0] != "\n" and match(p[1:], t[1:])
        return bool(t) and t[0] == p[0] and match(p[1:], t[1:])

    assert bool(re.match(like_pattern(pattern).replace(r"\z", r"\Z"), text)) == match(pattern, text)


@given(st.text(max_size=20))
@settings(max_examples=200, deadline=None)
def test_any_text_parses_or_raises_an_expression_error(text):
    try:
        parse(text)
    except ExpressionError:
        pass


def test_tokens_and_literals():
    assert [t.kind for t in tokens_of("a1 >= 1e3 || `b c` -- rest")] == ["name", "op", "number", "op", "quoted", "end"]
    assert unquoted("'a''b\\n'") == "a'b\n"


def test_frame_from_rows_keeps_their_order(spark):
    f = frame([{"a": 2}, {"a": 1}], spark=spark)
    assert [r[0] for r in f.iter_rows()] == [2, 1]
