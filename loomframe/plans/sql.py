"""The SQL dialect, from text to a tree to DataFrame calls.

Tables are this, DUAL and ${name} placeholders. WHERE, HAVING and values speak the expression
language, with its two-valued logic. UNION goes by name; set operations fold from the left, and
ORDER BY and LIMIT belong to the branch they follow (mode="compat") or to the whole (mode="ansi").
ON conditions that are no equations filter after the join.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.frame import Frame
from loomframe.functions.expressions import Compiler, ExpressionError, Node, Parser, Value
from loomframe.functions.values import FrameError, col, fresh, kind_of
from loomframe.operators import group as G
from loomframe.operators.setops import stacked

# Words that end a table's alias or an expression.
RESERVED = {
    "select", "from", "where", "group", "having", "order", "limit", "offset", "fetch", "union", "intersect", "except",
    "minus", "join", "inner", "left", "right", "full", "cross", "on", "using", "and", "or", "not", "as", "outer", "with",
    "when", "then", "else", "end", "by", "asc", "desc", "distinct", "all", "is", "in", "like", "between", "null", "rownum",
}
#: Dialects accept one another's spellings; the name is kept for callers that ask.
DIALECTS = ("DEFAULT", "ORACLE", "POSTGRESQL", "MYSQL")
CAPABILITIES = {
    "JOIN": True, "SUBQUERY": True, "CTE": True, "SET_OPERATIONS": True, "CASE_WHEN": True, "DML": True, "CAST": True,
    "PARAMETERIZED": True, "WINDOW_FUNCTIONS": True,
}


def current_dialect() -> str:
    named = os.environ.get("LOOMFRAME_SQL_DIALECT", "DEFAULT").upper()
    return named if named in DIALECTS else "DEFAULT"


# ------------------------------------------------------------------ trees


@dataclass
class Table:
    name: str | None = None
    query: Query | None = None
    alias: str | None = None


@dataclass
class Join:
    how: str
    table: Table
    on: Node | None = None
    using: list[str] | None = None


@dataclass
class Item:
    node: Node
    alias: str | None


@dataclass
class Select:
    items: list[Item]
    distinct: bool = False
    table: Table | None = None
    joins: list[Join] = field(default_factory=list)
    where: Node | None = None
    group: list[Node] = field(default_factory=list)
    grouping: str = ""
    having: Node | None = None
    order: list[tuple[Node, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0


@dataclass
class Query:
    """branches folded by operators; the tail is the last branch's own (compat) or the whole's."""

    branches: list[Select | Query]
    operators: list[str] = field(default_factory=list)
    with_: list[tuple[str, Query]] = field(default_factory=list)


class SqlParser(Parser):
    def query(self) -> Query:
        named = []
        if self.accept("with"):
            while True:
                name = self.name()
                self.expect("as")
                self.expect("(")
                named.append((name, self.query()))
                self.expect(")")
                if not self.accept(","):
                    break
        out = Query([self.branch()], [], named)
        while self.is_word("union", "intersect", "except", "minus"):
            op = self.take().word()
            op = {"minus": "except"}.get(op, op)
            if self.accept("all"):
                op += " all"
            else:
                self.accept("distinct")
            out.operators.append(op)
            out.branches.append(self.branch())
        return out

    def branch(self) -> Select | Query:
        if self.is_op("("):
            self.at += 1
            inner = self.query()
            self.expect(")")
            return inner
        return self.select()

    def name(self) -> str:
        token = self.take()
        if token.kind == "quoted":
            return token.text[1:-1]
        if token.kind != "name":
            self.at -= 1
            self.fail("expected a name")
        return token.text

    def select(self) -> Select:
        self.expect("select")
        out = Select([], distinct=self.accept("distinct"))
        self.accept("all")
        out.items.append(self.item())
        while self.accept(","):
            out.items.append(self.item())
        if self.accept("from"):
            out.table = self.table()
            while (how := self.join_kind()) is not None:
                out.joins.append(self.join(how))
        if self.accept("where"):
            out.where = self.expression()
        if self.accept("group"):
            self.expect("by")
            out.grouping = self.peek().word() if self.is_word("rollup", "cube") and self.peek(1).text == "(" else ""
            if out.grouping:
                self.at += 2
            out.group.append(self.expression())
            while self.accept(","):
                out.group.append(self.expression())
            if out.grouping:
                self.expect(")")
        if self.accept("having"):
            out.having = self.expression()
        if self.accept("order"):
            self.expect("by")
            out.order = self.order_items()
        self.pages(out)
        return out

    def order_items(self) -> list[tuple[Node, bool]]:
        out = []
        while True:
            node = self.expression()
            up = not self.accept("desc")
            self.accept("asc")
            out.append((node, up))
            if not self.accept(","):
                return out

    def pages(self, out: Select) -> None:
        while self.is_word("limit", "offset", "fetch"):
            word = self.take().word()
            if word == "limit":
                out.limit = self.whole()
                if self.accept(","):  # LIMIT offset, n
                    out.offset, out.limit = out.limit, self.whole()
            elif word == "offset":
                out.offset = self.whole()
                self.accept("rows", "row")
            else:
                self.expect("first", "next")
                out.limit = self.whole()
                self.expect("rows", "row")
                self.accept("only")

    def whole(self) -> int:
        token = self.take()
        if token.kind != "number" or not token.text.isdigit():
            self.at -= 1
            self.fail("expected a whole number")
        return int(token.text)

    def item(self) -> Item:
        if self.accept("*"):
            return Item(Node("star"), None)
        if self.peek().kind == "name" and self.peek(1).text == "." and self.peek(2).text == "*":
            qualifier = self.take().text
            self.at += 2
            return Item(Node("star", value=qualifier), None)
        node = self.expression()
        if self.accept("as"):
            return Item(node, self.name())
        if self.peek().kind == "quoted" or self.peek().kind == "name" and self.peek().word() not in RESERVED:
            return Item(node, self.name())
        return Item(node, None)

    def table(self) -> Table:
        if self.accept("("):
            out = Table(query=self.query())
            self.expect(")")
        elif self.peek().kind == "param":
            out = Table(name=self.take().text[2:-1].strip())
        else:
            out = Table(name="\0" + self.name())  # a bare name: this, DUAL or a WITH name
        if self.accept("as") or self.peek().kind == "name" and self.peek().word() not in RESERVED:
            out.alias = self.name()
        return out

    def join_kind(self) -> str | None:
        if self.accept("cross"):
            self.expect("join")
            return "cross"
        if self.is_word("join"):
            self.at += 1
            return "inner"
        for how in ("inner", "left", "right", "full"):
            if self.is_word(how):
                self.at += 1
                if how == "left" and self.is_word("semi", "anti"):
                    how = self.take().word()
                self.accept("outer")
                self.expect("join")
                return how
        return None

    def join(self, how: str) -> Join:
        out = Join(how, self.table())
        if how == "cross":
            return out
        if self.accept("using"):
            self.expect("(")
            out.using = [self.name()]
            while self.accept(","):
                out.using.append(self.name())
            self.expect(")")
        else:
            self.expect("on")
            out.on = self.expression()
        return out

    # ---- values that only SQL has
    def membership(self, left: Node, negated: bool) -> Node:
        if self.peek(1).word() in ("select", "with"):
            self.expect("(")
            query = self.query()
            self.expect(")")
            return Node("in_query", (left,), (query, negated))
        return super().membership(left, negated)

    def primary(self) -> Node:
        if self.is_op("(") and self.peek(1).word() in ("select", "with"):
            self.at += 1
            query = self.query()
            self.expect(")")
            return Node("scalar_query", value=query)
        if self.is_word("cast") and self.peek(1).text == "(":
            self.at += 2
            inner = self.expression()
            self.expect("as")
            kind = self.name()
            self.expect(")")
            return Node("cast", (inner,), kind)
        if self.is_word("exists") and self.peek(1).text == "(":
            self.at += 2
            query = self.query()
            self.expect(")")
            return Node("exists", value=query)
        return super().primary()

    def call(self, name: str) -> Node:
        node = super().call(name)
        if not self.accept("over"):
            return node
        self.expect("(")
        partition, order = [], []
        if self.accept("partition"):
            self.expect("by")
            partition.append(self.expression())
            while self.accept(","):
                partition.append(self.expression())
        if self.accept("order"):
            self.expect("by")
            order = self.order_items()
        self.expect(")")
        return Node("over", (node,), (tuple(partition), tuple(order)))


# ------------------------------------------------------------------ planning


def is_aggregate(node: Node) -> bool:
    return node.op == "call" and node.value[0] in G.AGGREGATES


def holds_aggregate(node: Node) -> bool:
    if node.op == "over":
        return False
    return is_aggregate(node) or any(holds_aggregate(a) for a in node.args)


def conjuncts(node: Node | None) -> list[Node]:
    if node is None:
        return []
    return conjuncts(node.args[0]) + conjuncts(node.args[1]) if node.op == "and" else [node]


def default_name(node: Node) -> str:
    """<fn>_<column> of an aggregate, or the column's own name."""
    if node.op == "call":
        arg = node.args[0] if node.args else Node("star")
        inner = "*" if arg.op == "star" else default_name(arg)
        return f"{node.value[0]}_{inner}"
    if node.op == "over":
        return default_name(node.args[0])
    return node.value[1] if node.op == "column" else "expr"


class Scope:
    """A joined frame, and which of its columns each (alias, name) means."""

    def __init__(self, frame: Frame, alias: str | None):
        self.frame = frame
        self.names: dict[tuple[str, str], str] = {}
        if alias:
            self.names = {(alias.lower(), c): c for c in frame.df.columns}

    def resolve(self, qualifier: str | None, name: str) -> str:
        columns = self.frame.df.columns
        if qualifier and (found := self.names.get((qualifier.lower(), name))):
            return found
        if name in columns:
            return name
        close = [c for c in columns if c.lower() == name.lower()]
        if len(close) == 1:
            return close[0]
        if not qualifier:
            sides = {v for (_, n), v in self.names.items() if n == name and v in columns}
            if len(sides) > 1:
                raise ExpressionError(f"{name!r} may mean any of {sorted(sides)}")
        return name


class Planner:
    def __init__(self, tables: dict[str, Frame], this: Frame | None, mode: str, params: dict):
        self.tables, self.this, self.mode, self.params = dict(tables), this, mode, params

    # ---- queries
    def query(self, q: Query) -> Frame:
        held = dict(self.tables)
        for name, inner in q.with_:
            self.tables["\0" + name.lower()] = self.query(inner)
        branches, tail = list(q.branches), None
        if self.mode == "ansi" and q.operators and isinstance(branches[-1], Select):
            last = branches[-1]
            tail = Select([], order=last.order, limit=last.limit, offset=last.offset)
            branches[-1] = Select(**{**last.__dict__, "order": [], "limit": None, "offset": 0})
        if self.mode == "ansi":  # INTERSECT binds tighter
            operators = list(q.operators)
            frames = [self.branch(b) for b in branches]
            while any(o.startswith("intersect") for o in operators):
                i = next(i for i, o in enumerate(operators) if o.startswith("intersect"))
                frames[i : i + 2] = [self.combined(frames[i], frames[i + 1], operators.pop(i))]
        else:
            operators, frames = list(q.operators), [self.branch(b) for b in branches]
        out = frames[0]
        for op, frame in zip(operators, frames[1:], strict=True):
            out = self.combined(out, frame, op)
        if tail:
            out = self.paged(self.sorted(out, Scope(out, None), tail.order), tail)
        self.tables = held
        return out

    def branch(self, b: Select | Query) -> Frame:
        return self.query(b) if isinstance(b, Query) else self.select(b)

    @staticmethod
    def combined(a: Frame, b: Frame, op: str) -> Frame:
        if len(a.df.columns) != len(b.df.columns):
            raise FrameError(f"{op} of {len(a.df.columns)} and {len(b.df.columns)} columns")
        if op in ("union", "union all"):
            df = stacked(a.df, b.df)
            return a._with(df.distinct() if op == "union" else df, [])
        made = {"intersect": a.df.intersect, "except": a.df.subtract, "intersect all": a.df.intersectAll, "except all": a.df.exceptAll}
        return a._with(made[op](b.df), [])

    # ---- one SELECT
    def select(self, s: Select) -> Frame:
        scope = self.source(s)
        rownum = None
        kept = []
        for c in conjuncts(s.where):
            limit = _rownum_limit(c)
            if limit is None:
                kept.append(c)
            else:
                rownum = limit if rownum is None else min(rownum, limit)
        scope.frame = self.filtered(scope, kept)
        if rownum is not None:
            scope.frame = scope.frame._with(scope.frame.df.limit(rownum))
        before = scope
        grouped = bool(s.group) or any(holds_aggregate(i.node) for i in s.items) or s.having is not None
        if grouped:
            out = self.aggregated(s, scope)
        else:
            out = scope.frame._with(self.projected(scope, s.items))
        if s.distinct:
            out = out._with(out.df.distinct(), [])
            before = None
        if s.order:
            out = self.ordered(out, s, None if grouped else before)
        return self.paged(out, s)

    def ordered(self, out: Frame, s: Select, before: Scope | None) -> Frame:
        names = {default_name(i.node) if i.alias is None else i.alias for i in s.items}
        plain = all(n.op == "column" and n.value[1] in out.df.columns or n.op == "literal" for n, _ in s.order)
        if before is None or plain or any(i.node.op == "star" for i in s.items):
            return self.sorted(out, Scope(out, None), s.order)
        # A column that the projection leaves out: sort the source, which the projection keeps in order.
        del names
        rows = self.sorted(before.frame, before, s.order)
        scope = Scope(rows, None)
        scope.names = before.names
        return rows._with(self.projected(scope, s.items), [])

    def sorted(self, frame: Frame, scope: Scope, order: list[tuple[Node, bool]]) -> Frame:
        if not order:
            return frame
        keys = []
        for node, up in order:
            if node.op == "literal" and isinstance(node.value, int):
                c = col(frame.df.columns[node.value - 1])
            elif node.op == "call" and default_name(node) in frame.df.columns:
                c = col(default_name(node))
            else:
                c = self.compiler(scope).value(node)
            kind = frame.df.select(c.alias("k")).schema["k"].dataType
            c = F.when(~F.isnan(c), c) if isinstance(kind, (T.DoubleType, T.FloatType)) else c
            keys.append(c.asc_nulls_last() if up else c.desc_nulls_last())
        return frame._with(frame.df.orderBy(*keys))

    @staticmethod
    def paged(frame: Frame, s: Select) -> Frame:
        df = frame.df
        if s.offset:
            df = df.offset(s.offset)
        if s.limit is not None:
            df = df.limit(s.limit)
        return frame._with(df) if df is not frame.df else frame

    # ---- FROM
    def source(self, s: Select) -> Scope:
        if s.table is None:
            spark = self._spark()
            return Scope(Frame(spark.range(1).select(F.lit(1).alias("dummy"))), None)
        scope = Scope(self.table(s.table), self.alias(s.table))
        for j in s.joins:
            scope = self.joined(scope, j)
        return scope

    def _spark(self):
        from pyspark.sql import SparkSession

        return self.this.spark if self.this else SparkSession.getActiveSession()

    @staticmethod
    def alias(t: Table) -> str | None:
        return t.alias or (t.name or "").lstrip("\0") or None

    def table(self, t: Table) -> Frame:
        if t.query:
            return self.query(t.query)
        if t.name.startswith("\0"):
            name = t.name[1:].lower()
            if "\0" + name in self.tables:
                return self.tables["\0" + name]
            if name == "this" and self.this is not None:
                return self.this
            if name == "dual":
                return Frame(self._spark().range(1).select(F.lit("X").alias("DUMMY")))
            raise FrameError(f"unknown table {t.name[1:]!r}; tables are this, DUAL and ${{name}}")
        if t.name not in self.tables:
            raise FrameError(f"no table is bound to ${{{t.name}}}")
        return self.tables[t.name]

    def joined(self, scope: Scope, j: Join) -> Scope:
        right, alias = self.table(j.table), self.alias(j.table)
        left = scope.frame
        if j.how == "cross":
            out = Scope(left.cross_join(right), None)
            names_r = {n: n + "_r" if n in left.df.columns else n for n in right.df.columns}
            out.names = dict(scope.names) | {(alias.lower(), n): m for n, m in names_r.items() if alias}
            return out
        rest: list[Node] = []
        left_on, right_on = [], []
        made: list[str] = []
        if j.using:
            left_on = right_on = j.using
        for c in conjuncts(j.on):
            pair = self._equation(c, scope, right, alias)
            if not pair and (sides := self._computed(c, scope, right, alias)):
                # An equation of expressions of either side joins on them as columns.
                x, y = self.compiler(scope)._compile(sides[0]), self.compiler(Scope(right, alias))._compile(sides[1])
                names = [*left.df.columns, *right.df.columns]
                pair = fresh(names, "key_left"), fresh(names, "key_right")
                kind = {"number": "double"}.get(x.kind) if x.kind == y.kind else None
                cast = lambda v, kind=kind: v.column.cast(kind) if kind else v.column
                left = scope.frame = left._with(left.df.withColumn(pair[0], cast(x)))
                right = right._with(right.df.withColumn(pair[1], cast(y)))
                made += pair
            if pair:
                left_on.append(pair[0])
                right_on.append(pair[1])
            else:
                rest.append(c)
        if not left_on:
            raise FrameError("ON needs an equation of a column of either side; a product is CROSS JOIN")
        if j.how in ("semi", "anti"):
            out = Scope(left.semi_join(right, left_on=left_on, right_on=right_on, anti=j.how == "anti").drop(*made), None)
            out.names = scope.names
            return out
        from loomframe.operators.join import merged_names

        merged = left.merge(right, how=j.how, left_on=left_on, right_on=right_on)
        names_l, names_r = merged_names(left.df.columns, right.df.columns, left_on, right_on, ("_x", "_y"))
        shared = {a for a, b in zip(left_on, right_on, strict=True) if a == b}
        out = Scope(merged, None)
        out.names = {k: names_l[v] for k, v in scope.names.items()}
        if alias:
            out.names |= {(alias.lower(), n): m for n, m in names_r.items()} | {(alias.lower(), n): n for n in shared}
        out.frame = self.filtered(out, rest).drop(*made)
        return out

    @staticmethod
    def _sides(scope: Scope, right: Frame, alias: str | None, q: str | None, n: str) -> tuple[str | None, str | None]:
        """The column of the left and of the right table that q.n can mean."""
        own = bool(q and alias and q.lower() == alias.lower())
        left = None if own and (q.lower(), n) not in scope.names else scope.resolve(q, n)
        other = bool(q and q.lower() in {a for a, _ in scope.names} and not own)
        return left if left in scope.frame.df.columns else None, n if not other and n in right.df.columns else None

    def _equation(self, node: Node, scope: Scope, right: Frame, alias: str | None) -> tuple[str, str] | None:
        if node.op != "==" or any(a.op != "column" for a in node.args):
            return None
        (x, p), (y, q) = (self._sides(scope, right, alias, *a.value) for a in node.args)
        if x and q:
            return x, q
        return (y, p) if y and p else None

    def _computed(self, node: Node, scope: Scope, right: Frame, alias: str | None) -> tuple[Node, Node] | None:
        """An equation's sides, if one is an expression of the left and the other of the right table."""
        if node.op != "==":
            return None

        def columns(n) -> list[Node]:
            if not isinstance(n, Node):
                return []
            return [n] if n.op == "column" else [c for a in n.args for c in columns(a)]

        def side(n: Node) -> str:
            found = [self._sides(scope, right, alias, *c.value) for c in columns(n)]
            if found and all(x and not y for x, y in found):
                return "left"
            return "right" if found and all(y and not x for x, y in found) else ""

        a, b = node.args
        return {("left", "right"): (a, b), ("right", "left"): (b, a)}.get((side(a), side(b)))

    # ---- conditions
    def compiler(self, scope: Scope) -> Compiler:
        return Compiler(scope.frame.df.schema, self.params, scope.resolve, self._extra)

    def _extra(self, node: Node, compiler: Compiler) -> Value | None:
        if node.op == "scalar_query":
            sub = self.query(node.value).df
            first = sub.columns[0]
            kind = sub.schema[first].dataType
            return Value(sub.select(col(first)).limit(1).scalar(), kind_of(kind), isinstance(kind, T.DoubleType))
        if node.op == "exists":
            return Value(self.query(node.value).df.exists(), "bool", exact=True)
        if node.op == "cast":
            kinds = {"int": "int", "integer": "int", "long": "bigint", "bigint": "bigint", "double": "double", "float": "double",
                     "string": "string", "varchar": "string", "text": "string", "date": "date", "timestamp": "timestamp_ntz",
                     "datetime": "timestamp_ntz", "boolean": "boolean", "bool": "boolean"}
            if node.value.lower() not in kinds:
                raise ExpressionError(f"unknown kind {node.value!r}")
            kind = kinds[node.value.lower()]
            said = {"int": "number", "bigint": "number", "double": "number", "string": "string", "boolean": "bool"}
            return Value(compiler._compile(node.args[0]).column.cast(kind), said.get(kind, "time"), kind == "double")
        if node.op == "over":
            return self._over(node, compiler)
        return None

    def _over(self, node: Node, compiler: Compiler) -> Value:
        """Window functions, beyond what the dialect asks for."""
        from pyspark.sql.window import Window

        (call,), (partition, order) = node.args, node.value
        spec = Window.partitionBy(*[compiler.value(p) for p in partition])
        if order:
            spec = spec.orderBy(*[(c.asc_nulls_last() if up else c.desc_nulls_last()) for c, up in ((compiler.value(n), up) for n, up in order)])
        name, args = call.value[0], [compiler.value(a) for a in call.args if a.op != "star"]
        plain = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank, "percent_rank": F.percent_rank, "cume_dist": F.cume_dist}
        if name in plain:
            return Value(plain[name]().over(spec), "number")
        if name == "ntile":
            return Value(F.ntile(call.args[0].value).over(spec), "number")
        if name in ("lag", "lead"):
            steps = call.args[1].value if len(call.args) > 1 else 1
            inner = compiler._compile(call.args[0])
            return Value((F.lag if name == "lag" else F.lead)(args[0], steps).over(spec), inner.kind, inner.floating)
        made = {"sum": F.sum, "avg": F.avg, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count, "first": F.first, "last": F.last,
                "std": F.stddev_samp, "var": F.var_samp}
        if name not in made:
            raise ExpressionError(f"unknown window function {name!r}")
        return Value((made[name](args[0]) if args else F.count(F.lit(1))).over(spec), "number")

    def filtered(self, scope: Scope, parts: list[Node]) -> Frame:
        """Conjuncts one by one. A membership in a sub-query is a semi or anti join where it stands
        alone, else a join with the sub-query's distinct values that leaves a mark."""
        frame = scope.frame
        for node in parts:
            if node.op == "in_query":
                frame = self._member(scope, frame, node)
            else:
                scope.frame, marks = self._marked(scope, frame, node)
                rewritten = _replace(node, marks)
                kept = scope.frame.df.where(self.compiler(scope).condition(rewritten))
                frame = frame._with(kept.drop(*marks.values()) if marks else kept)
            scope.frame = frame
        return frame

    def _member(self, scope: Scope, frame: Frame, node: Node) -> Frame:
        query, negated = node.value
        sub = self.query(query).df
        key = fresh(frame.df.columns, "member_")
        c = self.compiler(scope).value(node.args[0])
        values = sub.select(col(sub.columns[0]).alias(key))
        return frame._with(frame.df.join(values, c.eqNullSafe(col(key)), "left_anti" if negated else "left_semi"))

    def _marked(self, scope: Scope, frame: Frame, node: Node) -> tuple[Frame, dict[int, str]]:
        marks: dict[int, str] = {}

        def visit(n: Node) -> None:
            nonlocal frame
            if n.op == "in_query":
                sub = self.query(n.value[0]).df
                key, mark = fresh(frame.df.columns, "member_"), fresh(frame.df.columns, "mark_")
                values = sub.select(col(sub.columns[0]).alias(key)).distinct().withColumn(mark, F.lit(True))
                c = self.compiler(scope).value(n.args[0])
                frame = frame._with(frame.df.join(values, c.eqNullSafe(col(key)), "left").drop(key))
                marks[id(n)] = mark
            for a in n.args:
                visit(a)

        visit(node)
        return frame, marks

    # ---- projections
    def projected(self, scope: Scope, items: list[Item]) -> DataFrame:
        df, out, used = scope.frame.df, [], set()
        compiler = self.compiler(scope)

        def add(c: Column, name: str) -> None:
            n, k = name, 2
            while n in used:
                n, k = f"{name}_{k}", k + 1
            used.add(n)
            out.append(c.alias(n))

        for item in items:
            node = item.node
            if node.op == "star":
                for c in df.columns:
                    if not node.value or c in {v for (q, _), v in scope.names.items() if q == node.value.lower()}:
                        add(col(c), c)
            elif node.op == "column" and item.alias is None:
                name = scope.resolve(*node.value)
                compiler.value(node)
                add(col(name), node.value[1] if node.value[1] not in used else name)
            else:
                if item.alias is None and node.op not in ("column", "over"):
                    raise FrameError("an expression needs AS and a name")
                add(compiler.value(node), item.alias or default_name(node))
        return df.select(*out)

    def aggregated(self, s: Select, scope: Scope) -> Frame:
        df = scope.frame.df
        compiler = self.compiler(scope)
        keys: list[tuple[str, Column]] = []
        aliases = {i.alias: i.node for i in s.items if i.alias}
        for node in s.group:
            if node.op == "column":
                name = scope.resolve(*node.value)
                if name not in df.columns and node.value[1] in aliases:
                    keys.append((node.value[1], compiler.value(aliases[node.value[1]])))
                    continue
                c = compiler.value(node)
                kind = df.schema[name].dataType
                if isinstance(kind, (T.DoubleType, T.FloatType)):
                    c = F.when(~F.isnan(c), c + F.lit(0.0))
                keys.append((node.value[1], c))
            else:
                keys.append((f"key_{len(keys)}", compiler.value(node)))
        # Every aggregate call once, under a name of its own.
        calls: dict[Node, str] = {}

        def collect(n: Node) -> None:
            if is_aggregate(n):
                calls.setdefault(n, f"agg_{len(calls)}_")
            else:
                for a in n.args:
                    collect(a)

        for i in s.items:
            collect(i.node)
        if s.having is not None:
            collect(s.having)
        for n, _ in s.order:
            collect(n)
        work, parts = df, []
        for n, name in calls.items():
            fn, distinct = n.value
            if not n.args or n.args[0].op == "star":
                parts.append(F.count("*").alias(name))
                continue
            arg = fresh(work.columns, f"arg_{len(parts)}_")
            work = work.withColumn(arg, compiler.value(n.args[0]))
            parts.append(G.aggregate(work, arg, fn, scope.frame.order_by, distinct=distinct).alias(name))
        key_columns = [c.alias(f"k{i}_") for i, (_, c) in enumerate(keys)]
        parts = parts or [F.count("*").alias("agg_none_")]
        if s.grouping:
            grouped = getattr(work, s.grouping)(*key_columns).agg(*parts)
        else:
            grouped = work.groupBy(*key_columns).agg(*parts) if keys else work.agg(*parts)
        out_names: dict[str, str] = {}
        for i, (name, _) in enumerate(keys):
            out_names[name] = f"k{i}_"
        by_node = {n: f"k{i}_" for i, n in enumerate(s.group)}

        def rewritten(n: Node) -> Node:
            if n in calls:
                return Node("column", value=(None, calls[n]))
            if n in by_node:
                return Node("column", value=(None, by_node[n]))
            if n.op == "column":
                name = n.value[1]
                if name in out_names:
                    return Node("column", value=(None, out_names[name]))
                raise FrameError(f"column {name!r} is neither grouped nor aggregated")
            return Node(n.op, tuple(rewritten(a) for a in n.args), n.value)

        items = []
        for i in s.items:
            if i.node.op == "star":
                raise FrameError("* beside an aggregate")
            items.append(Item(rewritten(i.node), i.alias or default_name(i.node)))
        inner = Scope(Frame(grouped), None)
        # HAVING and ORDER BY see the result's names and those of the groups.
        names = {i.alias: i.node for i in items} | {default_name(n): Node("column", value=(None, c)) for n, c in calls.items()}

        def having(n: Node) -> Node:
            if n in calls or n in by_node:
                return rewritten(n)
            if n.op == "column" and n.value[1] in names:
                return names[n.value[1]]
            if n.op == "column":
                return rewritten(n)
            return Node(n.op, tuple(having(a) for a in n.args), n.value)

        if s.having is not None:
            inner.frame = self.filtered(inner, [having(c) for c in conjuncts(s.having)])
        if s.order and not s.distinct:
            order = [(n if n.op == "literal" else having(n), up) for n, up in s.order]
            positions = [(items[n.value - 1].node if n.op == "literal" else n, up) for n, up in order]
            inner.frame = self.sorted(inner.frame, inner, positions)
            s.order = []
        return Frame(self.projected(inner, items))


def _rownum_limit(node: Node) -> int | None:
    if node.op not in ("<=", "<") or node.args[0].op != "column" or node.args[1].op != "literal":
        return None
    if node.args[0].value[1].lower() != "rownum":
        return None
    return node.args[1].value - (node.op == "<")


def _replace(node: Node, marks: dict[int, str]) -> Node:
    if id(node) in marks:
        there = Node("is", (Node("column", value=(None, marks[id(node)])),), ("null", not node.value[1]))
        return there
    return Node(node.op, tuple(_replace(a, marks) for a in node.args), node.value) if marks else node


def bind(text: str, others: tuple, named: dict) -> dict[str, Frame]:
    """Placeholders by name, or in the order in which they first appear."""
    names = list(dict.fromkeys(re.findall(r"\$\{\s*([^}]*?)\s*\}", text)))
    if others:
        if len(others) != len(names):
            raise FrameError(f"{len(others)} frames for the placeholders {names}")
        return dict(zip(names, others, strict=True)) | named
    return dict(named)


def sql(text: str, *others: Frame, this: Frame | None = None, mode: str = "compat", params: dict | None = None, **named: Frame) -> Frame:
    """Run a query. Frames are bound to ${name} placeholders by keyword or by position; params to
    ${name} inside expressions. mode: compat, ansi (precedence and tails as in the standard), or
    spark, which hands the text to Spark SQL with the frames as its tables."""
    if mode == "spark":
        frames = bind(text, others, named) | ({"this": this} if this else {})
        spark = next(iter(frames.values())).spark
        plain = re.sub(r"\$\{\s*([^}]*?)\s*\}", r"{\1}", text)
        return Frame(spark.sql(re.sub(r"\bthis\b", "{this}", plain) if this else plain, **{k: v.df for k, v in frames.items()}))
    tables = bind(text, others, named) if others or named else {}
    parser = SqlParser(text.strip().rstrip(";"))
    tree = parser.query()
    parser.finished()
    planner = Planner(tables, this or (others[0] if others else next(iter(named.values()), None)), mode, params or {})
    return planner.query(tree)
