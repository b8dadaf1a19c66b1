"""The row-expression language of query, eval and SQL: text to a tree to a Column.

Logic is two-valued: a comparison with a missing value is false, except != which is true. In a
filter a NULL drops the row as a false does, so there the bare comparison is kept for pushdown; it
is made exact (coalesced) under a negation and wherever its value itself is shown.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.functions.values import FrameError, col, divided, is_float, kind_of


class ExpressionError(FrameError):
    """Text that is not an expression, or one whose kinds do not fit."""


# ------------------------------------------------------------------ tokens

_TOKEN = re.compile(
    r"""
    (?P<space>\s+|--[^\n]*|/\*[\s\S]*?\*/)
  | (?P<number>(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)
  | (?P<string>'(?:''|\\.|[^'\\])*'|"(?:""|\\.|[^"\\])*")
  | (?P<param>\$\{[^}]*\})
  | (?P<quoted>`(?:``|[^`])+`)
  | (?P<name>[^\W0-9]\w*)
  | (?P<op>&&|\|\||==|!=|<>|<=|>=|[-+*/%<>=!?:(),.;])
    """,
    re.VERBOSE,
)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int

    def word(self) -> str:
        return self.text.lower() if self.kind == "name" else ""


def tokens_of(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"cannot read {text[at : at + 20]!r} at {at}")
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m[0], at))
        at = m.end()
    return [*out, Token("end", "", len(text))]


def unquoted(text: str) -> str:
    quote, body = text[0], text[1:-1].replace(text[0] * 2, text[0])
    escapes = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", quote: quote}
    return re.sub(r"\\(.)", lambda m: escapes.get(m[1], "\\" + m[1]), body, flags=re.DOTALL)


# ------------------------------------------------------------------ tree


@dataclass(frozen=True)
class Node:
    """op with its operands: literal, column (qualifier, name), parameter and the operators."""

    op: str
    args: tuple = ()
    value: object = None


@dataclass
class Parser:
    """Recursive descent. SQL's own clauses are parsed by a subclass, which hooks primary()."""

    text: str
    tokens: list[Token] = field(init=False)
    at: int = 0

    def __post_init__(self):
        self.tokens = tokens_of(self.text)

    # token access
    def peek(self, ahead: int = 0) -> Token:
        return self.tokens[min(self.at + ahead, len(self.tokens) - 1)]

    def take(self) -> Token:
        token = self.peek()
        self.at += 1
        return token

    def is_op(self, *texts: str) -> bool:
        return self.peek().kind == "op" and self.peek().text in texts

    def is_word(self, *words: str) -> bool:
        return self.peek().word() in words

    def accept(self, *texts: str) -> bool:
        """An operator or a word."""
        if self.is_op(*texts) or self.is_word(*texts):
            self.at += 1
            return True
        return False

    def expect(self, *texts: str) -> None:
        if not self.accept(*texts):
            self.fail(f"expected {' or '.join(texts)}")

    def fail(self, why: str):
        raise ExpressionError(f"{why} at {self.peek().at} in {self.text!r}")

    # grammar, loosest first
    def expression(self) -> Node:
        left = self.conjunction()
        while self.accept("||", "or"):
            left = Node("or", (left, self.conjunction()))
        return left

    def conjunction(self) -> Node:
        left = self.negation()
        while self.accept("&&", "and"):
            left = Node("and", (left, self.negation()))
        return left

    def negation(self) -> Node:
        if self.accept("!", "not"):
            return Node("not", (self.negation(),))
        return self.ternary()

    def ternary(self) -> Node:
        test = self.comparison()
        if self.accept("?"):
            yes = self.ternary()
            self.expect(":")
            return Node("if", (test, yes, self.ternary()))
        return test

    def comparison(self) -> Node:
        left = self.sum()
        while True:
            if self.is_op("=", "==", "!=", "<>", "<", "<=", ">", ">="):
                op = {"=": "==", "<>": "!="}.get(self.peek().text, self.take().text)
                left = Node(op, (left, self.sum()))
                continue
            negated = False
            if self.is_word("not") and self.peek(1).word() in ("between", "like", "in"):
                self.at += 1
                negated = True
            if self.accept("between"):
                low = self.sum()
                self.expect("and")
                left = Node("between", (left, low, self.sum()), negated)
            elif self.accept("like"):
                left = Node("like", (left, self.sum()), negated)
            elif self.is_word("in", "notin"):
                negated = negated or self.peek().word() == "notin"
                self.at += 1
                left = self.membership(left, negated)
            elif self.accept("is"):
                negated = self.accept("not")
                what = self.take().word()
                if what not in ("null", "true", "false"):
                    self.fail("expected null, true or false")
                left = Node("is", (left,), (what, negated))
            else:
                return left

    def membership(self, left: Node, negated: bool) -> Node:
        self.expect("(")
        items = [self.expression()]
        while self.accept(","):
            items.append(self.expression())
        self.expect(")")
        return Node("in", (left, *items), negated)

    def sum(self) -> Node:
        left = self.product()
        while self.is_op("+", "-"):
            left = Node(self.take().text, (left, self.product()))
        return left

    def product(self) -> Node:
        left = self.unary()
        while self.is_op("*", "/", "%"):
            left = Node(self.take().text, (left, self.unary()))
        return left

    def unary(self) -> Node:
        if self.accept("-"):
            inner = self.unary()
            if inner.op == "literal" and isinstance(inner.value, (int, float)) and not isinstance(inner.value, bool):
                return Node("literal", value=-inner.value)
            return Node("negative", (inner,))
        if self.accept("+"):
            return self.unary()
        return self.primary()

    def primary(self) -> Node:
        token = self.take()
        if token.kind == "number":
            return Node("literal", value=self.number(token.text))
        if token.kind == "string":
            return Node("literal", value=unquoted(token.text))
        if token.kind == "param":
            return Node("parameter", value=token.text[2:-1].strip())
        if token.kind == "op" and token.text == "(":
            inner = self.expression()
            self.expect(")")
            return inner
        if token.kind == "quoted":
            return self.column(token.text[1:-1].replace("``", "`"))
        word = token.word()
        if word in ("true", "false"):
            return Node("literal", value=word == "true")
        if word in ("null", "none"):
            return Node("literal", value=None)
        if word == "case":
            return self.case()
        if token.kind == "name" and self.is_op("("):
            return self.call(token.text)
        if token.kind == "name":
            return self.column(token.text)
        self.at -= 1
        self.fail("expected a value")

    def column(self, name: str) -> Node:
        if self.is_op(".") and self.peek(1).kind in ("name", "quoted"):
            self.at += 1
            part = self.take()
            return Node("column", value=(name, part.text.strip("`") if part.kind == "quoted" else part.text))
        return Node("column", value=(None, name))

    def call(self, name: str) -> Node:
        self.expect("(")
        distinct = self.accept("distinct")
        args: list[Node] = []
        if self.accept("*"):
            args.append(Node("star"))
        elif not self.is_op(")"):
            args.append(self.expression())
            while self.accept(","):
                args.append(self.expression())
        self.expect(")")
        return Node("call", tuple(args), (name.lower(), distinct))

    def case(self) -> Node:
        branches = []
        while self.accept("when"):
            test = self.expression()
            self.expect("then")
            branches.append((test, self.expression()))
        if not branches:
            self.fail("expected when")
        out = self.expression() if self.accept("else") else Node("literal", value=None)
        self.expect("end")
        for test, value in reversed(branches):
            out = Node("if", (test, value, out))
        return out

    @staticmethod
    def number(text: str) -> int | float:
        if re.fullmatch("[0-9]+", text):
            if int(text) >= 1 << 63:
                raise ExpressionError(f"integer {text} is out of range")
            return int(text)
        return float(text)

    def finished(self) -> None:
        if self.peek().kind != "end":
            self.fail("unexpected text")


def parse(text: str) -> Node:
    parser = Parser(text)
    node = parser.expression()
    parser.finished()
    return node


def statements(text: str) -> list[tuple[str, Node]]:
    """name = expression, parted by ; or line ends."""
    out = []
    for part in re.split(r"[;\n](?=(?:[^'\"]|'[^']*'|\"[^\"]*\")*$)", text):
        if not part.strip():
            continue
        m = re.match(r"\s*(`[^`]+`|[^\W0-9]\w*)\s*=(?!=)(.*)$", part, re.DOTALL)
        if not m:
            raise ExpressionError(f"expected name = expression, not {part.strip()!r}")
        out.append((m[1].strip("`"), parse(m[2])))
    return out


def like_pattern(pattern: str) -> str:
    """A regular expression for a LIKE pattern; backslash escapes %, _ and itself."""
    out, i = ["^"], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern) and pattern[i + 1] in "%_\\":
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append({"%": ".*", "_": "."}.get(c) or re.escape(c))
        i += 1
    return "".join(out) + r"\z"


# ------------------------------------------------------------------ columns


@dataclass
class Value:
    """A compiled operand. exact says that a boolean is never NULL."""

    column: Column
    kind: str
    floating: bool = False
    exact: bool = False
    literal: object = None
    is_literal: bool = False

    def missing(self) -> Column:
        return (self.column.isNull() | F.isnan(self.column)) if self.floating else self.column.isNull()

    def present(self) -> Column:
        return F.when(~F.isnan(self.column), self.column) if self.floating else self.column


@dataclass
class Compiler:
    """Trees to Columns over a schema. resolve maps (qualifier, name) to a column's name; extra
    compiles what the plain language lacks (aggregates, sub-queries)."""

    schema: T.StructType
    params: dict = field(default_factory=dict)
    resolve: Callable[[str | None, str], str] | None = None
    extra: Callable[[Node, Compiler], Value | None] | None = None

    def condition(self, node: Node) -> Column:
        """For a filter: NULL stands for false."""
        return self._boolean(node, bare=True).column

    def value(self, node: Node) -> Column:
        v = self._compile(node)
        return v.column if v.kind != "bool" or v.exact else F.coalesce(v.column, F.lit(False))

    def _boolean(self, node: Node, bare: bool) -> Value:
        if node.op in ("and", "or"):
            a, b = (self._boolean(x, bare) for x in node.args)
            return Value(a.column & b.column if node.op == "and" else a.column | b.column, "bool", exact=a.exact and b.exact)
        if node.op == "not":
            inner = self._boolean(node.args[0], bare=False)
            return Value(~inner.column, "bool", exact=True)
        v = self._compile(node)
        if v.kind != "bool":
            raise ExpressionError(f"expected a condition, not a {v.kind}")
        if bare or v.exact:
            return v
        return Value(F.coalesce(v.column, F.lit(False)), "bool", exact=True)

    def _compile(self, node: Node) -> Value:
        if self.extra and (found := self.extra(node, self)) is not None:
            return found
        op = node.op
        if op == "literal":
            return self._literal(node.value)
        if op == "parameter":
            if node.value not in self.params:
                raise ExpressionError(f"no parameter {node.value!r}")
            return self._literal(self.params[node.value])
        if op == "column":
            return self._column(*node.value)
        if op in ("and", "or", "not"):
            return self._boolean(node, bare=False)
        if op == "if":
            return self._if(node)
        if op in ("+", "-", "*", "/", "%", "negative"):
            return self._arithmetic(node)
        if op in ("==", "!=", "<", "<=", ">", ">="):
            return self._comparison(op, *(self._compile(x) for x in node.args))
        if op == "between":
            return self._between(node)
        if op == "like":
            return self._like(node)
        if op == "in":
            return self._in(node)
        if op == "is":
            return self._is(node)
        if op == "call" and node.value[0] in ("nvl", "coalesce", "ifnull") and len(node.args) >= 2:
            parts = [self._compile(x) for x in node.args]
            kinds = {p.kind for p in parts} - {"null"}
            if len(kinds) > 1:
                raise ExpressionError(f"{node.value[0]} of {' and '.join(sorted(kinds))}")
            return Value(F.coalesce(*[p.present() for p in parts]), (kinds or {"null"}).pop(), False)
        raise ExpressionError(f"unknown function {node.value[0]!r}" if op == "call" else f"{op!r} has no meaning here")

    def _literal(self, value) -> Value:
        import datetime

        if value is None or isinstance(value, float) and value != value:
            return Value(F.lit(None), "null", is_literal=True)
        kinds = {bool: "bool", str: "string", datetime.datetime: "time", datetime.date: "time"}
        kind = kinds.get(type(value), "number")
        return Value(F.lit(value), kind, exact=kind == "bool", literal=value, is_literal=True)

    def _column(self, qualifier: str | None, name: str) -> Value:
        actual = self.resolve(qualifier, name) if self.resolve else name
        for f in self.schema.fields:
            if f.name == actual:
                return Value(col(actual), kind_of(f.dataType), is_float(f.dataType))
        raise ExpressionError(f"unknown column {name!r}; there are {self.schema.names}")

    def _if(self, node: Node) -> Value:
        test = self._boolean(node.args[0], bare=True)
        yes, no = self._compile(node.args[1]), self._compile(node.args[2])
        kinds = {yes.kind, no.kind} - {"null"}
        if len(kinds) > 1:
            raise ExpressionError(f"a choice of {' or '.join(sorted(kinds))}")
        kind = (kinds or {"null"}).pop()
        return Value(F.when(test.column, yes.column).otherwise(no.column), kind, yes.floating or no.floating)

    def _arithmetic(self, node: Node) -> Value:
        parts = [self._compile(x) for x in node.args]
        if node.op == "+" and any(p.kind == "string" for p in parts):
            return Value(F.concat(*[p.column.cast("string") for p in parts]), "string")
        for p in parts:
            if p.kind not in ("number", "null"):
                raise ExpressionError(f"{node.op} of a {p.kind}")
        x = [p.present().cast("double") for p in parts]
        if node.op == "negative":
            return Value(-x[0], "number")
        a, b = x
        if node.op == "/":
            return Value(divided(a, b), "number", floating=True)
        if node.op == "%":
            return Value(F.when(b != 0, F.try_mod(a, b)).when(a.isNotNull() & b.isNotNull(), F.lit(float("nan"))), "number", True)
        return Value({"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b}[node.op](), "number", floating=True)

    def _comparison(self, op: str, a: Value, b: Value) -> Value:
        if "null" in (a.kind, b.kind):
            return Value(F.lit(op == "!="), "bool", exact=True)
        if {a.kind, b.kind} == {"time", "string"}:  # a time written as text
            a, b = (Value(v.column.cast("timestamp_ntz"), "time") if v.kind == "string" else v for v in (a, b))
        if a.kind != b.kind:
            if op in ("==", "!="):
                return Value(F.lit(op == "!="), "bool", exact=True)
            raise ExpressionError(f"{op} between a {a.kind} and a {b.kind}")
        x, y = a.column, b.column
        if op == "!=":
            off = (x != y) | a.missing() | b.missing()
            return Value(off, "bool", exact=False) if not (a.is_literal and b.is_literal) else Value(off, "bool")
        out = {"==": x == y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        for v in (a, b):  # Spark orders NaN above all numbers and equal to itself
            if v.floating and not v.is_literal:
                out = out & ~F.isnan(v.column)
        return Value(out, "bool")

    def _between(self, node: Node) -> Value:
        x, low, high = (self._compile(n) for n in node.args)
        for v in (x, low, high):
            if v.kind not in ("number", "time", "string", "null"):
                raise ExpressionError(f"between of a {v.kind}")
        inside = self._comparison(">=", x, low).column & self._comparison("<=", x, high).column
        if not node.value:
            return Value(inside, "bool")
        known = ~(x.missing() | low.missing() | high.missing())
        return Value(~F.coalesce(inside, F.lit(False)) & known, "bool", exact=True)

    def _like(self, node: Node) -> Value:
        x, pattern = (self._compile(n) for n in node.args)
        if x.kind not in ("string", "null") or pattern.kind not in ("string", "null"):
            raise ExpressionError(f"like of a {x.kind}")
        if pattern.is_literal and pattern.literal is not None:
            out = F.rlike(x.column, F.lit(like_pattern(pattern.literal)))
            if head := re.match(r"[^%_\\]+", pattern.literal):  # a prefix that scans can prune by
                out = x.column.startswith(head[0]) & out
        else:
            out = x.column.like(pattern.column)
        if node.value:
            out = F.coalesce(~out, F.lit(False))
        return Value(out, "bool")

    def _in(self, node: Node) -> Value:
        x, *items = (self._compile(n) for n in node.args)
        with_null = any(i.kind == "null" for i in items)
        items = [i for i in items if i.kind != "null"]
        plain = [i.literal for i in items if i.is_literal and i.kind == x.kind]
        found: Column | None = x.column.isin(plain) if plain else None
        if found is not None and x.floating:
            found = found & ~F.isnan(x.column)
        for i in items:
            if i.is_literal and i.kind == x.kind:
                continue
            same = F.coalesce(self._comparison("==", x, i).column, F.lit(False)) | (
                F.lit(False) if i.is_literal else x.missing() & i.missing()
            )
            found = same if found is None else F.coalesce(found, F.lit(False)) | same
        if with_null:
            found = x.missing() if found is None else F.coalesce(found, F.lit(False)) | x.missing()
        found = F.lit(False) if found is None else found
        return Value(~F.coalesce(found, F.lit(False)), "bool", exact=True) if node.value else Value(found, "bool")

    def _is(self, node: Node) -> Value:
        x = self._compile(node.args[0])
        what, negated = node.value
        if what == "null":
            out = x.missing()
        elif x.kind == "bool":
            out = x.column.eqNullSafe(F.lit(what == "true"))
        else:
            out = F.lit(False)
        return Value(~out if negated else out, "bool", exact=True)


def condition(text: str, schema: T.StructType, params: dict | None = None) -> Column:
    return Compiler(schema, params or {}).condition(parse(text))
