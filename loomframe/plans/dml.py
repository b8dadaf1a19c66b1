"""INSERT, UPDATE and DELETE: a new frame and the number of rows concerned."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.functions.expressions import Compiler, Node
from loomframe.functions.values import FrameError, col, field, fresh
from loomframe.plans.sql import SqlParser


def execute(frame, text: str, params: dict | None = None):
    """Statements on this. UPDATE and DELETE need a WHERE. Values come from the old rows."""
    parser = SqlParser(text.strip().rstrip(";"))
    word = parser.take().word()
    made = {"insert": _insert, "update": _update, "delete": _delete}
    if word not in made:
        raise FrameError(f"expected INSERT, UPDATE or DELETE, not {text.strip().split()[0]!r}")
    return made[word](frame, parser, params or {})


def _table(parser: SqlParser) -> None:
    if parser.peek().kind == "param":
        parser.take()
    else:
        parser.name()


def _insert(frame, parser: SqlParser, params: dict):
    parser.expect("into")
    _table(parser)
    if not parser.is_op("("):
        raise FrameError("INSERT needs its list of columns")
    parser.expect("(")
    names = [parser.name()]
    while parser.accept(","):
        names.append(parser.name())
    parser.expect(")")
    for n in names:
        field(frame.df, n)
    parser.expect("values")
    rows = []
    while True:
        parser.expect("(")
        values = [parser.expression()]
        while parser.accept(","):
            values.append(parser.expression())
        parser.expect(")")
        if len(values) != len(names):
            raise FrameError(f"{len(values)} values for {len(names)} columns")
        rows.append(values)
        if not parser.accept(","):
            break
    parser.finished()
    compiler = Compiler(T.StructType(), params)
    one = frame.spark.range(1)
    kinds = {f.name: f.dataType for f in frame.df.schema.fields}
    shaped = [
        F.struct(*[(compiler.value(dict(zip(names, r, strict=True))[n]) if n in names else F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])
        for r in rows
    ]
    new = one.select(F.explode(F.array(*shaped)).alias("r")).select("r.*")
    return frame._with(frame.df.unionByName(new)), len(rows)


def _update(frame, parser: SqlParser, params: dict):
    _table(parser)
    parser.expect("set")
    sets: dict[str, Node] = {}
    while True:
        name = parser.name()
        field(frame.df, name)
        parser.expect("=", "==")
        sets[name] = parser.expression()
        if not parser.accept(","):
            break
    condition = _where(frame, parser, params)
    compiler = Compiler(frame.df.schema, params)
    hit = fresh(frame.df.columns, "hit_")
    marked = frame.df.withColumn(hit, F.coalesce(condition, F.lit(False)))
    new = {n: F.when(col(hit), compiler.value(v)).otherwise(col(n)).cast(field(frame.df, n).dataType) for n, v in sets.items()}
    return frame._with(marked.withColumns(new).drop(hit)), frame.df.where(condition).count()


def _delete(frame, parser: SqlParser, params: dict):
    parser.expect("from")
    _table(parser)
    condition = _where(frame, parser, params)
    return frame._with(frame.df.where(~F.coalesce(condition, F.lit(False)))), frame.df.where(condition).count()


def _where(frame, parser: SqlParser, params: dict):
    if not parser.accept("where"):
        raise FrameError("UPDATE and DELETE need a WHERE")
    node = parser.expression()
    parser.finished()
    return Compiler(frame.df.schema, params).condition(node)
