"""Row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.functions import expressions as E
from loomframe.functions import values as V
from loomframe.operators import ordered

_OPS = {">": "col_gt", "<": "col_lt", ">=": "col_ge", "<=": "col_le", "==": "col_eq", "!=": "col_ne"}


class FilterOps:
    df: DataFrame

    def filter(self, mask: Column | Sequence[bool]):
        """By a condition, or by a mask as long as the frame, in the frame's order."""
        if isinstance(mask, Column):
            return self._with(self.df.where(mask))
        mask = list(mask)
        row, keep = (V.fresh(self.df.columns, n) for n in ("row_", "keep_"))
        if self.df.count() != len(mask):
            raise V.FrameError(f"a mask of {len(mask)} for {self.df.count()} rows")
        rows = self.spark.createDataFrame([(i, bool(m)) for i, m in enumerate(mask)], f"`{row}` long, `{keep}` boolean")
        kept = ordered.numbered(self.df, self.order(), row).join(rows.where(V.col(keep)).select(V.col(row)), row, "left_semi")
        return self._with(kept.drop(row))

    def query(self, text: str, **params):
        return self._with(self.df.where(E.condition(text, self.df.schema, params)))

    def eval(self, text: str, **params):
        """name = expression statements; later ones see earlier ones. Kinds are the expressions' own."""
        out = self.df
        for name, node in E.statements(text):
            out = out.withColumn(name, E.Compiler(out.schema, params).value(node))
        return self._with(out)

    def compare(self, name: str, op: str, value) -> Column:
        """The comparison as a condition without NULL."""
        if op not in (*_OPS, "=", "<>"):
            raise V.FrameError(f"unknown comparison {op!r}")
        op = {"=": "==", "<>": "!="}.get(op, op)
        node = E.Node(op, (E.Node("column", value=(None, name)), E.Node("literal", value=value)))
        return E.Compiler(self.df.schema).value(node)

    def col_gt(self, name, value):
        return self.compare(name, ">", value)

    def col_lt(self, name, value):
        return self.compare(name, "<", value)

    def col_ge(self, name, value):
        return self.compare(name, ">=", value)

    def col_le(self, name, value):
        return self.compare(name, "<=", value)

    def col_eq(self, name, value):
        return self.compare(name, "==", value)

    def col_ne(self, name, value):
        return self.compare(name, "!=", value)

    def col_isin(self, name: str, *wanted) -> Column:
        """NaN is in if asked for; a NULL never is."""
        nan = any(isinstance(w, float) and w != w for w in wanted)
        kind = V.kind_of(V.field(self.df, name).dataType)
        plain = [w for w in wanted if w is not None and w == w and E.Compiler(T.StructType())._literal(w).kind == kind]
        out = F.coalesce(V.present(self.df, name).isin(plain), F.lit(False)) if plain else F.lit(False)
        if nan and V.is_float(V.field(self.df, name).dataType):
            out = out | F.coalesce(F.isnan(V.col(name)), F.lit(False))
        return out

    def isin(self, *wanted):
        """A frame of booleans."""
        return self._with(self.df.select(*[self.col_isin(n, *wanted).alias(n) for n in self.df.columns]), [])

    def between(self, name: str, low, high) -> Column:
        return F.coalesce(V.present(self.df, name).between(low, high), F.lit(False))

    def _replace(self, condition: Column, other, keep: bool):
        out = []
        for f in self.df.schema.fields:
            c, fill = V.col(f.name), F.lit(other)
            if other is not None and E.Compiler(T.StructType())._literal(other).kind != V.kind_of(f.dataType):
                raise V.FrameError(f"{other!r} does not fit column {f.name!r}")
            met = F.coalesce(condition, F.lit(False))
            out.append((F.when(met, c).otherwise(fill) if keep else F.when(met, fill).otherwise(c)).cast(f.dataType).alias(f.name))
        return self._with(self.df.select(*out))

    def where(self, condition: Column, other=None):
        return self._replace(condition, other, keep=True)

    def mask(self, condition: Column, other=None):
        return self._replace(condition, other, keep=False)

    # ---- by position
    def head(self, n: int = 5):
        if n < 0:
            return self.slice(0, max(0, self.df.count() + n))
        return self._with(self.df.orderBy(*ordered.order_columns(self.order())).limit(n))

    def tail(self, n: int = 5):
        if n < 0:
            return self.slice(-n, None)
        back = [V.col(c).desc_nulls_first() for c in self.order()]
        return self._with(self.df.orderBy(*back).limit(n))

    def slice(self, start: int, end: int | None = None):
        """Negative positions count from the end; positions are clamped."""
        if start < 0 or end is None or end < 0:
            count = self.df.count()
            start = max(0, start + count) if start < 0 else start
            end = count if end is None else max(0, end + count) if end < 0 else end
        rows = self.df.orderBy(*ordered.order_columns(self.order()))
        return self._with(rows.limit(0) if start >= end else rows.offset(start).limit(end - start))

    def sample(self, n: int, replace: bool = False, seed: int = 0):
        """n rows by a seeded hash of the order key, so that a rerun draws the same ones."""
        key = F.xxhash64(F.lit(seed), *map(V.col, self.order()))
        if not replace:
            return self._with(self.df.orderBy(key, *ordered.order_columns(self.order())).limit(n))
        count, row = self.df.count(), V.fresh(self.df.columns, "row_")
        draw = V.fresh([*self.df.columns, row], "draw_")
        drawn = self.spark.range(n).select(
            F.col("id").alias(draw), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(count, 1))).alias(row)
        )
        got = ordered.numbered(self.df, self.order(), row).join(drawn, row).drop(row)
        return self._with(got, [draw])

    # ---- by time
    def _clock(self, name: str) -> Column:
        return F.date_format(V.col(name), "HH:mm:ss.SSSSSS")

    def at_time(self, name: str, time: str):
        return self.between_time(name, time, time)

    def between_time(self, name: str, start: str, end: str):
        """Both ends belong; start after end wraps over midnight."""
        low, high = (_full_clock(t) for t in (start, end))
        clock = self._clock(name)
        inside = (clock >= low) & (clock <= high) if low <= high else (clock >= low) | (clock <= high)
        return self._with(self.df.where(inside))

    def asof(self, name: str, label):
        """The last row, in row order, whose time is not after label."""
        found = self.df.where(V.col(name) <= F.lit(label).cast(V.field(self.df, name).dataType))
        return self._with(found).tail(1)


def _full_clock(text: str) -> str:
    parts = text.split(":")
    seconds, _, fraction = (parts[2] if len(parts) > 2 else "0").partition(".")
    return f"{int(parts[0]):02d}:{int(parts[1]):02d}:{int(seconds):02d}.{(fraction + '000000')[:6]}"
