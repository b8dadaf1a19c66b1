"""Pivots, melts, transposition and explode."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.functions import values as V
from loomframe.operators.group import aggregate

#: Most columns that a pivot makes; more raise, as they would not fit a row.
MOST_COLUMNS = 10_000


class ReshapeOps:
    df: DataFrame

    def _pivot_values(self, name: str, first_seen: bool) -> list:
        key = V.col(name)
        if first_seen and self.order_by:
            order = F.struct(*map(V.col, self.order_by))
            seen = self.df.where(~V.missing(self.df, name)).groupBy(key).agg(F.min(order).alias("f")).orderBy("f")
        else:
            seen = self.df.where(~V.missing(self.df, name)).select(key).distinct().orderBy(key)
        rows = seen.limit(MOST_COLUMNS + 1).collect()
        if len(rows) > MOST_COLUMNS:
            raise V.FrameError(f"{name!r} has more than {MOST_COLUMNS} values")
        return [r[0] for r in rows]

    def pivot_table(self, index: str, columns: str, values: str, agg: str = "mean"):
        """Rows with a missing index or column key are left out; the new columns come in the order of
        first appearance where the frame has an order, else sorted."""
        if agg not in ("count", "nunique", "sum", "mean", "min", "max", "first", "last"):
            raise V.FrameError(f"unknown aggregate {agg!r}")
        names = self._pivot_values(columns, True)
        rows = self.df.where(~V.missing(self.df, index) & ~V.missing(self.df, columns))
        order = [F.min(F.struct(*map(V.col, self.order_by))).alias("f_")] if self.order_by else []
        made = rows.groupBy(V.col(index)).pivot(columns, names).agg(aggregate(self.df, values, agg, self.order_by, sums="native"))
        if not order:
            return self._with(made, [])
        first = rows.groupBy(V.col(index).alias("i_")).agg(*order)
        joined = made.join(first, V.col(index) == F.col("i_")).drop("i_").withColumnRenamed("f_", "__first__")
        return self._with(joined, ["__first__"])

    def pivot(self, index: str, columns: str, values: str):
        """One value for each pair, or an error; new columns sorted."""
        pairs = self.df.groupBy(V.col(index), V.col(columns)).count().where("count > 1")
        if not pairs.isEmpty():
            raise V.FrameError(f"{index!r} and {columns!r} do not name one row each")
        names = self._pivot_values(columns, False)
        return self._with(self.df.groupBy(V.col(index)).pivot(columns, names).agg(F.first(V.col(values), ignorenulls=True)), [])

    unstack = pivot

    def melt(self, ids: Sequence[str], values: Sequence[str] | None = None, variable: str = "variable", value: str = "value"):
        """Columns of one kind keep it; numbers widen; other mixtures become text."""
        from loomframe.operators.setops import common_type

        values = list(values or [n for n in self.df.columns if n not in ids])
        kind = V.field(self.df, values[0]).dataType
        for n in values[1:]:
            kind = common_type(kind, V.field(self.df, n).dataType)
        rows = self.df.select(*map(V.col, ids), *[V.col(n).cast(kind).alias(n) for n in values])
        return self._with(rows.unpivot(list(ids), values, variable, value), [])

    stack = melt

    def transpose(self, most_rows: int = 10_000):
        """_index and a column for each row, named 0, 1, ...; for frames of at most most_rows rows."""
        rows = self.df.limit(most_rows + 1).count()
        if rows > most_rows:
            raise V.FrameError(f"more than {most_rows} rows do not fit as columns")
        from loomframe.operators import ordered
        from loomframe.operators.setops import common_type

        row = V.fresh(self.df.columns, "row_")
        kind: T.DataType = T.NullType()
        for f in self.df.schema.fields:
            kind = common_type(kind, f.dataType)
        numbered = ordered.numbered(self.df, self.order(), row)
        cells = numbered.select(V.col(row), *[V.col(n).cast(kind).alias(n) for n in self.df.columns])
        long = cells.unpivot([row], list(self.df.columns), "_index", "v_")
        made = long.groupBy("_index").pivot(row, list(range(rows))).agg(F.first("v_", ignorenulls=True))
        place = F.array_position(F.array(*map(F.lit, self.df.columns)), F.col("_index"))
        return self._with(made.withColumn("__at__", place), ["__at__"])

    T = transpose

    def explode(self, name: str):
        """A row for each element; a missing or empty list keeps its row, with a missing element."""
        if not isinstance(V.field(self.df, name).dataType, T.ArrayType):
            return self._with(self.df)
        return self._with(self.df.select(*[F.explode_outer(V.col(n)).alias(n) if n == name else V.col(n) for n in self.df.columns]))
