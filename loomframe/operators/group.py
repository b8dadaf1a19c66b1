"""Grouping and grouped aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.functions import values as V

AGGREGATES = ("count", "nunique", "sum", "mean", "avg", "min", "max", "first", "last", "median", "std", "var")


def aggregate(df: DataFrame, name: str, fn: str, order: list[str], sums: str = "double", distinct: bool = False) -> Column:
    """fn over a column, missing values passed over. sums: 'double' for sums and extremes as doubles
    (grouped aggregates), 'native' for those in the column's own kind (pivots and resampling)."""
    if fn not in AGGREGATES:
        raise V.FrameError(f"unknown aggregate {fn!r}; there are {list(AGGREGATES)}")
    kind = V.field(df, name).dataType
    what, c = V.kind_of(kind), V.present(df, name)
    if fn == "count":
        return F.count_distinct(c) if distinct else F.count(c)
    if fn == "nunique":
        return F.count_distinct(c + F.lit(0.0) if V.is_float(kind) else c)
    if fn in ("first", "last"):
        if not order:
            raise V.FrameError(f"{fn} needs an order; give the frame order_by")
        key = F.struct(*map(V.col, order)) if len(order) > 1 else V.col(order[0])
        key = F.when(c.isNotNull(), key)
        return (F.min_by if fn == "first" else F.max_by)(c, key)
    if what == "string" and fn == "sum":
        if order:
            parts = F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct(*map(V.col, order), c.alias("value_")))))
            return F.array_join(F.transform(parts, lambda x: x["value_"]), "")
        raise V.FrameError("a sum of text needs an order; give the frame order_by")
    if what == "time" and fn in ("min", "max") and sums == "native":
        return F.min(c) if fn == "min" else F.max(c)
    if what == "bool" and fn == "sum":
        return F.coalesce(F.sum(c.cast("int").cast("long")), F.lit(0).cast("long"))
    x = V.as_double(df, name)
    if fn == "sum":
        if sums == "native" and V.is_number(kind) and not V.is_float(kind):
            return F.sum(c.cast("long"))
        total = F.sum_distinct(x) if distinct else F.sum(x)
        return F.coalesce(total, F.lit(0.0)) if sums == "double" else total
    if fn in ("mean", "avg"):
        return F.avg(x)
    if fn in ("min", "max"):
        y = c if sums == "native" else x
        return F.min(y) if fn == "min" else F.max(y)
    return {"median": F.median, "std": F.stddev_samp, "var": F.var_samp}[fn](x)


class GroupBy:
    """Null keys form a group; NaN keys count as null, and -0.0 as 0.0."""

    def __init__(self, frame, names: list[str]):
        self.frame, self.names = frame, names
        self.df: DataFrame = frame.df
        for n in names:
            V.field(self.df, n)

    def _keys(self) -> list[Column]:
        return [(V.present(self.df, n) + F.lit(0.0) if V.is_float(V.field(self.df, n).dataType) else V.col(n)).alias(n) for n in self.names]

    def _first_seen(self) -> list[Column]:
        """Groups come in the order of first appearance where the frame has an order."""
        order = self.frame.order_by
        if not order:
            return []
        key = F.struct(*map(V.col, order)) if len(order) > 1 else V.col(order[0])
        return [F.min(key).alias("__first__")]

    def agg(self, spec: dict[str, str | list[str]] | str, fn: str | None = None, ordered: bool = False):
        """Columns <column>_<fn>; a column may have several functions. ordered: sort the groups by
        first appearance, which the frame's order gives."""
        spec = {spec: fn} if isinstance(spec, str) else spec
        wanted = [(c, f) for c, fs in spec.items() for f in ([fs] if isinstance(fs, str) else fs)]
        parts = [aggregate(self.df, c, f, self.frame.order_by).alias(f"{c}_{f}") for c, f in wanted]
        return self._finished(self.df.groupBy(*self._keys()).agg(*parts, *(self._first_seen() if ordered else [])), ordered)

    def _finished(self, out: DataFrame, ordered: bool):
        if not ordered:
            return self.frame._with(out, [])
        if not self.frame.order_by:
            raise V.FrameError("first appearance needs an order; give the frame order_by")
        return self.frame._with(out.orderBy("__first__"), ["__first__"])

    def size(self, ordered: bool = False):
        more = self._first_seen() if ordered else []
        return self._finished(self.df.groupBy(*self._keys()).agg(F.count("*").alias("size"), *more), ordered)

    def group_count(self) -> int:
        return self.df.select(*self._keys()).distinct().count()

    def agg_python(self, name: str, fn: Callable, new: str, kind: str = "double"):
        """An aggregate of one's own: fn(pandas series of the group's present values) -> a value. A group
        must fit one task's memory, as Spark cannot take such a function apart."""
        @F.pandas_udf(kind)
        def made(x: pd.Series) -> float:
            return fn(x.dropna())

        return self.frame._with(self.df.groupBy(*self._keys()).agg(made(V.present(self.df, name)).alias(new)), [])

    def filter(self, name: str, fn: str, keep: Callable[[Column], Column]):
        """Rows of the groups whose aggregate keep() accepts. The aggregate is joined back, so a
        large group is never one task's."""
        value = V.fresh(self.df.columns, "value_")
        groups = self.df.groupBy(*self._keys()).agg(aggregate(self.df, name, fn, self.frame.order_by).alias(value))
        kept = groups.where(F.coalesce(keep(V.col(value)), F.lit(False)))
        return self.frame._with(self._joined(kept.drop(value), semi=True))

    def transform(self, name: str, fn: str, new: str | None = None):
        """The group's aggregate on each of its rows, as new."""
        new = new or f"{name}_{fn}"
        groups = self.df.groupBy(*self._keys()).agg(aggregate(self.df, name, fn, self.frame.order_by).alias(new))
        return self.frame._with(self._joined(groups, semi=False))

    transform_as_column = transform

    def _joined(self, groups: DataFrame, semi: bool) -> DataFrame:
        keys = {n: V.fresh([*self.df.columns, *groups.columns], f"key_{i}") for i, n in enumerate(self.names)}
        right = groups.withColumnsRenamed(keys)
        condition = None
        for n, k in keys.items():
            own = V.present(self.df, n) + F.lit(0.0) if V.is_float(V.field(self.df, n).dataType) else V.col(n)
            part = own.eqNullSafe(V.col(k))
            condition = part if condition is None else condition & part
        return self.df.drop(*[c for c in right.columns if c not in keys.values()]).join(
            right, condition, "left_semi" if semi else "inner"
        ).drop(*keys.values())

    def iter_groups(self) -> Iterator[tuple]:
        """(key, frame of the group's rows), a group at a time; for few groups."""
        for row in self.df.select(*self._keys()).distinct().toLocalIterator():
            condition = None
            for n, v in zip(self.names, row, strict=True):
                part = V.present(self.df, n).eqNullSafe(F.lit(v))
                condition = part if condition is None else condition & part
            yield (row[0] if len(row) == 1 else tuple(row)), self.frame._with(self.df.where(condition))

    def apply(self, fn: Callable, schema: str | T.StructType):
        """fn(pandas frame) -> pandas frame for each group, which must fit one task's memory."""
        return self.frame._with(self.df.groupBy(*self._keys()).applyInPandas(fn, schema), [])

    # ---- beyond plain groups
    def rollup(self, spec: dict[str, str]):
        return self._sets(self.df.rollup(*self._keys()), spec)

    def cube(self, spec: dict[str, str]):
        return self._sets(self.df.cube(*self._keys()), spec)

    def _sets(self, grouped, spec):
        parts = [aggregate(self.df, c, f, self.frame.order_by).alias(f"{c}_{f}") for c, f in spec.items()]
        return self.frame._with(grouped.agg(*parts, F.grouping_id().alias("grouping_id")), [])


class GroupOps:
    df: DataFrame

    def group_by(self, *names: str) -> GroupBy:
        return GroupBy(self, list(names))

    groupby = group_by
