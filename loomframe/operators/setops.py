"""Unions by name, and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.functions import values as V


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """Of two columns that are stacked: the wider number, else text where kinds differ."""
    if a == b:
        return a
    if isinstance(a, T.NullType) or isinstance(b, T.NullType):
        return b if isinstance(a, T.NullType) else a
    if V.is_number(a) and V.is_number(b):
        if V.is_float(a) or V.is_float(b) or isinstance(a, T.DecimalType) or isinstance(b, T.DecimalType):
            return T.DoubleType()
        return T.LongType() if T.LongType() in (a, b) else T.IntegerType()
    if {type(a), type(b)} <= {T.DateType, T.TimestampNTZType}:
        return T.TimestampNTZType()
    return T.StringType()


def stacked(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns by name, in order of first sight; those that one side lacks are missing there."""
    names = [*a.columns, *[n for n in b.columns if n not in a.columns]]

    def fitted(df: DataFrame) -> DataFrame:
        out = []
        for n in names:
            kinds = [x.schema[n].dataType for x in (a, b) if n in x.columns]
            kind = common_type(*kinds) if len(kinds) == 2 else kinds[0]
            out.append((V.col(n) if n in df.columns else F.lit(None)).cast(kind).alias(n))
        return df.select(*out)

    return fitted(a).unionAll(fitted(b))


class SetOps:
    df: DataFrame

    def concat(self, *others):
        """Rows of all frames, by name. The order, if all share it, is then by frame and order key."""
        df = self.df
        for o in others:
            df = stacked(df, o.df)
        return self._with(df, self.order_by if all(o.order_by == self.order_by for o in others) else [])

    union_all = concat

    def union(self, *others):
        return self._with(self.concat(*others).df.distinct(), [])

    def intersect(self, other):
        """By position, distinct; nulls equal each other."""
        self._same_width(other)
        return self._with(self.df.intersect(other.df), [])

    def subtract(self, other):
        self._same_width(other)
        return self._with(self.df.subtract(other.df), [])

    except_ = minus = subtract

    def intersect_all(self, other):
        self._same_width(other)
        return self._with(self.df.intersectAll(other.df), [])

    def except_all(self, other):
        self._same_width(other)
        return self._with(self.df.exceptAll(other.df), [])

    def distinct(self):
        return self._with(self.df.distinct())

    def _same_width(self, other):
        if len(self.df.columns) != len(other.df.columns):
            raise V.FrameError(f"{len(self.df.columns)} columns against {len(other.df.columns)}")
