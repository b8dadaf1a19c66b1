"""Missing data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.functions import values as V


def filled(df: DataFrame, name: str, value) -> object:
    kind = V.field(df, name).dataType
    what = V.kind_of(kind)
    fits = {
        "number": isinstance(value, (int, float)) and not isinstance(value, bool),
        "bool": isinstance(value, bool),
        "string": True,
        "time": value is not None and not isinstance(value, (bool, int, float)),
    }.get(what, False)
    if not fits:
        raise V.FrameError(f"{value!r} does not fit column {name!r} ({kind.simpleString()})")
    if what == "string":
        value = {True: "true", False: "false"}.get(value, str(value)) if isinstance(value, bool) else str(value)
    elif what == "number" and not V.is_float(kind) and float(value) != int(value):
        raise V.FrameError(f"{value!r} does not fit the whole numbers of {name!r}")
    return F.coalesce(V.present(df, name), F.lit(value).cast(kind)).alias(name)


class MissingOps:
    df: DataFrame

    def isna(self):
        """A frame of booleans; a NaN is missing."""
        return self._with(self.df.select(*[V.missing(self.df, n).alias(n) for n in self.df.columns]), [])

    def notna(self):
        return self._with(self.df.select(*[(~V.missing(self.df, n)).alias(n) for n in self.df.columns]), [])

    isnull, notnull = isna, notna

    def dropna(self, how: str = "any", subset: Sequence[str] | None = None):
        if how not in ("any", "all"):
            raise V.FrameError("how is any or all")
        names = list(subset or self.df.columns)
        keep = None
        for n in names:
            there = ~V.missing(self.df, n)
            keep = there if keep is None else keep & there if how == "any" else keep | there
        return self._with(self.df.where(keep))

    def fillna(self, value):
        """One value for every column, or a value for each of some; a value that does not fit raises."""
        if isinstance(value, dict):
            for n in value:
                V.field(self.df, n)
            return self._with(self.df.select(*[filled(self.df, n, value[n]) if n in value else V.col(n) for n in self.df.columns]))
        return self._with(self.df.select(*[filled(self.df, n, value) for n in self.df.columns]))

    def fill_missing_like(self, kind: T.DataType, value):
        """The columns of one kind only."""
        return self.fillna({f.name: value for f in self.df.schema.fields if f.dataType == kind})
