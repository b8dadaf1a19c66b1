"""Arithmetic, text and time functions of columns, and Python functions over them."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.functions import values as V


class TextOf:
    """Text functions of a column. Values that are not text are taken as their text."""

    def __init__(self, frame, name: str):
        self.c = V.col(name).cast("string")
        V.field(frame.df, name)

    def upper(self) -> Column:
        return F.upper(self.c)

    def lower(self) -> Column:
        return F.lower(self.c)

    def trim(self) -> Column:
        return F.trim(self.c)

    strip = trim

    def contains(self, part: str) -> Column:
        return F.coalesce(F.contains(self.c, F.lit(part)), F.lit(False))

    def starts_with(self, part: str) -> Column:
        return F.coalesce(self.c.startswith(part), F.lit(False))

    def ends_with(self, part: str) -> Column:
        return F.coalesce(self.c.endswith(part), F.lit(False))

    def replace(self, old: str, new: str) -> Column:
        return F.replace(self.c, F.lit(old), F.lit(new))

    def length(self) -> Column:
        """In code points."""
        return F.length(self.c)

    # Those that give missing for missing.
    def repeat(self, n: int) -> Column:
        return F.repeat(self.c, F.lit(n))

    def slice(self, start: int, end: int) -> Column:
        return F.substr(self.c, F.lit(start + 1), F.lit(max(0, end - start)))

    def replace_regex(self, pattern: str, new: str) -> Column:
        return F.regexp_replace(self.c, pattern, new)

    def pad_left(self, width: int, fill: str = " ") -> Column:
        return F.when(F.length(self.c) >= width, self.c).otherwise(F.lpad(self.c, width, fill))

    def pad_right(self, width: int, fill: str = " ") -> Column:
        return F.when(F.length(self.c) >= width, self.c).otherwise(F.rpad(self.c, width, fill))

    def contains_regex(self, pattern: str) -> Column:
        return self.c.rlike(pattern)

    def equals_ignore_case(self, other: str) -> Column:
        return F.lower(self.c) == other.lower()

    def cat(self, other: Column, separator: str = "") -> Column:
        return F.concat(self.c, F.lit(separator), other.cast("string"))


class TimeOf:
    """Parts of a time, as doubles; Monday is day 1 of the week."""

    def __init__(self, frame, name: str):
        self.c, self.kind = V.col(name), V.field(frame.df, name).dataType
        if V.kind_of(self.kind) != "time":
            raise V.FrameError(f"column {name!r} is not a time")

    def _clock(self, part: Column) -> Column:
        if isinstance(self.kind, T.DateType):
            raise V.FrameError("a date has no time of day")
        return part.cast("double")

    def year(self) -> Column:
        return F.year(self.c).cast("double")

    def month(self) -> Column:
        return F.month(self.c).cast("double")

    def day(self) -> Column:
        return F.day(self.c).cast("double")

    def hour(self) -> Column:
        return self._clock(F.hour(self.c))

    def minute(self) -> Column:
        return self._clock(F.minute(self.c))

    def second(self) -> Column:
        return self._clock(F.second(self.c))

    def day_of_week(self) -> Column:
        return (F.weekday(self.c) + 1).cast("double")

    def day_of_year(self) -> Column:
        return F.dayofyear(self.c).cast("double")


class ColumnOps:
    df: DataFrame

    def str(self, name: str) -> TextOf:
        return TextOf(self, name)

    def dt(self, name: str) -> TimeOf:
        return TimeOf(self, name)

    # ---- arithmetic: doubles, missing with missing, infinities for divisions by 0
    def _operand(self, x) -> Column:
        return V.as_double(self.df, x) if isinstance(x, str) else F.lit(float(x))

    def _arith(self, new: str, a, b, op: str):
        x, y = self._operand(a), self._operand(b)
        made = {"add": lambda: x + y, "sub": lambda: x - y, "mul": lambda: x * y, "div": lambda: V.divided(x, y)}[op]()
        return self._with(self.df.withColumn(new, made))

    def col_add(self, new, a, b):
        return self._arith(new, a, b, "add")

    def col_sub(self, new, a, b):
        return self._arith(new, a, b, "sub")

    def col_mul(self, new, a, b):
        return self._arith(new, a, b, "mul")

    def col_div(self, new, a, b):
        return self._arith(new, a, b, "div")

    def _scalar_all(self, s: float, op: str):
        out = self
        for n in V.numeric_columns(self.df):
            out = out._arith(f"{n}_{op}", n, s, op)
        return out

    def add_scalar_all_columns(self, s):
        return self._scalar_all(s, "add")

    def sub_scalar_all_columns(self, s):
        return self._scalar_all(s, "sub")

    def mul_scalar_all_columns(self, s):
        return self._scalar_all(s, "mul")

    def div_scalar_all_columns(self, s):
        return self._scalar_all(s, "div")

    def abs(self):
        return self._with(self.df.withColumns({n: F.abs(V.as_double(self.df, n)) for n in V.numeric_columns(self.df) if n not in self.order_by}))

    def col_clip(self, name, low=None, high=None, new=None):
        x = V.as_double(self.df, name)
        y = x if low is None else F.greatest(x, F.lit(float(low)))
        y = y if high is None else F.least(y, F.lit(float(high)))
        return self._with(self.df.withColumn(new or f"{name}_clip", F.when(x.isNotNull(), y)))

    def col_round(self, name, digits: int = 0, new=None):
        """Half to even, on the value times a power of ten."""
        scale = F.lit(10.0**digits)
        return self._with(self.df.withColumn(new or f"{name}_round", F.rint(V.as_double(self.df, name) * scale) / scale))

    # ---- zones
    def tz_localize(self, name: str, zone: str):
        """A zone-less time becomes the instant that clocks in zone show so; the zone is noted."""
        if not isinstance(V.field(self.df, name).dataType, T.TimestampNTZType):
            raise V.FrameError(f"column {name!r} is not a zone-less time")
        instant = F.convert_timezone(F.lit(zone), F.lit("UTC"), V.col(name))
        return self._with(self.df.withColumn(name, instant.alias(name, metadata={"zone": zone, "utc": True})))

    def tz_convert(self, name: str, zone: str):
        """Another zone for a localised column; the instants stay."""
        field = V.field(self.df, name)
        if "zone" not in (field.metadata or {}):
            raise V.FrameError(f"column {name!r} is not localised")
        return self._with(self.df.withColumn(name, V.col(name).alias(name, metadata={**field.metadata, "zone": zone})))

    def tz_text(self, name: str, new: str | None = None):
        """A localised column as its zone's clocks show it."""
        zone = (V.field(self.df, name).metadata or {}).get("zone")
        if zone is None:
            raise V.FrameError(f"column {name!r} is not localised")
        return self._with(self.df.withColumn(new or name, F.convert_timezone(F.lit("UTC"), F.lit(zone), V.col(name))))

    # ---- JSON texts
    def json_value(self, name: str, path: str, new: str, kind: str = "string"):
        """What stands at path ($.a.b, $.a[0]) of a column of JSON texts; missing if nothing does, the
        text is no JSON, or it is not of the kind."""
        return self._with(self.df.withColumn(new, F.get_json_object(V.col(name), path).try_cast(kind)))

    def json_keys(self, name: str, new: str):
        """The keys of a column of JSON objects, in their order."""
        return self._with(self.df.withColumn(new, F.json_object_keys(V.col(name))))

    # ---- Python functions, in Arrow batches
    def apply_table(self, fn: Callable[[tuple], object], schema: str | T.StructType):
        """A table function: the rows that fn yields for each row's cells."""
        names, kind = self.df.columns, schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)

        def run(parts):
            for part in parts:
                rows = [tuple(x) for r in part[names].itertuples(index=False, name=None) for x in fn(tuple(r))]
                yield pd.DataFrame(rows, columns=kind.names)

        return self._with(self.df.mapInPandas(run, kind), [])

    def apply_numeric(self, name: str, fn: Callable[[float], float], new: str | None = None):
        """fn over the present values of a numeric column."""
        @F.pandas_udf("double")
        def mapped(x: pd.Series) -> pd.Series:
            return x.map(fn, na_action="ignore").astype("float64")

        return self._with(self.df.withColumn(new or name, mapped(V.as_double(self.df, name))))

    def apply_str(self, name: str, fn: Callable[[object], str | None], new: str | None = None):
        """fn over every value; a missing one is None."""
        @F.pandas_udf("string")
        def mapped(x: pd.Series) -> pd.Series:
            return pd.Series([fn(None if pd.isna(v) else v) for v in x], dtype="object")

        return self._with(self.df.withColumn(new or name, mapped(V.present(self.df, name))))

    def apply_row(self, new: str, fn: Callable[[tuple], object], kind: str | T.DataType = "double"):
        """fn over each row's cells, as a tuple."""
        @F.pandas_udf(kind)
        def mapped(rows: pd.DataFrame) -> pd.Series:
            return pd.Series([fn(tuple(r)) for r in rows.itertuples(index=False, name=None)])

        return self._with(self.df.withColumn(new, mapped(F.struct(*map(V.col, self.df.columns)))))

    def assign_by_row(self, name: str, fn: Callable[[int], object], kind: str | T.DataType = "double"):
        """fn over row numbers from 0, in the frame's order."""
        from loomframe.operators import ordered

        @F.pandas_udf(kind)
        def mapped(rows: pd.Series) -> pd.Series:
            return pd.Series([fn(int(r)) for r in rows])

        row = V.fresh([*self.df.columns, name], "row_")
        return self._with(ordered.numbered(self.df, self.order(), row).withColumn(name, mapped(V.col(row))).drop(row))
