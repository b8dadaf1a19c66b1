"""Rules for missing values, kinds and names that all operators share.

A NULL is missing, and so is a NaN in a float column. Rather than rewrite columns when they are
read, which would keep predicates from the scan, operators ask for present values where they use
them; comparisons keep the bare column in front.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATS = (T.FloatType, T.DoubleType)
NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)


class FrameError(ValueError):
    """A request that the frame cannot fulfil: an unknown column, a wrong kind, a missing order."""


def field(df: DataFrame, name: str) -> T.StructField:
    for f in df.schema.fields:
        if f.name == name:
            return f
    raise FrameError(f"unknown column {name!r}; there are {df.columns}")


def is_float(kind: T.DataType) -> bool:
    return isinstance(kind, FLOATS)


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, NUMBERS)


def kind_of(kind: T.DataType) -> str:
    """number, bool, string, time, array or other."""
    if is_number(kind):
        return "number"
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    if isinstance(kind, TEMPORAL):
        return "time"
    return "array" if isinstance(kind, T.ArrayType) else "other"


def col(name: str) -> Column:
    """By exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN as NULL."""
    c = col(name)
    return F.when(~F.isnan(c), c) if is_float(field(df, name).dataType) else c


def missing(df: DataFrame, name: str) -> Column:
    c = col(name)
    return (c.isNull() | F.isnan(c)) if is_float(field(df, name).dataType) else c.isNull()


def as_double(df: DataFrame, name: str) -> Column:
    """Numbers and booleans as doubles, times as epoch seconds and dates as epoch days."""
    kind = field(df, name).dataType
    if is_number(kind):
        return present(df, name).cast("double")
    if isinstance(kind, T.BooleanType):
        return col(name).cast("int").cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(col(name)).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return epoch_seconds(col(name))
    raise FrameError(f"column {name!r} is not numeric")


def epoch_seconds(c: Column) -> Column:
    return (F.unix_micros(c.cast("timestamp")) / F.lit(1_000_000)).cast("double")


def numeric_columns(df: DataFrame, booleans: bool = False) -> list[str]:
    kinds = (*NUMBERS, T.BooleanType) if booleans else NUMBERS
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def divided(a: Column, b: Column) -> Column:
    """Of doubles, with the signed infinities and NaN of IEEE arithmetic where ANSI mode raises."""
    inf = F.lit(float("inf"))
    by_zero = F.when(a > 0, inf).when(a < 0, -inf).when(a.isNotNull(), F.lit(float("nan")))
    return F.when(b != 0, F.try_divide(a, b)).when(b.isNotNull(), by_zero)


def fresh(names, stem: str) -> str:
    taken = {n.lower() for n in names}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name
