"""Time-series resampling on a grid that starts at the first time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.functions import values as V
from loomframe.functions.frequency import MOST_POINTS, Frequency, infer
from loomframe.operators.group import aggregate

FUNCTIONS = ("sum", "mean", "median", "min", "max", "count", "std", "var", "first", "last")


class Resampler:
    """Half-open bins [g, next g). The bounds come from one min/max pass; bins of fixed length are
    arithmetic on the time, month bins a look-up of the grid (at most 100,000 points) by month.
    Empty bins are rows with missing values."""

    def __init__(self, frame, name: str, rule: str):
        self.frame, self.freq, self.name = frame, Frequency.parse(rule), name
        kind = V.field(frame.df, name).dataType
        if V.kind_of(kind) == "string":
            time = F.try_to_timestamp(F.replace(V.col(name), F.lit("T"), F.lit(" "))).cast("timestamp_ntz")
        elif V.kind_of(kind) == "time":
            time = V.col(name).cast("timestamp_ntz")
        else:
            raise V.FrameError(f"column {name!r} is not a time")
        rows = frame.df.withColumn("__t", time).where("__t is not null")
        self.low, self.high = rows.agg(F.min("__t"), F.max("__t")).first()
        self.rows, self.grid = self._binned(rows)

    def _binned(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        spark = rows.sparkSession
        if self.low is None:
            return rows.withColumn("__bin", F.lit(0).cast("long")), spark.createDataFrame([], "__bin long, _bucket_ timestamp_ntz")
        start = self.freq.align_start(self.low)
        if self.freq.seconds is not None:
            step = self.freq.seconds * 1_000_000
            micros = lambda c: F.unix_micros(c.cast("timestamp"))  # noqa: E731  NTZ as UTC in a UTC session
            origin = micros(F.lit(start).cast("timestamp_ntz"))
            span = int((self.high - start).total_seconds() * 1_000_000)
            if span // step + 1 > MOST_POINTS:
                raise V.FrameError(f"more than {MOST_POINTS} steps; take a longer one")
            at = F.floor((micros(F.col("__t")) - origin) / F.lit(step)).cast("long")
            bucket = F.timestamp_micros(F.col("id") * F.lit(step) + origin).cast("timestamp_ntz")
            return rows.withColumn("__bin", at), spark.range(span // step + 1).select(F.col("id").alias("__bin"), bucket.alias("_bucket_"))
        edges = self.freq.grid(self.low, self.high)
        months = lambda t: t.year * 12 + t.month
        points = [(i, t, (months(t) - months(edges[0])) // self.freq.months) for i, t in enumerate(edges)]
        grid = spark.createDataFrame([p[:2] for p in points[:-1]], "__bin long, _bucket_ timestamp_ntz")
        look = spark.createDataFrame([(k, i, t) for i, t, k in points], "__k long, __i long, __g timestamp_ntz")
        own = F.year("__t") * 12 + F.month("__t") - F.lit(months(edges[0]))
        keyed = rows.withColumn("__k", F.floor(own / self.freq.months).cast("long"))
        joined = keyed.join(F.broadcast(look), "__k", "left")
        at = F.when(F.col("__t") >= F.col("__g"), F.col("__i")).otherwise(F.col("__i") - 1)
        return joined.withColumn("__bin", at).drop("__k", "__i", "__g"), grid

    def _finished(self, parts: dict[str, Column]):
        sums = self.rows.groupBy("__bin").agg(*[c.alias(n) for n, c in parts.items()])
        out = self.grid.join(sums, "__bin", "left").select("_bucket_", *map(V.col, parts))
        return self.frame._with(out, ["_bucket_"])

    def _value(self, name: str, fn: str) -> Column:
        """Missing for a bin without a present value, counts too; sums of whole numbers are whole."""
        if fn not in FUNCTIONS:
            raise V.FrameError(f"unknown aggregate {fn!r}; there are {list(FUNCTIONS)}")
        order = ["__t", *self.frame.order_by]
        if fn == "count":
            return F.nullif(F.count(V.present(self.rows, name)), F.lit(0))
        value = aggregate(self.rows, name, fn, order, sums="native")
        if fn == "sum":
            return F.when(F.count(V.present(self.rows, name)) > 0, value)
        return value

    def bins(self):
        """Each row with a time, with bin: the number of its bin from 0. What the aggregates group by."""
        return self.frame._with(self.rows.select(*map(V.col, self.frame.df.columns), V.col("__bin").alias("bin")))

    def all(self, fn: str):
        """Every numeric and boolean column: _bucket_ and <column>_<fn>."""
        names = [n for n in V.numeric_columns(self.frame.df, booleans=True) if n != self.name]
        return self._finished({f"{n}_{fn}": self._value(n, fn) for n in names})

    def one(self, name: str, fn: str):
        return self._finished({f"{name}_{fn}": self._value(name, fn)})

    def agg(self, spec: dict[str, str]):
        """Columns are named <fn>_<column> here."""
        return self._finished({f"{fn}_{n}": self._value(n, fn) for n, fn in spec.items()})

    def ohlc(self, name: str):
        order = F.struct("__t", *map(V.col, self.frame.order_by))
        x = V.as_double(self.rows, name)
        key = F.when(x.isNotNull(), order)
        return self._finished(
            {f"{name}_open": F.min_by(x, key), f"{name}_high": F.max(x), f"{name}_low": F.min(x), f"{name}_close": F.max_by(x, key)}
        )

    def _either(self, fn: str, name: str | None):
        return self.all(fn) if name is None else self.one(name, fn)

    def sum(self, name=None):
        return self._either("sum", name)

    def mean(self, name=None):
        return self._either("mean", name)

    def median(self, name=None):
        return self._either("median", name)

    def min(self, name=None):
        return self._either("min", name)

    def max(self, name=None):
        return self._either("max", name)

    def count(self, name=None):
        return self._either("count", name)

    def std(self, name=None):
        return self._either("std", name)

    def var(self, name=None):
        return self._either("var", name)

    def first(self, name=None):
        return self._either("first", name)

    def last(self, name=None):
        return self._either("last", name)


class TimeSeriesOps:
    df: DataFrame

    def resample(self, name: str, rule: str) -> Resampler:
        return Resampler(self, name, rule)

    def infer_freq(self, name: str) -> str:
        """From the first three present times, by the frame's order."""
        kind = V.field(self.df, name).dataType
        if not isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            raise V.FrameError(f"column {name!r} is not a time")
        rows = self.df.where(V.col(name).isNotNull())
        order = [V.col(c).asc_nulls_last() for c in self.order()]
        return infer([r[0] for r in rows.orderBy(*order).select(V.col(name).cast("timestamp_ntz")).limit(3).collect()])
