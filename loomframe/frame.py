"""Frame: an immutable wrapper of a DataFrame and the columns that give its row order.

Spark rows have no order. Operators that depend on one take it from order_by, and raise without it
rather than guess. All others ignore it.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.functions.values import FrameError, field, is_float, present
from loomframe.operators.columns import ColumnOps
from loomframe.operators.filter import FilterOps
from loomframe.operators.group import GroupOps
from loomframe.operators.join import JoinOps
from loomframe.operators.missing import MissingOps
from loomframe.operators.plotdata import PlotData
from loomframe.operators.resample import TimeSeriesOps
from loomframe.operators.reshape import ReshapeOps
from loomframe.operators.select import SelectOps
from loomframe.operators.setops import SetOps
from loomframe.operators.sort import SortOps
from loomframe.operators.stats import StatOps
from loomframe.operators.window import WindowOps


class OrderError(FrameError):
    """An order-dependent operator on a frame without an order."""


class Frame(
    SelectOps, FilterOps, JoinOps, GroupOps, StatOps, WindowOps, SortOps, SetOps, MissingOps, ReshapeOps, ColumnOps, TimeSeriesOps
):
    """Methods have snake_case names; the same names in camelCase work too."""

    def __init__(self, df: DataFrame, order_by: str | Sequence[str] = ()):
        self.df = df
        self.order_by = [order_by] if isinstance(order_by, str) else list(order_by)
        for c in self.order_by:
            field(df, c)

    def _with(self, df: DataFrame, order_by: Sequence[str] | None = None) -> Frame:
        order = self.order_by if order_by is None else list(order_by)
        return Frame(df, [c for c in order if c in df.columns])

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def plot(self) -> PlotData:
        return PlotData(self)

    def order(self) -> list[str]:
        if not self.order_by:
            raise OrderError("this operator depends on row order; give the frame order_by")
        return self.order_by

    def ordered_by(self, *names: str) -> Frame:
        return Frame(self.df, names)

    def without_nan(self) -> Frame:
        """NaN as NULL in every float column, for plans that go on in plain Spark."""
        new = {f.name: present(self.df, f.name) for f in self.df.schema.fields if is_float(f.dataType)}
        return self._with(self.df.withColumns(new) if new else self.df)

    def sql(self, text: str, *others: Frame, **named: Frame):
        """The frame is this; ${name} are the other frames, by name or in order of appearance."""
        from loomframe.plans.sql import sql

        return sql(text, *others, this=self, **named)

    def update(self, text: str, **params) -> tuple[Frame, int]:
        from loomframe.plans.dml import execute

        return execute(self, text, params)

    def render(self, most_rows: int = 20, most_width: int = 40, na: str = "<NA>") -> str:
        from loomframe.sources.render import console

        return console(self, most_rows, most_width, na)

    def write(self, path: str, **options) -> None:
        from loomframe.sources.dispatch import write

        write(self, path, **options)

    def __getattr__(self, name: str):
        if name.startswith("_") or not re.search("[a-z][A-Z]", name):
            raise AttributeError(name)
        snake = re.sub("([a-z0-9])([A-Z])", r"\1_\2", name).lower()
        return object.__getattribute__(self, snake)

    def __repr__(self) -> str:
        return f"Frame({', '.join(f'{k}: {v}' for k, v in self.dtypes().items())})"


def frame(data, order_by: str | Sequence[str] = (), schema=None, spark: SparkSession | None = None) -> Frame:
    """From a DataFrame, pandas frame, rows, records (dataclasses, dicts) or a dict of columns. Rows
    from Python get the order in which they come, as the column __pos__, unless order_by is given."""
    if isinstance(data, Frame):
        return data
    if isinstance(data, DataFrame):
        return Frame(data, order_by)
    spark = spark or SparkSession.getActiveSession()
    if isinstance(data, dict):
        sizes = {len(v) for v in data.values()}
        if len(sizes) > 1:
            raise FrameError("columns differ in length")
        names, rows = list(data), list(zip(*data.values(), strict=True))
    elif hasattr(data, "to_dict") and hasattr(data, "columns"):
        import numpy as np

        names = [str(c) for c in data.columns]
        rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in data.astype(object).itertuples(index=False, name=None)]
    else:
        rows = list(data)
        names = schema.names if hasattr(schema, "names") else None
        if rows and hasattr(rows[0], "__dataclass_fields__"):
            names = list(rows[0].__dataclass_fields__)
            rows = [tuple(getattr(r, n) for n in names) for r in rows]
        elif rows and isinstance(rows[0], dict):
            names = list(dict.fromkeys(k for r in rows for k in r))
            rows = [tuple(r.get(n) for n in names) for r in rows]
    if names is None and schema is None:
        raise FrameError("rows need a schema or names")
    df = spark.createDataFrame(rows, schema if schema is not None else names)
    if order_by:
        return Frame(df, order_by)
    numbered = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], df.schema.add("__pos__", "long"))
    return Frame(numbered, "__pos__")


def concat(*frames: Frame, axis: int = 0) -> Frame:
    first, *rest = frames
    return first.concat_columns(*rest) if axis == 1 else first.concat(*rest)


def date_range(spark: SparkSession, start, periods: int, rule: str, name: str = "ts") -> Frame:
    """A frame of periods times from start, a step apart."""
    from loomframe.functions.frequency import Frequency

    times = Frequency.parse(rule).range(start, periods)
    return Frame(spark.createDataFrame([(t,) for t in times], f"`{name}` timestamp_ntz"), name)


__all__ = ["F", "Frame", "FrameError", "OrderError", "concat", "date_range", "frame"]
