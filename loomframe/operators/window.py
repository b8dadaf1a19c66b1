"""Running, rolling and shifting functions over the frame's order."""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomframe.functions import values as V
from loomframe.functions.scratch import staged
from loomframe.operators import ordered


class Rolling:
    """The last size rows up to each row; a value from min_periods present ones on."""

    def __init__(self, frame, name: str, size: int, min_periods: int | None, partition_by: list[str]):
        if size < 1:
            raise V.FrameError("a window has one row at least")
        self.frame, self.name, self.size = frame, name, size
        self.least = size if min_periods is None else min_periods
        self.partition = partition_by

    def _made(self, fn: str, new: str | None):
        new = new or f"{self.name}_rolling_{fn}"
        x = V.as_double(self.frame.df, self.name)
        calc = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_samp, "count": F.count, "var": F.var_samp}[fn]

        def make(w) -> dict[str, Column]:
            span = w.rowsBetween(-(self.size - 1), 0)
            value = calc(x).over(span)
            return {new: F.when(F.count(x).over(span) >= self.least, value.cast("double") if fn == "count" else value)}

        out = ordered.windowed(self.frame.df, self.frame.order(), self.partition, self.size - 1, 0, make)
        return self.frame._with(out)

    def mean(self, new=None):
        return self._made("mean", new)

    def sum(self, new=None):
        return self._made("sum", new)

    def min(self, new=None):
        return self._made("min", new)

    def max(self, new=None):
        return self._made("max", new)

    def std(self, new=None):
        return self._made("std", new)

    def var(self, new=None):
        return self._made("var", new)

    def count(self, new=None):
        return self._made("count", new)


class Expanding:
    """All rows up to each row; a missing row repeats the running value."""

    def __init__(self, frame, name: str, min_periods: int, partition_by: list[str]):
        self.frame, self.name, self.least, self.partition = frame, name, min_periods, partition_by

    def _made(self, fn: str, new: str | None):
        new = new or f"{self.name}_expanding_{fn}"
        names = [V.fresh(self.frame.df.columns, n) for n in ("upto_n_", "upto_")]
        x = V.as_double(self.frame.df, self.name)
        wanted = {names[0]: ("count", x), names[1]: ({"mean": "sum"}.get(fn, fn), x)}
        out = ordered.running(self.frame.df, self.frame.order(), self.partition, wanted)
        n, value = map(V.col, names)
        value = F.try_divide(value, n) if fn == "mean" else value
        return self.frame._with(out.withColumn(new, F.when(n >= self.least, value)).drop(*names))

    def mean(self, new=None):
        return self._made("mean", new)

    def sum(self, new=None):
        return self._made("sum", new)

    def min(self, new=None):
        return self._made("min", new)

    def max(self, new=None):
        return self._made("max", new)


@dataclass
class Recursion:
    """m = a x + (1 - a) m over present values, and the spread about it."""

    alpha: float
    mean: float | None = None
    var: float = 0.0
    seen: int = 0

    def over(self, values: list, fn: str) -> list:
        alpha, mean, var, seen = self.alpha, self.mean, self.var, self.seen
        out = []
        for v in values:
            if v is None or math.isnan(v):
                out.append(mean if fn == "mean" else None)
                continue
            mean = v if mean is None else alpha * v + (1 - alpha) * mean
            seen += 1
            var = (1 - alpha) * var + alpha * (v - mean) ** 2
            spread = var / (1 - (1 - alpha) ** seen) if seen > 1 else None
            out.append({"mean": mean, "var": spread, "std": None if spread is None else math.sqrt(spread)}[fn])
        self.mean, self.var, self.seen = mean, var, seen
        return out


class EWM:
    """Exponentially weighted: m = a x + (1 - a) m. Each step is linear in what it starts from, so a
    run's steps together are too: runs of a large table are summed up side by side, what each starts
    from follows from the sums of those before, and a second pass (a third for spreads, which need the
    means) gives the rows. With partition_by, each partition is one task's."""

    def __init__(self, frame, name: str, alpha: float, partition_by: list[str]):
        if not 0 < alpha <= 1:
            raise V.FrameError("alpha is above 0 and at most 1")
        self.frame, self.name, self.alpha, self.partition = frame, name, alpha, partition_by

    def _made(self, fn: str, new: str | None):
        new = new or f"{self.name}_ewm_{fn}"
        x = V.fresh(self.frame.df.columns, "x_")
        df = self.frame.df.withColumn(x, V.as_double(self.frame.df, self.name))
        schema = T.StructType([*self.frame.df.schema.fields, T.StructField(new, T.DoubleType())])
        if not self.partition and df.count() > ordered.SINGLE:
            return self.frame._with(self._by_runs(df, x, fn, schema))
        keys, alpha = self.partition, self.alpha
        order = ordered.order_columns([*keys, *self.frame.order()])
        parted = df.repartition(*map(V.col, keys)) if keys else df.coalesce(1)
        rows = parted.sortWithinPartitions(*order)

        def run(batches):
            group, state = None, Recursion(alpha)
            for batch in batches:
                key = list(zip(*[batch.column(k).to_pylist() for k in keys], strict=True)) if keys else [()] * batch.num_rows
                values, out, start = batch.column(x).to_pylist(), [], 0
                for end in range(1, len(key) + 1):
                    if end < len(key) and key[end] == key[start]:
                        continue
                    if key[start] != group:
                        group, state = key[start], Recursion(alpha)
                    out += state.over(values[start:end], fn)
                    start = end
                columns = [batch.column(n) for n in batch.schema.names if n != x] + [pa.array(out, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[n for n in batch.schema.names if n != x] + [new])

        return self.frame._with(rows.mapInArrow(run, schema))

    def _by_runs(self, df, x: str, fn: str, schema):
        alpha, new = self.alpha, schema.fields[-1].name
        row, run = (V.fresh(df.columns, n) for n in ("row_", "run_"))
        rows = ordered.numbered(df, self.frame.order(), row).withColumn(run, F.floor(V.col(row) / ordered.BLOCK))
        rows = staged(rows, "runs")  # read in each pass

        def in_order(table: pa.Table) -> pa.Table:
            return table.sort_by(row)

        def sums(table: pa.Table) -> pa.Table:
            """Present values; the mean at the end from 0, and from none."""
            values = [v for v in in_order(table).column(x).to_pylist() if v is not None and not math.isnan(v)]
            from_zero, from_none = Recursion(alpha, 0.0), Recursion(alpha)
            from_zero.over(values, "mean")
            from_none.over(values, "mean")
            return pa.table({"run": [table.column(run)[0].as_py()], "n": [len(values)], "b": [from_zero.mean], "own": pa.array([from_none.mean], pa.float64())})

        def means(batches):
            """What each run starts from; runs come one after another."""
            mean, seen = None, 0
            for batch in batches:
                out = []
                for r, n, b, own in zip(*(batch.column(c).to_pylist() for c in ("run", "n", "b", "own")), strict=True):
                    out.append((r, mean, seen))
                    mean = own if mean is None else (1 - alpha) ** n * mean + b
                    seen += n
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate((pa.int64(), pa.float64(), pa.int64()))], names=["run", "mean", "seen"])

        def folded(summary, fold, kind):
            return summary.coalesce(1).sortWithinPartitions("run").mapInArrow(fold, kind)

        start = folded(staged(rows.groupBy(run).applyInArrow(sums, "run long, n long, b double, own double"), "sums"), means, "run long, mean double, seen long")
        start = start.withColumn("var", F.lit(0.0))
        key, *named = (V.fresh(rows.columns, n) for n in ("key_", "mean_", "var_", "seen_"))
        marks = dict(zip(("mean", "var", "seen"), named, strict=True))
        joined = lambda start: rows.join(start.withColumnsRenamed(marks | {"run": key}), V.col(run) == V.col(key)).drop(key)
        if fn != "mean":

            def spreads(table: pa.Table) -> pa.Table:
                """The spread at the end from 0."""
                state = Recursion(alpha, table.column(marks["mean"])[0].as_py(), 0.0, table.column(marks["seen"])[0].as_py())
                first = (state.mean, state.seen)
                state.over(in_order(table).column(x).to_pylist(), "mean")
                return pa.table({"run": [table.column(run)[0].as_py()], "mean": pa.array([first[0]], pa.float64()), "seen": [first[1]], "n": [state.seen - first[1]], "b": [state.var]})

            def carried(batches):
                var = 0.0
                for batch in batches:
                    out = []
                    for n, b in zip(*(batch.column(c).to_pylist() for c in ("n", "b")), strict=True):
                        out.append(var)
                        var = (1 - alpha) ** n * var + b
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("run", "mean", "seen")), pa.array(out, pa.float64())], names=["run", "mean", "seen", "var"])

            spread = joined(start.drop("var")).groupBy(run).applyInArrow(spreads, "run long, mean double, seen long, n long, b double")
            start = folded(staged(spread, "sums"), carried, "run long, mean double, seen long, var double")

        names = [f.name for f in schema.fields[:-1]]

        def finish(table: pa.Table) -> pa.Table:
            table = in_order(table)
            first = {m: table.column(c)[0].as_py() for m, c in marks.items()}
            out = Recursion(alpha, first["mean"], first["var"], first["seen"]).over(table.column(x).to_pylist(), fn)
            return pa.table([*(table.column(n) for n in names), pa.array(out, pa.float64())], names=[*names, new])

        return joined(start).groupBy(run).applyInArrow(finish, schema)

    def mean(self, new=None):
        return self._made("mean", new)

    def var(self, new=None):
        return self._made("var", new)

    def std(self, new=None):
        return self._made("std", new)


def _list(names) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


class WindowOps:
    df: DataFrame

    def rolling(self, name: str, size: int, min_periods: int | None = None, partition_by=()) -> Rolling:
        return Rolling(self, name, size, min_periods, _list(partition_by))

    def expanding(self, name: str, min_periods: int = 1, partition_by=()) -> Expanding:
        return Expanding(self, name, min_periods, _list(partition_by))

    def ewm(self, name: str, alpha: float, partition_by=()) -> EWM:
        return EWM(self, name, alpha, _list(partition_by))

    def _running(self, fn: str, name: str, new: str | None, partition_by, stem: str):
        """A missing value stays missing, and what came before counts on after it."""
        new = new or f"{name}_{stem}"
        x, made = V.as_double(self.df, name), V.fresh(self.df.columns, "upto_")
        out = ordered.running(self.df, self.order(), _list(partition_by), {made: (fn, x)})
        return self._with(out.withColumn(new, F.when(x.isNotNull(), V.col(made))).drop(made))

    def col_cumsum(self, name, new=None, partition_by=()):
        return self._running("sum", name, new, partition_by, "cumsum")

    def col_cumprod(self, name, new=None, partition_by=()):
        return self._running("product", name, new, partition_by, "cumprod")

    def col_cummax(self, name, new=None, partition_by=()):
        return self._running("max", name, new, partition_by, "cummax")

    def col_cummin(self, name, new=None, partition_by=()):
        return self._running("min", name, new, partition_by, "cummin")

    def _shifted(self, name: str, periods: int, new: str, partition_by, combine):
        if periods == 0:
            raise V.FrameError("periods is not 0")
        x = V.as_double(self.df, name)

        def make(w) -> dict[str, Column]:
            other = F.lag(x, periods).over(w) if periods > 0 else F.lead(x, -periods).over(w)
            return {new: combine(x, other)}

        out = ordered.windowed(self.df, self.order(), _list(partition_by), max(periods, 0), max(-periods, 0), make)
        return self._with(out)

    def shift(self, name, periods: int = 1, new=None, partition_by=()):
        return self._shifted(name, periods, new or f"{name}_shift", partition_by, lambda x, o: o)

    def col_diff(self, name, periods: int = 1, new=None, partition_by=()):
        return self._shifted(name, periods, new or f"{name}_diff", partition_by, lambda x, o: x - o)

    def col_pct_change(self, name, periods: int = 1, new=None, partition_by=()):
        """From a base of 0 the change is missing."""
        return self._shifted(name, periods, new or f"{name}_pct_change", partition_by, lambda x, o: F.try_divide(x - o, o))

    def _filled(self, fn: str, names, partition_by):
        names = _list(names) or [n for n in self.df.columns if n not in self.order_by]
        held = {n: V.fresh(self.df.columns, f"{n}_held_") for n in names}
        out = ordered.running(self.df, self.order(), _list(partition_by), {held[n]: (fn, V.present(self.df, n)) for n in names})
        return self._with(out.withColumns({n: V.col(h) for n, h in held.items()}).drop(*held.values()))

    def ffill(self, *names, partition_by=()):
        return self._filled("last", names, partition_by)

    def bfill(self, *names, partition_by=()):
        return self._filled("next", names, partition_by)

    pad, backfill = ffill, bfill

    def interpolate(self, *names, partition_by=()):
        """Linear by row position between present values; ends stay missing. Columns of numbers."""
        names = list(names) or [n for n in V.numeric_columns(self.df) if n not in self.order_by]
        keys = _list(partition_by)
        row = V.fresh(self.df.columns, "row_")
        if keys:
            from pyspark.sql.window import Window

            spec = Window.partitionBy(*map(V.col, keys)).orderBy(*ordered.order_columns(self.order()))
            rows = self.df.withColumn(row, F.row_number().over(spec).cast("long"))
        else:
            rows = ordered.numbered(self.df, self.order(), row)
        wanted, new = {}, {}
        for i, n in enumerate(names):
            x = V.as_double(self.df, n)
            point = F.when(x.isNotNull(), F.struct(V.col(row).alias("at"), x.alias("x")))
            wanted |= {f"__p{i}": ("last", point), f"__n{i}": ("next", point)}
            p, q = F.col(f"__p{i}"), F.col(f"__n{i}")
            line = p["x"] + (q["x"] - p["x"]) * F.try_divide((V.col(row) - p["at"]).cast("double"), (q["at"] - p["at"]).cast("double"))
            new[n] = F.coalesce(x, F.when(p.isNotNull() & q.isNotNull(), line))
        out = ordered.running(rows, [row], keys, wanted)
        return self._with(out.withColumns(new).drop(row, *wanted))

    def duplicated(self, subset=None, keep: str | bool = "first", new: str = "duplicated"):
        """Flags rows that repeat an earlier (keep first) or a later (last) one, or any (none). What is
        known of each group is joined back, so that a frequent value is not one task's."""
        names = _list(subset) if subset else list(self.df.columns)
        group = self.group_by(*names)
        mark = V.fresh([*self.df.columns, new], "known_")
        if keep in ("none", "false", False):
            counted = group._joined(self.df.groupBy(*group._keys()).agg(F.count("*").alias(mark)), semi=False)
            return self._with(counted.withColumn(new, V.col(mark) > 1).drop(mark))
        # The first row is that of the least order key; of rows that tie in it, any one.
        order = F.struct(*map(V.col, self.order()))
        pick = F.max if keep == "last" else F.min
        known = group._joined(self.df.groupBy(*group._keys()).agg(pick(order).alias(mark)), semi=False)
        keys = [V.present(self.df, n) + F.lit(0.0) if V.is_float(V.field(self.df, n).dataType) else V.col(n) for n in names]
        tied = Window.partitionBy(*keys, *[V.col(c) for c in self.order() if c not in names]).orderBy(F.lit(0))
        flag = ~V.col(mark).eqNullSafe(order) | (F.row_number().over(tied) > 1)
        return self._with(known.withColumn(new, flag).drop(mark))

    def drop_duplicates(self, subset=None, keep: str | bool = "first"):
        """One row of each, or none of those that repeat (keep none)."""
        names = _list(subset) if subset else list(self.df.columns)
        if not self.order_by and set(names) == set(self.df.columns):
            if keep not in ("none", "false", False):
                return self._with(self.df.dropDuplicates())  # rows alike in all: any of them, by partial aggregates
        if keep in ("none", "false", False):
            mark = V.fresh(self.df.columns, "n_")
            alone = self.duplicated(names, "none", mark)
            return self._with(alone.df.where(~V.col(mark)).drop(mark))
        # The row of the least (greatest) order key, by a partial aggregate: no window, so no hot key.
        keys = [(V.present(self.df, n) + F.lit(0.0) if V.is_float(V.field(self.df, n).dataType) else V.col(n)).alias(f"__k{i}") for i, n in enumerate(names)]
        row = F.struct(*[V.col(n).alias(f"__c{i}") for i, n in enumerate(self.df.columns)])
        order = F.struct(*map(V.col, self.order()))
        pick = F.max_by if keep == "last" else F.min_by
        got = self.df.groupBy(*keys).agg(pick(row, order).alias("__row"))
        return self._with(got.select(*[F.col("__row")[f"__c{i}"].alias(n) for i, n in enumerate(self.df.columns)]))
