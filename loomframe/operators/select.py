"""Projection, renaming, kinds, cells and metadata."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.functions import values as V
from loomframe.operators import ordered

#: Names of the kinds, and their Spark types.
KINDS: dict[str, T.DataType] = {
    "int": T.IntegerType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "bool": T.BooleanType(),
    "string": T.StringType(),
    "datetime": T.TimestampNTZType(),
    "date": T.DateType(),
}


def cast_to(df: DataFrame, name: str, kind: str) -> Column:
    """Bad text raises; doubles lose their fraction; numbers are true unless 0, text if it is true or 1."""
    kind = kind.lower()
    if kind == "category":
        raise V.FrameError("a category cannot be the target of astype")
    if kind == "object":
        return V.present(df, name)
    if kind not in KINDS:
        raise V.FrameError(f"unknown kind {kind!r}; there are {sorted(KINDS)}")
    have, c = V.field(df, name).dataType, V.present(df, name)
    if kind == "bool":
        if V.is_number(have):
            return c != 0
        if V.kind_of(have) == "string":
            return F.lower(F.trim(c)).isin("true", "1")
    if kind in ("int", "long", "double") and V.kind_of(have) == "time":
        return V.as_double(df, name).cast(KINDS[kind])
    return c.cast(KINDS[kind])


class SelectOps:
    df: DataFrame

    # ---- columns
    def select(self, *names: str):
        for n in names:
            V.field(self.df, n)
        return self._with(self.df.select(*map(V.col, names)))

    def select_by(self, wanted: Callable[[str], bool]):
        return self.select(*[n for n in self.df.columns if wanted(n)])

    def select_dtypes(self, include: Sequence[str] = (), exclude: Sequence[str] = ()):
        kinds = self.dtypes()
        return self.select(*[n for n, k in kinds.items() if (not include or k in include) and k not in exclude])

    def drop(self, *names: str):
        return self._with(self.df.drop(*[n for n in names if n in self.df.columns]))

    def insert(self, at: int, name: str, value: Column | object):
        if name in self.df.columns:
            raise V.FrameError(f"column {name!r} is there already")
        names = self.df.columns
        value = value if isinstance(value, Column) else F.lit(value)
        return self._with(self.df.select(*map(V.col, names[:at]), value.alias(name), *map(V.col, names[at:])))

    def pop(self, name: str):
        return self.select(name)

    def assign(self, **columns: Column | str | object):
        """Columns, constants, or text of the expression language."""
        out = self
        for name, value in columns.items():
            if isinstance(value, str):
                out = out.eval(f"`{name}` = {value}")
            else:
                out = out._with(out.df.withColumn(name, value if isinstance(value, Column) else F.lit(value)))
        return out

    def rename_columns(self, names: dict[str, str]):
        for n in names:
            V.field(self.df, n)
        order = [names.get(c, c) for c in self.order_by]
        return self._with(self.df.withColumnsRenamed(names), order)

    def add_prefix(self, prefix: str):
        return self.rename_columns({n: prefix + n for n in self.df.columns})

    def add_suffix(self, suffix: str):
        return self.rename_columns({n: n + suffix for n in self.df.columns})

    def set_axis(self, labels: Sequence[str]):
        if len(labels) != len(self.df.columns):
            raise V.FrameError(f"{len(labels)} labels for {len(self.df.columns)} columns")
        return self.rename_columns(dict(zip(self.df.columns, labels, strict=True)))

    def rename_axis(self, name: str):
        """Rows have no axis name here: the frame as it is."""
        return self

    def with_column_clone(self, name: str, new: str):
        V.field(self.df, name)
        return self._with(self.df.withColumn(new, V.col(name)))

    def astype(self, name: str, kind: str):
        return self._with(self.df.withColumn(name, cast_to(self.df, name, kind)))

    def infer_objects(self, *names: str):
        """Text columns (all, or those named) whose every value reads as one narrower kind become it.
        One pass over the data decides."""
        texts = [f.name for f in self.df.schema.fields if V.kind_of(f.dataType) == "string" and (not names or f.name in names)]
        tests = {"int": "int", "long": "bigint", "double": "double", "bool": "boolean", "date": "date", "datetime": "timestamp_ntz"}
        if not texts:
            return self
        asked = [
            F.bool_and(V.col(n).isNull() | V.col(n).try_cast(t).isNotNull()).alias(f"{i}_{k}")
            for i, n in enumerate(texts)
            for k, t in tests.items()
        ] + [F.count(V.col(n)).alias(f"{i}_n") for i, n in enumerate(texts)]
        told = self.df.agg(*asked).first()
        out = self.df
        for i, n in enumerate(texts):
            kind = next((k for k in tests if told[f"{i}_{k}"]), None) if told[f"{i}_n"] else None
            if kind:
                out = out.withColumn(n, V.col(n).cast(tests[kind]))
        return self._with(out)

    convert_dtypes = infer_objects

    # ---- metadata
    def row_count(self) -> int:
        return self.df.count()

    def column_count(self) -> int:
        return len(self.df.columns)

    def shape(self) -> tuple[int, int]:
        return self.row_count(), self.column_count()

    def size(self) -> int:
        return self.row_count() * self.column_count()

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def column_names(self) -> list[str]:
        return list(self.df.columns)

    keys = column_names

    def ndim(self) -> int:
        return 2

    def axes(self) -> list:
        return [range(self.row_count()), self.column_names()]

    def dtypes(self) -> dict[str, str]:
        back = {type(t): k for k, t in KINDS.items()}
        return {f.name: back.get(type(f.dataType), f.dataType.simpleString()) for f in self.df.schema.fields}

    def info(self) -> list[dict]:
        """Name, kind and number of present values of each column, in one pass."""
        counts = self.df.agg(*[F.count(V.present(self.df, n)).alias(str(i)) for i, n in enumerate(self.df.columns)]).first()
        return [{"name": n, "dtype": k, "non_null": counts[i]} for i, (n, k) in enumerate(self.dtypes().items())]

    def memory_usage(self) -> int:
        """Bytes that the optimizer estimates for the plan."""
        return int(str(self.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))

    def attrs(self) -> dict:
        return {f.name: f.metadata for f in self.df.schema.fields if f.metadata}

    def column_index(self, name: str) -> int:
        return self.df.columns.index(name) if name in self.df.columns else -1

    # ---- cells and rows
    def get(self, row: int, name: str):
        """The cell at a row number, by the frame's order."""
        V.field(self.df, name)
        got = self.slice(row, row + 1).df.select(V.col(name)).first()
        if got is None:
            raise V.FrameError(f"no row {row}")
        return got[0]

    iat = get

    def at(self, label, name: str, index: str):
        """The first cell whose index column holds label."""
        got = self.df.where(V.col(index) == F.lit(label)).select(V.col(name)).first()
        return None if got is None else got[0]

    def get_row(self, row: int) -> tuple:
        got = self.slice(row, row + 1).df.first()
        if got is None:
            raise V.FrameError(f"no row {row}")
        return tuple(got)

    def isetitem(self, row: int, name: str, value):
        at = V.fresh(self.df.columns, "at_")
        numbered = ordered.numbered(self.df, self.order(), at)
        kind = V.field(self.df, name).dataType
        new = F.when(V.col(at) == row, F.lit(value).cast(kind)).otherwise(V.col(name))
        return self._with(numbered.withColumn(name, new).drop(at))

    def iter_rows(self) -> Iterator[tuple]:
        rows = self.df.orderBy(*ordered.order_columns(self.order_by)) if self.order_by else self.df
        return (tuple(r) for r in rows.toLocalIterator(prefetchPartitions=True))

    iterrows = itertuples = iter_rows

    def items(self) -> Iterator[tuple[str, object]]:
        return ((n, self.select(n)) for n in self.df.columns)

    def to_pandas(self):
        return (self.df.orderBy(*ordered.order_columns(self.order_by)) if self.order_by else self.df).toPandas()

    def to_numpy(self):
        return self.to_pandas().to_numpy()

    def to_list(self, name: str) -> list:
        i = self.column_index(name)
        return [r[i] for r in self.iter_rows()]

    def to_dict(self) -> dict[str, list]:
        rows = list(self.iter_rows())
        return {n: [r[i] for r in rows] for i, n in enumerate(self.df.columns)}

    def to_records(self, cls: type) -> list:
        return [cls(**dict(zip(self.df.columns, r, strict=True))) for r in self.iter_rows()]

    def squeeze(self):
        """1 x 1: the cell; one column: its values; one row: its cells; else the frame."""
        rows = self.df.limit(2).count()
        if len(self.df.columns) == 1:
            return self.get(0, self.df.columns[0]) if rows == 1 else self.to_list(self.df.columns[0])
        return self.get_row(0) if rows == 1 else self

    def pipe(self, fn: Callable, *args, **kwargs):
        return fn(self, *args, **kwargs)

    # ---- labels
    def set_index(self, *names: str, drop: bool = True):
        """Labels live in ordinary columns: the named ones, joined to text if several."""
        if len(names) == 1:
            label = V.col(names[0])
        else:
            label = F.concat_ws(",", *[V.col(n).cast("string") for n in names])
        out = self.df.withColumn("__idx__", label)
        return self._with(out.drop(*[n for n in names if n not in self.order_by]) if drop else out)

    def reset_index(self, name: str = "index"):
        """The label column, or row numbers, as the last column."""
        if "__idx__" in self.df.columns:
            rest = [n for n in self.df.columns if n != "__idx__"]
            return self._with(self.df.select(*map(V.col, rest), V.col("__idx__").alias(name)))
        return self._with(ordered.numbered(self.df, self.order(), name))

    def loc(self, labels: Sequence, index: str = "__idx__"):
        """Rows by label, in the order asked for; every row of a repeated label."""
        kind = V.field(self.df, index).dataType
        at, label = (V.fresh(self.df.columns, n) for n in ("at_", "label_"))
        asked = T.StructType([T.StructField(label, kind), T.StructField(at, T.LongType())])
        wanted = self.spark.createDataFrame([(x, i) for i, x in enumerate(labels)], asked)
        found = self.df.join(F.broadcast(wanted), V.col(index).eqNullSafe(V.col(label))).drop(label)
        return self._positioned(found, at)

    def _positioned(self, found: DataFrame, at: str):
        """found sorted by at and the frame's order; at stays as the order key."""
        return self._with(found, [at, *self.order_by])

    def iloc(self, *rows: int):
        at, want = (V.fresh(self.df.columns, n) for n in ("at_", "want_"))
        wanted = self.spark.createDataFrame([(r, i) for i, r in enumerate(rows)], f"`{want}` long, `{at}` long")
        row = V.fresh([*self.df.columns, at, want], "row_")
        found = ordered.numbered(self.df, self.order(), row).join(F.broadcast(wanted), V.col(row) == V.col(want))
        return self._positioned(found.drop(row, want), at)

    take_rows = iloc

    def reindex(self, labels: Sequence, index: str = "__idx__"):
        """A row for each label, in their order, all missing where the label is not there."""
        kind = V.field(self.df, index).dataType
        at, label = (V.fresh(self.df.columns, n) for n in ("at_", "label_"))
        asked = T.StructType([T.StructField(label, kind), T.StructField(at, T.LongType())])
        wanted = self.spark.createDataFrame([(x, i) for i, x in enumerate(labels)], asked)
        names = [n for n in self.df.columns if n != index]
        joined = wanted.join(self.df, V.col(label).eqNullSafe(V.col(index)), "left")
        return self._positioned(joined.select(V.col(label).alias(index), *map(V.col, names), V.col(at)), at)

    def reindex_like(self, other, index: str = "__idx__"):
        return self.reindex(other.to_list(index), index)

    def _valid_index(self, pick: Callable[[Column], Column]):
        row = V.fresh(self.df.columns, "row_")
        some = None
        for n in self.df.columns:
            there = ~V.missing(self.df, n)
            some = there if some is None else some | there
        got = ordered.numbered(self.df, self.order(), row).where(some).agg(pick(V.col(row))).first()[0]
        return -1 if got is None else got

    def first_valid_index(self) -> int:
        return self._valid_index(F.min)

    def last_valid_index(self) -> int:
        return self._valid_index(F.max)
