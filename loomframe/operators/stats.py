"""Column statistics. Each is one aggregate job, or one plan where a frame is the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomframe.functions import values as V
from loomframe.operators import ordered


def skewness(x: Column) -> Column:
    """Sample-adjusted; missing below three values and for a constant."""
    n = F.count(x).cast("double")
    return F.when(n >= 3, F.skewness(x) * F.try_divide(F.sqrt(n * (n - 1)), n - 2))


def kurtosis(x: Column) -> Column:
    """Sample excess; missing below four values and for a constant."""
    n = F.count(x).cast("double")
    return F.when(n >= 4, F.try_divide(((n + 1) * F.kurtosis(x) + 6) * (n - 1), (n - 2) * (n - 3)))


def sem(x: Column) -> Column:
    return F.try_divide(F.stddev_samp(x), F.sqrt(F.count(x).cast("double")))


def pearson(x: Column, y: Column) -> Column:
    """Over pairs with both present; missing for a constant, where corr itself would raise."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def covariance(x: Column, y: Column) -> Column:
    both = x.isNotNull() & y.isNotNull()
    return F.when(F.count(F.when(both, x)) >= 2, F.covar_samp(F.when(both, x), F.when(both, y)))


#: Statistics that replace the built-in ones, by name: a function from a double column to an aggregate.
_provided: dict[str, Callable[[Column], Column]] = {}


def use_statistics(**given: Callable[[Column], Column]) -> None:
    """Replace sum, mean, std, var, min, max, median or others, until reset_statistics()."""
    _provided.update(given)


def reset_statistics() -> None:
    _provided.clear()


def truthy(df: DataFrame, name: str) -> Column:
    kind = V.kind_of(V.field(df, name).dataType)
    c = V.present(df, name)
    return {"bool": c, "number": c != 0, "string": c != ""}.get(kind, c.isNotNull())


def ranked(df: DataFrame, name: str, method: str, order: list[str]) -> DataFrame:
    """df with rank_: average, min, max, first or dense rank of the present values, ascending.

    Ranks come from the counts of distinct values: a prefix sum over these, joined back by value,
    so no task sorts the rows themselves (but for first, which is a row number)."""
    if method not in ("average", "min", "max", "first", "dense"):
        raise V.FrameError(f"unknown rank method {method!r}")
    value = V.present(df, name)
    if method == "first":
        key, row = V.fresh(df.columns, "key_"), V.fresh(df.columns, "row_")
        rows = df.withColumn(key, value)
        got = ordered.numbered(rows.where(V.col(key).isNotNull()), [key, *order], row)
        some = got.withColumn("rank_", (V.col(row) + 1).cast("double")).drop(row, key)
        none = rows.where(V.col(key).isNull()).drop(key).withColumn("rank_", F.lit(None).cast("double"))
        return some.unionByName(none)
    counts = df.where(value.isNotNull()).groupBy(value.alias("v_")).agg(F.count("*").alias("n_"))
    seen = ordered.running(counts.withColumn("one_", F.lit(1)), ["v_"], [], {"upto_": ("sum", F.col("n_")), "dense_": ("sum", F.col("one_"))})
    low, n = (F.col("upto_") - F.col("n_") + 1).cast("double"), F.col("n_").cast("double")
    rank = {"min": low, "max": F.col("upto_").cast("double"), "dense": F.col("dense_").cast("double"), "average": low + (n - 1) / 2}[method]
    ranks = seen.select("v_", rank.alias("rank_"))
    return df.join(ranks, value == F.col("v_"), "left").drop("v_")


class StatOps:
    df: DataFrame

    def _one(self, c: Column):
        return self.df.agg(c.alias("x")).first()[0]

    def _each(self, fn) -> dict[str, float]:
        names = V.numeric_columns(self.df)
        if not names:
            return {}
        row = self.df.agg(*[fn(n).alias(str(i)) for i, n in enumerate(names)]).first()
        return {n: row[i] for i, n in enumerate(names)}

    def _x(self, name: str) -> Column:
        return V.as_double(self.df, name)

    def stat(self, name: str, fn: str, *args) -> Column:
        """The aggregate as a column, for use in one's own agg."""
        x = self._x(name)
        if fn in _provided:
            return _provided[fn](x)
        return {
            "sum": lambda: F.coalesce(F.sum(x), F.lit(0.0)),
            "mean": lambda: F.avg(x),
            "std": lambda: F.stddev_samp(x),
            "var": lambda: F.var_samp(x),
            "min": lambda: F.min(x),
            "max": lambda: F.max(x),
            "median": lambda: F.median(x),
            "count": lambda: F.count(V.present(self.df, name)),
            "prod": lambda: F.coalesce(F.product(x), F.lit(1.0)),
            "skew": lambda: skewness(x),
            "kurt": lambda: kurtosis(x),
            "sem": lambda: sem(x),
            "quantile": lambda: F.percentile(x, F.lit(float(args[0]))),
        }[fn]()

    def summary(self, wanted: dict[str, list[str]]):
        """A frame of one row: <column>_<fn> for each, in one pass."""
        parts = [self.stat(c, f).alias(f"{c}_{f}") for c, fs in wanted.items() for f in fs]
        return self._with(self.df.agg(*parts), [])

    def sum(self):
        return self._each(lambda n: self.stat(n, "sum"))

    def mean(self):
        return self._each(lambda n: self.stat(n, "mean"))

    def std(self):
        return self._each(lambda n: self.stat(n, "std"))

    def min(self):
        return self._each(lambda n: self.stat(n, "min"))

    def max(self):
        return self._each(lambda n: self.stat(n, "max"))

    def median(self):
        return self._each(lambda n: self.stat(n, "median"))

    def count(self):
        return {n: c for n, c in zip(self.df.columns, self.df.agg(*[F.count(V.present(self.df, n)).alias(str(i)) for i, n in enumerate(self.df.columns)]).first(), strict=True)}

    def col_sum(self, name):
        return self._one(self.stat(name, "sum"))

    def col_mean(self, name):
        return self._one(self.stat(name, "mean"))

    def col_std(self, name):
        return self._one(self.stat(name, "std"))

    def col_var(self, name):
        return self._one(self.stat(name, "var"))

    def col_min(self, name):
        return self._one(self.stat(name, "min"))

    def col_max(self, name):
        return self._one(self.stat(name, "max"))

    def col_median(self, name):
        return self._one(self.stat(name, "median"))

    def col_count(self, name):
        return self._one(self.stat(name, "count"))

    def col_percentile(self, name, share: float):
        if not 0 <= share <= 1:
            raise V.FrameError("a share is between 0 and 1")
        return self._one(self.stat(name, "quantile", share))

    col_quantile = col_percentile

    def col_prod(self, name):
        return self._one(self.stat(name, "prod"))

    def col_skew(self, name):
        return self._one(self.stat(name, "skew"))

    def col_kurt(self, name):
        return self._one(self.stat(name, "kurt"))

    def col_sem(self, name):
        return self._one(self.stat(name, "sem"))

    def mad_frame(self, name: str):
        """A frame of one row with the mean absolute deviation: the mean joins as one row."""
        x = self._x(name)
        mean = self.df.agg(F.avg(x).alias("mean_"))
        return self._with(self.df.select(x.alias("x_")).crossJoin(F.broadcast(mean)).agg(F.avg(F.abs(F.col("x_") - F.col("mean_"))).alias(f"{name}_mad")), [])

    def col_mad(self, name):
        return self.mad_frame(name).df.first()[0]

    def col_nunique(self, name):
        c = V.present(self.df, name)
        return self._one(F.count_distinct(c + F.lit(0.0) if V.is_float(V.field(self.df, name).dataType) else c))

    def col_nunique_df(self):
        parts = [F.count_distinct(V.present(self.df, n)).alias(n) for n in self.df.columns]
        return self._with(self.df.agg(*parts), [])

    def col_all(self, name) -> bool:
        return bool(self._one(F.coalesce(F.bool_and(truthy(self.df, name)), F.lit(True))))

    def col_any(self, name) -> bool:
        return bool(self._one(F.coalesce(F.bool_or(truthy(self.df, name)), F.lit(False))))

    def corr_frame(self, a: str, b: str, method: str = "pearson"):
        if method == "pearson":
            return self._with(self.df.agg(pearson(self._x(a), self._x(b)).alias("corr")), [])
        if method != "spearman":
            raise V.FrameError(f"unknown method {method!r}")
        both = self.df.select(self._x(a).alias("a_"), self._x(b).alias("b_")).where("a_ is not null and b_ is not null")
        first = ranked(both, "a_", "average", []).withColumnRenamed("rank_", "ra_")
        second = ranked(first, "b_", "average", [])
        return self._with(second.agg(pearson(F.col("ra_"), F.col("rank_")).alias("corr")), [])

    def col_corr(self, a: str, b: str, method: str = "pearson"):
        return self.corr_frame(a, b, method).df.first()[0]

    def col_cov(self, a: str, b: str):
        return self._one(covariance(self._x(a), self._x(b)))

    def _matrix(self, fn, names: list[str] | None):
        """_index_ and a column for each numeric one, from one aggregate of all pairs."""
        names = names or V.numeric_columns(self.df)
        pairs = [fn(self._x(a), self._x(b)).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
        one = self.df.agg(*pairs)
        rows = F.array(*[
            F.struct(F.lit(a).alias("_index_"), *[F.col(f"{min(i, j)}_{max(i, j)}").alias(b) for j, b in enumerate(names)])
            for i, a in enumerate(names)
        ])
        return self._with(one.select(F.explode(rows).alias("r")).select("r.*"), [])

    def corr_matrix(self, method: str = "pearson", names: list[str] | None = None):
        if method == "pearson":
            return self._matrix(pearson, names)
        names = names or V.numeric_columns(self.df)
        out = None
        for a in names:
            cells = [self.corr_frame(a, b, method).df.withColumnRenamed("corr", b) for b in names]
            row = cells[0]
            for c in cells[1:]:
                row = row.crossJoin(c)
            row = row.select(F.lit(a).alias("_index_"), *map(V.col, names))
            out = row if out is None else out.unionByName(row)
        return self._with(out, [])

    def cov_matrix(self, names: list[str] | None = None):
        return self._matrix(covariance, names)

    def describe(self, names: list[str] | None = None):
        """stat and the numeric columns: count, mean, std, min, quartiles, max; one aggregate."""
        names = names or V.numeric_columns(self.df)
        parts = []
        for i, n in enumerate(names):
            x = self._x(n)
            parts += [
                F.count(x).cast("double").alias(f"{i}_count"), F.avg(x).alias(f"{i}_mean"), F.stddev_samp(x).alias(f"{i}_std"),
                F.min(x).alias(f"{i}_min"), F.max(x).alias(f"{i}_max"),
                F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"{i}_q"),
            ]
        one = self.df.agg(*parts)
        cells = {
            "count": lambda i: F.col(f"{i}_count"), "mean": lambda i: F.col(f"{i}_mean"), "std": lambda i: F.col(f"{i}_std"),
            "min": lambda i: F.col(f"{i}_min"), "25%": lambda i: F.col(f"{i}_q")[0], "50%": lambda i: F.col(f"{i}_q")[1],
            "75%": lambda i: F.col(f"{i}_q")[2], "max": lambda i: F.col(f"{i}_max"),
        }
        rows = F.array(*[F.struct(F.lit(s).alias("stat"), *[cell(i).alias(n) for i, n in enumerate(names)]) for s, cell in cells.items()])
        return self._with(one.select(F.explode(rows).alias("r")).select("r.*"), [])

    # ---- by frequency and position
    def _counted(self, name: str) -> DataFrame:
        order = self.order()
        key = F.struct(*map(V.col, order)) if len(order) > 1 else V.col(order[0])
        c = V.present(self.df, name)
        return self.df.where(c.isNotNull()).groupBy(c.alias(name)).agg(F.count("*").alias("count"), F.min(key).alias("__first__"))

    def col_value_counts(self, name: str):
        """By count, most first, ties by first appearance."""
        return self._with(self._counted(name).orderBy(F.desc("count"), "__first__"), ["count", "__first__"])

    def col_mode(self, name: str):
        got = self._counted(name).orderBy(F.desc("count"), "__first__").first()
        return None if got is None else got[0]

    def _extreme(self, name: str, most: bool) -> int:
        row = V.fresh(self.df.columns, "row_")
        rows = ordered.numbered(self.df, self.order(), row).select(V.col(row).alias("row_"), self._x(name).alias("x_"))
        key = F.struct(F.col("x_") if most else -F.col("x_"), -F.col("row_"))
        got = rows.where("x_ is not null").agg(F.max_by("row_", key)).first()[0]
        return -1 if got is None else got

    def idxmax(self, name: str) -> int:
        """Row number of the first largest value; -1 if there is none."""
        return self._extreme(name, True)

    def idxmin(self, name: str) -> int:
        return self._extreme(name, False)

    argmax, argmin = idxmax, idxmin

    def is_monotonic_increasing(self, name: str) -> bool:
        made = ordered.windowed(
            self.df.select(*{n: V.col(n) for n in [*self.order(), name]}.values()), self.order(), [], 1, 0,
            lambda w: {"before_": F.lag(V.present(self.df, name)).over(w)},
        )
        return bool(made.agg(F.coalesce(F.bool_and(F.col("before_") <= V.present(self.df, name)), F.lit(True))).first()[0])

    def is_unique(self, name: str) -> bool:
        c = V.col(name)
        return self.df.groupBy(c).count().where("count > 1").isEmpty()

    def has_nans(self, name: str) -> bool:
        return not self.df.where(V.missing(self.df, name)).isEmpty()

    hasnans = has_nans

    # ---- statistics beside the column
    def col_rank(self, name: str, method: str = "average", new: str | None = None):
        out = ranked(self.df, name, method, self.order_by)
        return self._with(out.withColumnRenamed("rank_", new or f"{name}_rank"))

    def linear_fit(self, x: str, y: str):
        """A frame of one row: slope, intercept and r2 over pairs with both present."""
        a, b = self._x(x), self._x(y)
        return self._with(self.df.agg(F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), F.regr_r2(b, a).alias("r2")), [])
