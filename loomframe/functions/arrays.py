"""The array library's functions: statistics with its own conventions, logic, fits, random columns;
matrices are numpy's, on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.functions.values import FrameError, divided


def kept(c: Column, policy: str = "skip") -> Column:
    """skip passes NaN over, error raises at one, propagate lets it through to the result."""
    if policy == "skip":
        return F.when(~F.isnan(c), c)
    if policy == "error":
        return F.when(F.isnan(c), F.raise_error(F.lit("NaN in the data")).cast("double")).otherwise(c)
    if policy != "propagate":
        raise FrameError(f"unknown NaN policy {policy!r}")
    return c


def statistic(c: Column, fn: str, policy: str = "skip") -> Column:
    x = kept(c.cast("double"), policy)
    made = {
        "sum": lambda: F.coalesce(F.sum(x), F.lit(0.0)), "mean": lambda: F.avg(x), "min": lambda: F.min(x), "max": lambda: F.max(x),
        "count": lambda: F.count(x), "std": lambda: F.stddev_samp(x), "var": lambda: F.var_samp(x), "median": lambda: F.median(x),
    }
    if fn not in made:
        raise FrameError(f"unknown statistic {fn!r}; there are {sorted(made)}")
    return made[fn]()


def percentile(c: Column, p: float, policy: str = "skip") -> Column:
    """p from 0 to 100, at position p (n + 1) / 100 of the sorted values, by interpolation; the
    ends beyond the first and last. Linear percentiles at shifted shares give the same."""
    if not 0 < p <= 100:
        raise FrameError("p is above 0 and at most 100")
    x = kept(c.cast("double"), policy)
    values = F.array_sort(F.collect_list(x))  # for arrays, which fit a row; columns take quantile
    n = F.size(values)
    at = F.lit(p / 100.0) * (n + 1)
    low = F.greatest(F.lit(1), F.least(F.floor(at).cast("int"), n))
    high = F.least(low + 1, n)
    part = at - F.floor(at)
    inside = F.element_at(values, low) + part * (F.element_at(values, high) - F.element_at(values, low))
    return F.when(n == 0, F.lit(None).cast("double")).when(at < 1, F.element_at(values, 1)).when(at >= n, F.element_at(values, -1)).otherwise(inside)


def quantile(c: Column, q: float, policy: str = "skip") -> Column:
    return F.percentile(kept(c.cast("double"), policy), F.lit(float(q)))


def logical(op: str, a: Column, b: Column | None = None) -> Column:
    """and, or, not: missing if any operand is."""
    if op == "not":
        return ~a
    both = a.isNotNull() & b.isNotNull()
    return F.when(both, a & b if op == "and" else a | b)


def arithmetic(op: str, a: Column, b: Column) -> Column:
    """Whole numbers stay whole but for /, which gives doubles; overflow wraps as 64-bit numbers do."""
    if op == "div":
        return divided(a.cast("double"), b.cast("double"))
    return {"add": a + b, "sub": a - b, "mul": a * b}[op]


def random_column(kind: str, seed: int, low: float = 0, high: float = 1, n: int = 1, p: float = 0.5) -> Column:
    """rand, randn, randint (low to high, exclusive) and binomial, by Spark's seeded generators."""
    if kind == "rand":
        return F.rand(seed)
    if kind == "randn":
        return F.randn(seed)
    if kind == "randint":
        return (F.floor(F.rand(seed) * (high - low)) + low).cast("long")
    if kind == "binomial":
        total = F.lit(0)
        for i in range(n):
            total = total + (F.rand(seed + i) < p).cast("int")
        return total.cast("long")
    raise FrameError(f"unknown kind {kind!r}")


def choice(spark: SparkSession, values: list, n: int, seed: int) -> DataFrame:
    """n draws with replacement."""
    at = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(len(values))).cast("int")
    return spark.range(n).select(F.get(F.array(*map(F.lit, values)), at).alias("value"))


class Matrix:
    """A dense matrix on the driver."""

    def __init__(self, rows):
        self.a = np.array(rows, float)
        if self.a.ndim != 2:
            raise FrameError("a matrix has rows of one length")

    @classmethod
    def identity(cls, n: int) -> Matrix:
        return cls(np.eye(n))

    @property
    def shape(self) -> tuple[int, int]:
        return self.a.shape

    def get(self, i: int, j: int) -> float:
        return float(self.a[i, j])

    def row(self, i: int) -> list[float]:
        return self.a[i].tolist()

    def to_array(self) -> list[list[float]]:
        return self.a.tolist()

    def add(self, other: Matrix) -> Matrix:
        self._same(other)
        return Matrix(self.a + other.a)

    def sub(self, other: Matrix) -> Matrix:
        self._same(other)
        return Matrix(self.a - other.a)

    def mul(self, other: Matrix | float) -> Matrix:
        if not isinstance(other, Matrix):
            return Matrix(self.a * other)
        if self.shape[1] != other.shape[0]:
            raise FrameError(f"{self.shape} by {other.shape}")
        return Matrix(self.a @ other.a)

    matmul = mul

    def transpose(self) -> Matrix:
        return Matrix(self.a.T)

    T = property(transpose)

    def _same(self, other: Matrix) -> None:
        if self.shape != other.shape:
            raise FrameError(f"{self.shape} against {other.shape}")

    def _square(self) -> None:
        if self.shape[0] != self.shape[1]:
            raise FrameError("the matrix is not square")

    def solve(self, b: list[float]) -> list[float]:
        self._square()
        try:
            return np.linalg.solve(self.a, np.array(b, float)).tolist()
        except np.linalg.LinAlgError:
            raise FrameError("the matrix is singular") from None

    def determinant(self) -> float:
        self._square()
        return float(np.linalg.det(self.a))

    def inverse(self) -> Matrix:
        self._square()
        try:
            return Matrix(np.linalg.inv(self.a))
        except np.linalg.LinAlgError:
            raise FrameError("the matrix is singular") from None

    def least_squares(self, b: list[float]) -> list[float]:
        return np.linalg.lstsq(self.a, np.array(b, float), rcond=None)[0].tolist()
