"""Order-dependent functions that do not put a table into one task.

A window without a partition key runs in one task. Up to SINGLE rows that is the quickest plan.
Beyond it rows are dealt into ranges of the order key, numbered by a prefix sum over the ranges'
counts, and then dealt into runs of BLOCK consecutive rows. Running
functions combine each run's own with what earlier runs carry over; frames of bounded length get
the rows that reach into a run as a halo.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from loomframe.functions.scratch import staged
from loomframe.functions.values import col, fresh

SINGLE = 1 << 20
BLOCK = 1 << 18


def order_columns(order: list[str]) -> list[Column]:
    return [col(c).asc_nulls_last() for c in order]


def numbered(df: DataFrame, order: list[str], name: str, single: int | None = None) -> DataFrame:
    """df with name: row numbers from 0 in the order of order.

    A large table is dealt into ranges of the whole order key, and of a running number behind it, so
    that neither like prefixes nor rows that tie meet in one task. The ranges are written once: rows are
    counted and numbered in the same ones, even where an executor is lost in between."""
    single = SINGLE if single is None else single
    count = df.count()
    if count <= single:
        whole = Window.orderBy(*order_columns(order))
        return df.withColumn(name, (F.row_number().over(whole) - 1).cast("long"))
    part, tie, offset = (fresh([*df.columns, name], n) for n in ("part", "tie", "offset"))
    parts = -(-count // max(1, single // 4))
    keys = [*order_columns(order), col(tie)]
    ranged = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(parts, *keys)
    dealt = staged(ranged.withColumn(part, F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(part).agg(F.count("*").alias("n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(col(part), F.coalesce(F.sum("n").over(before), F.lit(0)).alias(offset))
    inside = Window.partitionBy(part).orderBy(*keys)
    joined = dealt.join(F.broadcast(offsets), part)  # a row for each range
    return joined.withColumn(name, (F.row_number().over(inside) - 1 + col(offset)).cast("long")).drop(part, tie, offset)


def windowed(
    df: DataFrame, order: list[str], partition: list[str], before: int, after: int,
    make: Callable[[WindowSpec], dict[str, Column]], single: int | None = None, block: int | None = None,
) -> DataFrame:
    """df with the columns of make, whose windows look at most before rows back and after ahead."""
    single, block = SINGLE if single is None else single, BLOCK if block is None else block
    if partition:
        return df.withColumns(make(Window.partitionBy(*map(col, partition)).orderBy(*order_columns(order))))
    if df.count() <= single:
        return df.withColumns(make(Window.orderBy(*order_columns(order))))
    row, run, own = (fresh(df.columns, n) for n in ("row_", "run_", "own_"))
    block = max(block, before, after, 1)
    rows = numbered(df, order, row, single).withColumn(own, F.floor(col(row) / block))
    place = F.pmod(col(row), F.lit(block))
    runs = F.array_compact(
        F.array(
            col(own),
            F.when(place >= block - before, col(own) + 1),
            F.when((place < after) & (col(own) > 0), col(own) - 1),
        )
    )
    spread = rows.withColumn(run, F.explode(runs))
    made = spread.withColumns(make(Window.partitionBy(run).orderBy(row)))
    return made.where(col(run) == col(own)).drop(row, run, own)


#: name -> (aggregate over a window, how a run's own value joins what is carried over)
RUNNING: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "sum": (F.sum, lambda carried, own: carried + own),
    "count": (F.count, lambda carried, own: carried + own),
    "product": (F.product, lambda carried, own: carried * own),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda carried, own: own),
    "next": (lambda c: F.last(c, ignorenulls=True), lambda carried, own: own),
}


def running(
    df: DataFrame, order: list[str], partition: list[str], wanted: dict[str, tuple[str, Column]],
    single: int | None = None, block: int | None = None,
) -> DataFrame:
    """df with wanted: name -> (function of RUNNING, column), over all rows up to each one; next
    looks at all rows from each one on instead. Missing values are passed over.

    What next looks at comes first in the order turned round: in a frame that ends with the last row
    Spark goes through all that follows again for each row."""
    single, block = SINGLE if single is None else single, BLOCK if block is None else block

    def over(fn: str, c: Column, keyed: type[Window] | WindowSpec, order: list[str], end: int = 0) -> Column:
        by = [col(o).desc_nulls_first() for o in order] if fn == "next" else order_columns(order)
        return RUNNING[fn][0](c).over(keyed.orderBy(*by).rowsBetween(Window.unboundedPreceding, end))

    if partition or df.count() <= single:
        keyed = Window.partitionBy(*map(col, partition)) if partition else Window
        return df.withColumns({n: over(fn, c, keyed, order) for n, (fn, c) in wanted.items()})
    # The columns asked for are made before the rows are written, as they may be those of df itself.
    given = {n: fresh([*df.columns, *wanted], f"{n}_given") for n in wanted}
    df = df.withColumns({given[n]: c for n, (_, c) in wanted.items()})
    wanted = {n: (fn, col(given[n])) for n, (fn, _) in wanted.items()}
    row, run = (fresh([*df.columns, *wanted], n) for n in ("row_", "run_"))
    rows = numbered(df, order, row, single).withColumn(run, F.floor(col(row) / block))
    own = rows.withColumns({n: over(fn, c, Window.partitionBy(run), [row]) for n, (fn, c) in wanted.items()})
    total = {"last": lambda c: F.max_by(c, F.when(c.isNotNull(), col(row))), "next": lambda c: F.min_by(c, F.when(c.isNotNull(), col(row)))}
    sums = rows.groupBy(run).agg(*[total.get(fn, RUNNING[fn][0])(c).alias(n) for n, (fn, c) in wanted.items()])
    carry = {n: fresh([*own.columns, *wanted], f"{n}_carried") for n in wanted}
    joins = {"count": "sum"}  # counts of runs add up; all else combines as it is made
    carried = sums.select(run, *[over(joins.get(fn, fn), col(n), Window, [run], -1).alias(carry[n]) for n, (fn, _) in wanted.items()])
    joined = own.join(carried, run)
    both = {
        n: F.when(col(carry[n]).isNull(), col(n)).when(col(n).isNull(), col(carry[n])).otherwise(RUNNING[fn][1](col(carry[n]), col(n)))
        for n, (fn, _) in wanted.items()
    }
    return joined.withColumns(both).drop(row, run, *carry.values(), *given.values())
