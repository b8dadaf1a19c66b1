"""Sorting and top-k. Sorted frames keep their sort keys as their order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.functions import values as V
from loomframe.operators import ordered


def sort_column(df: DataFrame, name: str, ascending: bool, na_last: bool = True) -> Column:
    c = V.present(df, name)
    if na_last:
        return c.asc_nulls_last() if ascending else c.desc_nulls_last()
    return c.asc_nulls_first() if ascending else c.desc_nulls_first()


class SortOps:
    df: DataFrame

    def sort_by(self, names: str | Sequence[str], ascending: bool | Sequence[bool] = True, na_position: str = "last"):
        """Missing values last either way (or first); ties by the frame's order."""
        names = [names] if isinstance(names, str) else list(names)
        ups = [ascending] * len(names) if isinstance(ascending, bool) else list(ascending)
        if len(ups) != len(names):
            raise V.FrameError("as many directions as names are needed")
        keys = [sort_column(self.df, n, up, na_position == "last") for n, up in zip(names, ups, strict=True)]
        return self._with(self.df.orderBy(*keys, *ordered.order_columns(self.order_by)))

    def sort_index(self, ascending: bool = True, index: str = "__idx__"):
        if index in self.df.columns:
            return self.sort_by(index, ascending)
        keys = [V.col(c).asc_nulls_last() if ascending else V.col(c).desc_nulls_first() for c in self.order()]
        return self._with(self.df.orderBy(*keys))

    def sort_indices(self, name: str, ascending: bool = True):
        """A frame of one column, position: row numbers in the sorted order of name."""
        row, place = (V.fresh(self.df.columns, n) for n in ("position", "place_"))
        rows = ordered.numbered(self.df, self.order(), row)
        return self._with(rows.orderBy(sort_column(self.df, name, ascending), row).select(V.col(row).alias("position")), [])

    def nlargest(self, n: int, name: str):
        """Ties by the frame's order; missing values only if others do not suffice."""
        keys = [sort_column(self.df, name, False), *ordered.order_columns(self.order_by)]
        return self._with(self.df.orderBy(*keys).limit(n))

    def nsmallest(self, n: int, name: str):
        keys = [sort_column(self.df, name, True), *ordered.order_columns(self.order_by)]
        return self._with(self.df.orderBy(*keys).limit(n))

    def top_k_by(self, names: Sequence[str], k: int, by: str, ascending: bool = False):
        """The first k rows by a column in each group, by a window with a group limit."""
        from pyspark.sql.window import Window

        place = V.fresh(self.df.columns, "place_")
        spec = Window.partitionBy(*map(V.col, names)).orderBy(sort_column(self.df, by, ascending), *ordered.order_columns(self.order_by))
        return self._with(self.df.withColumn(place, F.row_number().over(spec)).where(V.col(place) <= k).drop(place))
