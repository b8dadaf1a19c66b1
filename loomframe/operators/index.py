"""Row labels. A label lives in ordinary columns; an Index names them, a level for each column."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import functions as F

from loomframe.functions import values as V


class Index:
    """The labels of a frame, by the columns that hold them."""

    def __init__(self, frame, *levels: str):
        self.frame, self.levels = frame, list(levels)
        for n in levels:
            V.field(frame.df, n)

    def _of(self, df, levels: Sequence[str] | None = None) -> Index:
        return Index(self.frame._with(df), *(self.levels if levels is None else levels))

    def labels(self) -> list:
        rows = list(self.frame.select(*self.levels, *[c for c in self.frame.order_by if c not in self.levels]).iter_rows())
        return [r[0] if len(self.levels) == 1 else tuple(r[: len(self.levels)]) for r in rows]

    def slice(self, start: int, end: int | None = None) -> Index:
        return Index(self.frame.slice(start, end), *self.levels)

    def take(self, *rows: int) -> Index:
        return Index(self.frame.iloc(*rows), *self.levels)

    def filter(self, keep: Callable) -> Index:
        """keep(column of the first level) is a condition."""
        return self._of(self.frame.df.where(keep(V.col(self.levels[0]))))

    def unique(self) -> Index:
        return Index(self.frame.drop_duplicates(self.levels), *self.levels)

    drop_duplicates = unique

    def isin(self, *wanted):
        return self.frame.col_isin(self.levels[0], *wanted)

    # ---- several levels
    def level(self, i: int) -> str:
        return self.levels[i]

    def droplevel(self, *which: int | str) -> Index:
        gone = {self.levels[w] if isinstance(w, int) else w for w in which}
        left = [n for n in self.levels if n not in gone]
        if not left:
            raise V.FrameError("one level at least stays")
        return self._of(self.frame.df, left)

    def swaplevel(self, i: int = -2, j: int = -1) -> Index:
        levels = list(self.levels)
        levels[i], levels[j] = levels[j], levels[i]
        return self._of(self.frame.df, levels)

    def reorder_levels(self, order: Sequence[int | str]) -> Index:
        levels = [self.levels[o] if isinstance(o, int) else o for o in order]
        if sorted(levels) != sorted(self.levels):
            raise V.FrameError(f"an order of all of {self.levels} is needed")
        return self._of(self.frame.df, levels)

    # ---- times
    def infer_freq(self) -> str:
        return self.frame.infer_freq(self.levels[0])

    def asof(self, label):
        """The label of the last row, in row order, that is not after label."""
        got = self.frame.asof(self.levels[0], label).df.select(V.col(self.levels[0])).first()
        return None if got is None else got[0]

    def at_time(self, time: str) -> Index:
        return Index(self.frame.at_time(self.levels[0], time), *self.levels)

    def between_time(self, start: str, end: str) -> Index:
        return Index(self.frame.between_time(self.levels[0], start, end), *self.levels)

    def first_valid(self):
        row = self.frame.df.where(~V.missing(self.frame.df, self.levels[0])).select(F.min_by(V.col(self.levels[0]), F.struct(*map(V.col, self.frame.order()))))
        return row.first()[0]
