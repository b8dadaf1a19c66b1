"""Joins: merge with its naming rules, as-of, and positional combinations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.functions import values as V
from loomframe.operators import ordered

HOWS = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "full": "full"}


def merged_names(left: list[str], right: list[str], left_on: Sequence[str], right_on: Sequence[str], suffixes) -> tuple[dict, dict]:
    """Names in the result of left's and right's columns. A key of one name on both sides comes
    once; every other clash takes a suffix on either side."""
    shared = {a for a, b in zip(left_on, right_on, strict=True) if a == b}
    clash = {n for n in left if n in right and n not in shared}
    return (
        {n: n + suffixes[0] if n in clash else n for n in left},
        {n: n + suffixes[1] if n in clash else n for n in right if n not in shared},
    )


def comparable(left: DataFrame, right: DataFrame, a: str, b: str) -> Column:
    """Keys match null to null; integers of any width match each other, not doubles."""
    x, y = V.field(left, a).dataType, V.field(right, b).dataType
    if V.is_number(x) and V.is_number(y) and V.is_float(x) != V.is_float(y):
        raise V.FrameError(f"keys {a!r} and {b!r} are an integer and a double; cast one")
    if V.kind_of(x) != V.kind_of(y):
        raise V.FrameError(f"keys {a!r} and {b!r} are a {V.kind_of(x)} and a {V.kind_of(y)}")
    return V.col("l." + a), V.col("r." + b)


class JoinOps:
    df: DataFrame

    def merge(self, right, how: str = "inner", on=None, left_on=None, right_on=None, suffixes=("_x", "_y")):
        left_on, right_on = _keys(on, left_on, right_on)
        if how not in HOWS:
            raise V.FrameError(f"unknown how {how!r}; there are {sorted(HOWS)}")
        ldf, rdf = self.df, right.df
        names_l, names_r = merged_names(ldf.columns, rdf.columns, left_on, right_on, suffixes)
        both = [*names_l.values(), *names_r.values()]
        if len(set(both)) != len(both):
            raise V.FrameError(f"names clash in the result: {both}")
        for a, b in zip(left_on, right_on, strict=True):
            comparable(ldf, rdf, a, b)
        # Distinct names on either side first, so that no reference is ambiguous.
        lq = ldf.toDF(*[f"l{i}" for i in range(len(ldf.columns))])
        rq = rdf.toDF(*[f"r{i}" for i in range(len(rdf.columns))])
        lk = {n: F.col(f"l{i}") for i, n in enumerate(ldf.columns)}
        rk = {n: F.col(f"r{i}") for i, n in enumerate(rdf.columns)}
        condition = None
        for a, b in zip(left_on, right_on, strict=True):
            x, y = self._key(lk[a], ldf, a), self._key(rk[b], rdf, b)
            # A null-safe comparison of columns that cannot be null is a plain one, and cheaper.
            plain = not V.field(ldf, a).nullable or not V.field(rdf, b).nullable
            part = x == y if plain else x.eqNullSafe(y)
            condition = part if condition is None else condition & part
        joined = lq.join(rq, condition, HOWS[how])
        shared = {a: b for a, b in zip(left_on, right_on, strict=True) if a == b}
        out = []
        for n, new in names_l.items():
            c = lk[n]
            if n in shared and how != "inner" and how != "left":
                c = F.coalesce(lk[n], rk[n]) if HOWS[how] == "full" else rk[n]
            out.append(c.alias(new))
        out += [rk[n].alias(new) for n, new in names_r.items()]
        order = [names_l[c] for c in self.order_by] if how in ("inner", "left", "outer", "full") else []
        after = [names_r.get(c, c) for c in right.order_by if names_r.get(c, c) not in order]
        return self._with(joined.select(*out), [*order, *after] if self.order_by or not order else [])

    @staticmethod
    def _key(c: Column, df: DataFrame, name: str) -> Column:
        kind = V.field(df, name).dataType
        if V.is_float(kind):
            return F.when(~F.isnan(c), c + F.lit(0.0))  # NaN is missing, and -0.0 is 0.0
        return c

    def join(self, right, on=None, how: str = "left", **kwargs):
        return self.merge(right, how=how, on=on, **kwargs)

    def semi_join(self, right, on=None, left_on=None, right_on=None, anti: bool = False):
        """Rows with (or without) a match; null keys match each other."""
        left_on, right_on = _keys(on, left_on, right_on)
        rq = right.df.select(*[V.col(b).alias(f"r{i}") for i, b in enumerate(right_on)])
        condition = None
        for i, a in enumerate(left_on):
            part = V.col(a).eqNullSafe(F.col(f"r{i}"))
            condition = part if condition is None else condition & part
        return self._with(self.df.join(rq, condition, "left_anti" if anti else "left_semi"))

    def anti_join(self, right, **kwargs):
        return self.semi_join(right, anti=True, **kwargs)

    def cross_join(self, right, suffix: str = "_r"):
        """Right-hand clashes take the suffix. The product is what was asked for; keep one side small."""
        renamed = right.df.toDF(*[n + suffix if n in self.df.columns else n for n in right.df.columns])
        return self._with(self.df.crossJoin(renamed))

    def merge_asof(self, right, on: str, by: Sequence[str] = ()):
        """Each row with the last right row whose key is not greater (of those alike in by).

        Both sides are laid into one stream by key, right rows first among equals, and the last
        right row seen is carried on: one shuffle, and no comparison of pairs. A missing key raises.
        """
        by = [by] if isinstance(by, str) else list(by)
        ldf, rdf = self.df, right.df
        extra = [n for n in rdf.columns if n != on and n not in by]
        if clash := [n for n in extra if n in ldf.columns]:
            raise V.FrameError(f"names clash in the result: {clash}")
        for df in (ldf, rdf):
            if not df.where(V.missing(df, on)).isEmpty():
                raise V.FrameError(f"missing values in the key {on!r}")
        side, key, got = (V.fresh([*ldf.columns, *rdf.columns], n) for n in ("side_", "key_", "got_"))
        key_type = V.field(ldf, on).dataType
        shape = T.StructType([rdf.schema[n] for n in extra])
        packed = F.struct(*map(V.col, extra)) if extra else F.struct(F.lit(1).alias("one"))
        left_rows = ldf.withColumns({side: F.lit(1), key: V.col(on).cast(key_type), got: F.lit(None).cast(shape if extra else "struct<one:int>")})
        right_rows = rdf.select(
            *[V.col(b) for b in by], F.lit(0).alias(side), V.col(on).cast(key_type).alias(key), packed.alias(got),
            *[V.col(c).alias(f"{got}{i}") for i, c in enumerate(right.order_by) if c != on],
        )
        ties = [f"{got}{i}" for i, c in enumerate(right.order_by) if c != on]
        stream = left_rows.unionByName(right_rows, allowMissingColumns=True)
        carried = ordered.running(stream, [key, side, *ties], by, {got: ("last", V.col(got))})
        kept = carried.where(V.col(side) == 1)
        out = kept.select(*map(V.col, ldf.columns), *[V.col(got)[n].alias(n) for n in extra])
        return self._with(out)

    def _by_row(self, other, combine):
        """Rows of both frames side by side, by position. combine gets the joined frame."""
        row = V.fresh([*self.df.columns, *other.df.columns], "row_")
        left = ordered.numbered(self.df, self.order(), row)
        right = ordered.numbered(other.df, other.order(), row)
        right = right.toDF(*[n if n == row else f"other.{n}" for n in right.columns])
        return combine(left.join(right, row, "left")).drop(row)

    def combine_first(self, other):
        """Missing cells filled from other's, by position; own columns only."""

        def fill(both: DataFrame) -> DataFrame:
            new = {}
            for n in self.df.columns:
                if n not in other.df.columns:
                    continue
                a, b = V.field(self.df, n).dataType, V.field(other.df, n).dataType
                if V.kind_of(a) != V.kind_of(b):
                    raise V.FrameError(f"column {n!r} is a {V.kind_of(a)} and a {V.kind_of(b)}")
                new[n] = F.coalesce(V.present(both, n), V.present(both, f"other.{n}"))
            return both.withColumns(new).select(*map(V.col, self.df.columns))

        return self._with(self._by_row(other, fill))

    def concat_columns(self, *others):
        """Side by side, by position; row counts must agree and names differ."""
        out = self
        for o in others:
            if clash := set(out.df.columns) & set(o.df.columns):
                raise V.FrameError(f"names clash in the result: {sorted(clash)}")
            if out.df.count() != o.df.count():
                raise V.FrameError("row counts differ")
            names = [*out.df.columns, *o.df.columns]
            own = out

            def widen(both: DataFrame, own=own, o=o, names=names) -> DataFrame:
                return both.select(*map(V.col, own.df.columns), *[V.col(f"other.{n}").alias(n) for n in o.df.columns])

            out = out._with(out._by_row(o, widen))
        return out

    def dot(self, other) -> float:
        """Of the first numeric columns, by position."""
        a, b = V.numeric_columns(self.df)[0], V.numeric_columns(other.df)[0]

        def both_sum(both: DataFrame) -> DataFrame:
            return both.agg(F.sum(V.as_double(both, a) * V.as_double(both, f"other.{b}")).alias("s"))

        return self._by_row(other, both_sum).first()[0] or 0.0


def _keys(on, left_on, right_on) -> tuple[list[str], list[str]]:
    if on is not None:
        left_on = right_on = on
    left_on = [left_on] if isinstance(left_on, str) else list(left_on or [])
    right_on = [right_on] if isinstance(right_on, str) else list(right_on or [])
    if not left_on or len(left_on) != len(right_on):
        raise V.FrameError("as many left keys as right keys are needed, one at least")
    return left_on, right_on
