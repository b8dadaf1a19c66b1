"""Time steps such as 5min, 1D, 1ME: parsing, stepping, grids."""

from __future__ import annotations

import calendar
import datetime as dt
import re
from dataclasses import dataclass

from loomframe.functions.values import FrameError

# The units, as seconds or as months.
SECONDS = {"s": 1, "min": 60, "h": 3600, "d": 86_400, "w": 7 * 86_400}
MONTHS = {"m": 1, "ms": 1, "me": 1, "q": 3, "qe": 3, "y": 12, "ys": 12, "ye": 12}

#: Most points of a grid.
MOST_POINTS = 100_000


def add_months(t: dt.datetime, n: int) -> dt.datetime:
    """To the same day, or the month's last if it has none such."""
    year, month = divmod(t.year * 12 + t.month - 1 + n, 12)
    return t.replace(year=year, month=month + 1, day=min(t.day, calendar.monthrange(year, month + 1)[1]))


def month_floor(t: dt.datetime, start: bool) -> dt.datetime:
    """Midnight of the last first (start) or last day of a month that is not after t's day."""
    day = t.replace(hour=0, minute=0, second=0, microsecond=0)
    if start:
        return day.replace(day=1)
    last = calendar.monthrange(t.year, t.month)[1]
    return day if t.day == last else day.replace(day=1) - dt.timedelta(days=1)


@dataclass(frozen=True)
class Frequency:
    """amount of unit; unit is a key of SECONDS or MONTHS."""

    amount: int
    unit: str

    @classmethod
    def parse(cls, text: str) -> Frequency:
        units = sorted([*SECONDS, *MONTHS], key=len, reverse=True)
        m = re.fullmatch(rf"([0-9]+)?\s*({'|'.join(units)})", text.strip(), re.IGNORECASE)
        if not m or m[1] and int(m[1]) < 1:
            raise FrameError(f"unknown time step {text!r}")
        return cls(int(m[1] or 1), m[2].lower())

    @property
    def seconds(self) -> int | None:
        """Of a step that is always as long; None for months."""
        return SECONDS[self.unit] * self.amount if self.unit in SECONDS else None

    @property
    def months(self) -> int:
        return MONTHS[self.unit] * self.amount

    def plus(self, t: dt.datetime) -> dt.datetime:
        if self.seconds is not None:
            return t + dt.timedelta(seconds=self.seconds)
        later = add_months(t, self.months)
        if self.unit not in ("ms", "me"):
            return later
        at = month_floor(later, self.unit == "ms")
        while at <= t:  # a short month's end lies before the same day of a long one
            at = add_months(at.replace(day=1), 1)
            if self.unit == "me":
                at = add_months(at, 1) - dt.timedelta(days=1)
        return at

    def minus(self, t: dt.datetime) -> dt.datetime:
        if self.seconds is not None:
            return t - dt.timedelta(seconds=self.seconds)
        earlier = add_months(t, -self.months)
        return month_floor(earlier, self.unit == "ms") if self.unit in ("ms", "me") else earlier

    def align_start(self, t: dt.datetime) -> dt.datetime:
        """Months' starts and ends are anchors; any other step starts where the data do."""
        return month_floor(t, self.unit == "ms") if self.unit in ("ms", "me") else t

    def range(self, start: dt.datetime, count: int) -> list[dt.datetime]:
        out = []
        for _ in range(count):
            out.append(start)
            start = self.plus(start)
        return out

    def grid(self, start: dt.datetime, end: dt.datetime) -> list[dt.datetime]:
        """Bin edges from start's anchor to the first one after end."""
        at = self.align_start(start)
        out = [at]
        while at <= end:
            at = self.plus(at)
            out.append(at)
            if len(out) > MOST_POINTS + 1:
                raise FrameError(f"more than {MOST_POINTS} steps; take a longer one")
        return out

    def steps_between(self, start: dt.datetime, end: dt.datetime) -> int:
        """Whole steps, towards 0."""
        if self.seconds is not None:
            whole = int(abs((end - start).total_seconds()) // self.seconds)
            return whole if end >= start else -whole
        low, high = min(start, end), max(start, end)
        months = (high.year - low.year) * 12 + high.month - low.month
        if add_months(low, months) > high:
            months -= 1
        return (months // self.months) * (1 if end >= start else -1)


def infer(first: list[dt.datetime]) -> str:
    """From three times: their step if both gaps agree."""
    if len(first) < 3:
        return "unknown"
    a, b = first[1] - first[0], first[2] - first[1]
    if a != b or a <= dt.timedelta(0):
        return "unknown"
    seconds = int(a.total_seconds())
    for size, name in ((86_400, "D"), (3600, "H"), (60, "min"), (1, "s")):
        if seconds % size == 0 and seconds >= size:
            return f"{seconds // size}{name}"
    return "unknown"
