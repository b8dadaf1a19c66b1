"""Python source that names a frame's columns."""

from __future__ import annotations

import keyword
import re


def columns_source(frame, cls: str = "Columns") -> str:
    """A class with a constant for each column."""
    used: set[str] = set()
    lines = [f"class {cls}:"]
    for n in frame.df.columns:
        name = re.sub(r"\W+", "_", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", n)).strip("_").upper() or "COLUMN"
        name = f"C_{name}" if name[0].isdigit() or keyword.iskeyword(name.lower()) else name
        base, k = name, 2
        while name in used:
            name, k = f"{base}_{k}", k + 1
        used.add(name)
        lines.append(f"    {name} = {n!r}")
    return "\n".join(lines) + "\n"
