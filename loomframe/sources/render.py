"""Frames as text: console, HTML, Markdown, LaTeX, and styled HTML or workbooks. Renderers show
results; they take at most MOST rows to the driver unless told otherwise."""

from __future__ import annotations

import html as htmllib
import math
import unicodedata
from collections.abc import Callable

from pyspark.sql import functions as F

from loomframe.frame import Frame
from loomframe.functions import values as V
from loomframe.sources.paths import write_bytes

MOST = 100_000
HIDDEN = ("__pos__", "__first__", "__at__")


def shown(frame: Frame, most: int) -> tuple[list[str], list[tuple], bool]:
    """Names, at most most rows in order, and whether there are more."""
    rows = list(frame.head(most + 1).iter_rows() if frame.order_by else frame._with(frame.df.limit(most + 1)).iter_rows())
    names = [n for n in frame.df.columns if n not in HIDDEN]
    at = [frame.df.columns.index(n) for n in names]
    return names, [tuple(r[i] for i in at) for r in rows[:most]], len(rows) > most


def absent(v) -> bool:
    return v is None or isinstance(v, float) and math.isnan(v)


def text_of(v, na: str) -> str:
    if absent(v):
        return na
    return {True: "true", False: "false"}[v] if isinstance(v, bool) else str(v)


def display_width(text: str) -> int:
    """Wide and full-width characters take two places, combining ones none."""
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def _cut(text: str, width: int) -> str:
    if display_width(text) <= width:
        return text
    out, used = "", 0
    for c in text:
        used += display_width(c)
        if used > width - 1:
            break
        out += c
    return out + "…"


def console(frame: Frame, most_rows: int = 20, most_width: int = 40, na: str = "<NA>") -> str:
    names, rows, more = shown(frame, most_rows)
    cells = [[_cut(n, most_width) for n in names]] + [[_cut(text_of(v, na).replace("\n", " "), most_width) for v in r] for r in rows]
    widths = [max((display_width(r[i]) for r in cells), default=0) for i in range(len(names))]
    lines = ["  ".join(c + " " * (w - display_width(c)) for c, w in zip(r, widths, strict=True)).rstrip() for r in cells]
    lines.insert(1, "  ".join("-" * w for w in widths))
    return "\n".join([*lines, *(["..."] if more else [])])


def to_html(
    frame: Frame, index: bool = False, border: int = 1, na: str = "<NA>", classes: str = "", most_rows: int = MOST, caption: str = ""
) -> str:
    names, rows, more = shown(frame, most_rows)
    esc = lambda s: htmllib.escape(s, quote=True)
    marks = f' class="{esc(classes)}"' if classes else ""
    out = [f'<table border="{border}"{marks}>']
    if caption:
        out.append(f"  <caption>{esc(caption)}</caption>")
    head = ([""] if index else []) + names
    out.append("  <thead><tr>" + "".join(f"<th>{esc(n)}</th>" for n in head) + "</tr></thead>")
    out.append("  <tbody>")
    for i, r in enumerate(rows):
        first = f"<th>{i}</th>" if index else ""
        out.append("    <tr>" + first + "".join(f"<td>{esc(text_of(v, na))}</td>" for v in r) + "</tr>")
    if more:
        out.append(f'    <tr><td colspan="{len(head)}">...</td></tr>')
    return "\n".join([*out, "  </tbody>", "</table>"])


def to_markdown(frame: Frame, index: bool = False, na: str = "", most_rows: int = MOST) -> str:
    names, rows, _ = shown(frame, most_rows)
    esc = lambda s: s.replace("\\", "\\\\").replace("|", "\\|").replace("\n", "<br>")
    head = ([""] if index else []) + [esc(n) for n in names]
    lines = ["| " + " | ".join(head) + " |", "| " + " | ".join("---" for _ in head) + " |"]
    for i, r in enumerate(rows):
        lines.append("| " + " | ".join(([str(i)] if index else []) + [esc(text_of(v, na)) for v in r]) + " |")
    return "\n".join(lines)


# Characters that LaTeX reads as its own.
LATEX = {
    "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}",
    "~": r"\textasciitilde{}", "^": r"\textasciicircum{}", "\\": r"\textbackslash{}",
}


def to_latex(frame: Frame, index: bool = False, booktabs: bool = True, caption: str = "", label: str = "", na: str = "", most_rows: int = MOST) -> str:
    names, rows, _ = shown(frame, most_rows)
    esc = lambda s: "".join(LATEX.get(c, c) for c in s)
    top, mid, bottom = (r"\toprule", r"\midrule", r"\bottomrule") if booktabs else (r"\hline",) * 3
    numeric = set(V.numeric_columns(frame.df))
    spec = ("l" if index else "") + "".join("r" if n in numeric else "l" for n in names)
    line = lambda cells: " & ".join(cells) + r" \\"
    body = [line(([str(i)] if index else []) + [esc(text_of(v, na)) for v in r]) for i, r in enumerate(rows)]
    out = [rf"\begin{{tabular}}{{{spec}}}", top, line(([""] if index else []) + [esc(n) for n in names]), mid, *body, bottom, r"\end{tabular}"]
    if caption or label:
        more = [rf"\caption{{{esc(caption)}}}"] * bool(caption) + [rf"\label{{{label}}}"] * bool(label)
        out = [r"\begin{table}", r"\centering", *out, *more, r"\end{table}"]
    return "\n".join(out)


def write_html(frame: Frame, path: str, **options) -> None:
    write_bytes(frame.spark, path, to_html(frame, **options).encode())


def write_markdown(frame: Frame, path: str, **options) -> None:
    write_bytes(frame.spark, path, to_markdown(frame, **options).encode())


def write_latex(frame: Frame, path: str, **options) -> None:
    write_bytes(frame.spark, path, to_latex(frame, **options).encode())


def _rgb(color: str) -> tuple[int, int, int]:
    color = color.lstrip("#")
    return int(color[:2], 16), int(color[2:4], 16), int(color[4:6], 16)


def blend(low: str, high: str, share: float) -> str:
    """The colour share of the way from low to high."""
    return "#" + "".join(f"{round(a + (b - a) * share):02x}" for a, b in zip(_rgb(low), _rgb(high), strict=True))


class Styler:
    """Styled export. Column extremes come from one aggregate over the whole frame; cells are then
    styled as they are rendered."""

    def __init__(self, frame: Frame):
        self.frame, self.rules, self.formats = frame, [], {}
        self.caption, self.na, self.index, self.hidden, self.css = "", "<NA>", True, set(), ""
        self.wanted: set[str] = set()

    def format(self, name: str, form: str | Callable) -> Styler:
        self.formats[name] = form
        return self

    def _rule(self, names, css: Callable) -> Styler:
        names = names or V.numeric_columns(self.frame.df)
        self.rules.append((set(names), css))
        return self

    def highlight_max(self, color: str = "#ffff00", *names: str) -> Styler:
        self.wanted |= set(names or V.numeric_columns(self.frame.df))
        return self._rule(names, lambda n, v, row, ends: f"background-color: {color}" if not absent(v) and v == ends[n][1] else "")

    def highlight_min(self, color: str = "#ffff00", *names: str) -> Styler:
        self.wanted |= set(names or V.numeric_columns(self.frame.df))
        return self._rule(names, lambda n, v, row, ends: f"background-color: {color}" if not absent(v) and v == ends[n][0] else "")

    def highlight_null(self, color: str = "#ff0000") -> Styler:
        return self._rule(self.frame.df.columns, lambda n, v, row, ends: f"background-color: {color}" if absent(v) else "")

    def background_gradient(self, low: str = "#ffffff", high: str = "#ff0000", *names: str) -> Styler:
        self.wanted |= set(names or V.numeric_columns(self.frame.df))

        def css(n, v, row, ends):
            if absent(v) or ends[n][0] is None:
                return ""
            span = ends[n][1] - ends[n][0]
            return f"background-color: {blend(low, high, (v - ends[n][0]) / span if span else 0.0)}"

        return self._rule(names, css)

    def bar(self, color: str = "#5fba7d", *names: str) -> Styler:
        self.wanted |= set(names or V.numeric_columns(self.frame.df))

        def css(n, v, row, ends):
            if absent(v) or ends[n][1] == ends[n][0]:
                return ""
            share = 100 * (v - ends[n][0]) / (ends[n][1] - ends[n][0])
            return f"background: linear-gradient(90deg, {color} {share:.1f}%, transparent {share:.1f}%)"

        return self._rule(names, css)

    def font_color(self, color: str, *names: str) -> Styler:
        return self._rule(names or self.frame.df.columns, lambda n, v, row, ends: f"color: {color}")

    def font_color_if(self, name: str, test: Callable, color: str) -> Styler:
        return self._rule([name], lambda n, v, row, ends: f"color: {color}" if not absent(v) and test(v) else "")

    def bold(self, *names: str) -> Styler:
        return self._rule(names or self.frame.df.columns, lambda n, v, row, ends: "font-weight: bold")

    def bold_if(self, name: str, test: Callable) -> Styler:
        return self._rule([name], lambda n, v, row, ends: "font-weight: bold" if not absent(v) and test(v) else "")

    def row_background_if(self, test: Callable, color: str) -> Styler:
        return self._rule(self.frame.df.columns, lambda n, v, row, ends: f"background-color: {color}" if test(row) else "")

    def column_background(self, name: str, color: str) -> Styler:
        return self._rule([name], lambda n, v, row, ends: f"background-color: {color}")

    def set_caption(self, text: str) -> Styler:
        self.caption = text
        return self

    def hide_index(self) -> Styler:
        self.index = False
        return self

    def hide_columns(self, *names: str) -> Styler:
        self.hidden |= set(names)
        return self

    def set_table_styles(self, css: str) -> Styler:
        self.css = css
        return self

    def na_rep(self, text: str) -> Styler:
        self.na = text
        return self

    def _ends(self) -> dict[str, tuple]:
        names = sorted(self.wanted)
        if not names:
            return {}
        got = self.frame.df.agg(*[f(V.present(self.frame.df, n)).alias(f"{i}{j}") for i, n in enumerate(names) for j, f in enumerate((F.min, F.max))]).first()
        return {n: (got[2 * i], got[2 * i + 1]) for i, n in enumerate(names)}

    def _cells(self, most: int):
        names, rows, _ = shown(self.frame, most)
        ends = self._ends()
        for row in rows:
            record = dict(zip(names, row, strict=True))
            yield [
                (n, v, "; ".join(s for cols, css in self.rules if n in cols and (s := css(n, v, record, ends))))
                for n, v in record.items()
                if n not in self.hidden
            ]

    def _text(self, name: str, v) -> str:
        form = self.formats.get(name)
        if absent(v) or form is None:
            return text_of(v, self.na)
        return form(v) if callable(form) else form.format(v)

    def to_html(self, most_rows: int = MOST) -> str:
        esc = lambda s: htmllib.escape(s, quote=True)
        names = [n for n in self.frame.df.columns if n not in HIDDEN and n not in self.hidden]
        out = [f"<style>{self.css}</style>"] * bool(self.css) + ["<table>"]
        out += [f"<caption>{esc(self.caption)}</caption>"] * bool(self.caption)
        out.append("<thead><tr>" + "<th></th>" * self.index + "".join(f"<th>{esc(n)}</th>" for n in names) + "</tr></thead><tbody>")
        for i, row in enumerate(self._cells(most_rows)):
            cells = "".join(f"<td{f' style={chr(34)}{esc(css)}{chr(34)}' if css else ''}>{esc(self._text(n, v))}</td>" for n, v, css in row)
            out.append("<tr>" + f"<th>{i}</th>" * self.index + cells + "</tr>")
        return "\n".join([*out, "</tbody></table>"])

    def to_excel(self, path: str, sheet: str = "Sheet1") -> None:
        """Values with their background colours."""
        import re

        from loomframe.sources.excel import MOST_ROWS, workbook

        rows, painted = [], {}
        for i, row in enumerate(self._cells(MOST_ROWS)):
            rows.append(tuple(v for _, v, _ in row))
            for j, (_, _, css) in enumerate(row):
                if found := re.findall(r"background-color: #([0-9a-fA-F]{6})", css):
                    painted[i, j] = found[-1].upper()
        names = [n for n in self.frame.df.columns if n not in HIDDEN and n not in self.hidden]
        write_bytes(self.frame.spark, path, workbook({sheet: (names, rows)}, {sheet: painted}))
