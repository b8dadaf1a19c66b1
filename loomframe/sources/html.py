"""Tables of HTML pages."""

from __future__ import annotations

import re
import urllib.request
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.frame import Frame, frame
from loomframe.functions.values import FrameError
from loomframe.sources.files import unique_names
from loomframe.sources.paths import read_bytes


class _Tables(HTMLParser):
    """Cells of every table; nested ones are tables of their own."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[list[tuple[bool, list[str]]]] = []
        self.open: list[dict] = []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
            self.open.append({"rows": self.tables[-1], "row": None, "cell": None, "head": False})
        elif self.open:
            t = self.open[-1]
            if tag == "tr":
                t["row"], t["head"] = [], True
            elif tag in ("td", "th") and t["row"] is not None:
                self._close_cell(t)
                t["cell"] = ""
                t["head"] = t["head"] and tag == "th"
            elif tag == "br" and t["cell"] is not None:
                t["cell"] += " "

    def handle_endtag(self, tag):
        if not self.open:
            return
        t = self.open[-1]
        if tag in ("td", "th"):
            self._close_cell(t)
        elif tag in ("tr", "table"):
            self._close_cell(t)
            if t["row"]:
                t["rows"].append((t["head"], t["row"]))
            t["row"] = None
            if tag == "table":
                self.open.pop()

    @staticmethod
    def _close_cell(t):
        if t["cell"] is not None:
            t["row"].append(re.sub(r"\s+", " ", t["cell"]).strip())
            t["cell"] = None

    def handle_data(self, data):
        if self.open and self.open[-1]["cell"] is not None:
            self.open[-1]["cell"] += data


def tables_of(html: str | None) -> list[tuple[list[str], list[list[str | None]]]]:
    """(header, rows) of each table; a first row of th cells is the header, else places name the
    columns. Empty cells and <NA> are missing."""
    parser = _Tables()
    parser.feed(html or "")
    out = []
    for rows in parser.tables:
        if not rows:
            continue
        width = max(len(r) for _, r in rows)
        head, body = (rows[0][1], rows[1:]) if rows[0][0] else ([], rows)
        names = unique_names(head + [""] * (width - len(head)))
        out.append((names, [[c if c not in ("", "<NA>") else None for c in r] + [None] * (width - len(r)) for _, r in body]))
    return out


def parse(spark: SparkSession, text: str, match: str | None = None) -> list[Frame]:
    """The tables of one page, as frames; match keeps those in which it is found."""
    out = []
    for names, rows in tables_of(text):
        if match and not any(match in (c or "") for r in [names, *rows] for c in r):
            continue
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        out.append(frame([tuple(r) for r in rows], schema=schema, spark=spark).infer_objects(*names))
    return out


def read_all(spark: SparkSession, path: str, match: str | None = None) -> list[Frame]:
    return parse(spark, read_bytes(spark, path).decode("utf-8", "replace"), match)


def read_html(spark: SparkSession, path: str, at: int = 0, match: str | None = None) -> Frame:
    found = read_all(spark, path, match)
    if at >= len(found):
        raise FrameError(f"{path} has {len(found)} tables")
    return found[at]


def read_url(spark: SparkSession, url: str, at: int = 0, seconds: float = 10, most: int = 8 << 20) -> Frame:
    if not re.match(r"https?://", url):
        raise FrameError("only http and https are read")
    with urllib.request.urlopen(url, timeout=seconds) as got:  # noqa: S310
        data = got.read(most + 1)
    if len(data) > most:
        raise FrameError(f"{url} is larger than {most} bytes")
    return parse(spark, data.decode("utf-8", "replace"))[at]


def explode_tables(pages: DataFrame, html: str = "html", *keep: str) -> DataFrame:
    """keep, table, row, column and cell of every cell of every table in a column of pages: a map
    over Arrow batches, for any number of pages."""
    kept = pages.select(*keep, html)
    schema = T.StructType(
        [*[kept.schema[k] for k in keep], T.StructField("table", T.IntegerType()), T.StructField("row", T.IntegerType()),
         T.StructField("column", T.StringType()), T.StructField("cell", T.StringType())]
    )

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = [
                (*key, t, r, c, v)
                for *key, text in zip(*batch.columns, strict=True)
                for t, (names, rows) in enumerate(tables_of(text.as_py()))
                for r, row in enumerate(rows)
                for c, v in zip(names, row, strict=True)
            ]
            columns = list(zip(*out, strict=True)) or [()] * len(schema)
            kinds = [*[batch.schema.field(k).type for k in keep], pa.int32(), pa.int32(), pa.string(), pa.string()]
            arrays = [pa.array([x.as_py() if isinstance(x, pa.Scalar) else x for x in c], k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return kept.where(F.col(html).isNotNull()).mapInArrow(run, schema)
