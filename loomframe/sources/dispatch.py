"""read(path) and write(frame, path) by extension."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from loomframe.frame import Frame
from loomframe.functions.values import FrameError
from loomframe.sources import excel, files, html, jsons, pickled, render


def extension(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower()


READERS: dict[str, Callable] = {
    "csv": files.read_csv,
    "tsv": files.read_tsv,
    "json": jsons.read_json,
    "xls": excel.read_excel,
    "xlsx": excel.read_excel,
    "html": html.read_html,
    "htm": html.read_html,
    "xml": files.read_xml,
    "parquet": files.read_parquet,
    "orc": files.read_orc,
    "jpk": pickled.read_pickle,
}
WRITERS: dict[str, Callable] = {
    "csv": files.write_csv,
    "tsv": files.write_tsv,
    "json": jsons.write_json,
    "xlsx": excel.write_excel,
    "html": render.write_html,
    "htm": render.write_html,
    "xml": files.write_xml,
    "parquet": files.write_parquet,
    "orc": files.write_orc,
    "jpk": pickled.write_pickle,
    "tex": render.write_latex,
    "md": render.write_markdown,
}


def read(spark: SparkSession, path: str, **options) -> Frame:
    kind = extension(path)
    if kind not in READERS:
        raise FrameError(f"no reader for .{kind}; there are {sorted(READERS)}")
    return READERS[kind](spark, path, **options)


def write(frame: Frame, path: str, **options) -> None:
    kind = extension(path)
    if kind not in WRITERS:
        raise FrameError(f"no writer for .{kind}; there are {sorted(WRITERS)}")
    WRITERS[kind](frame, path, **options)
