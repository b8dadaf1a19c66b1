"""Delimited, fixed-width, XML, Parquet and ORC files, by Spark's own sources.

Writers make a folder of part files, as many as the data have partitions; single=True makes one.
"""

from __future__ import annotations

import csv as csvlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.frame import Frame
from loomframe.functions.values import FrameError, col, kind_of

# Fixed value: what a spreadsheet may take for a formula.
FORMULA = r"^(\s*[=+\-@])"


def unique_names(names: list[str]) -> list[str]:
    """Repeats take _1, _2, ...; empty ones are named by place."""
    seen: dict[str, int] = {}
    out = []
    for i, n in enumerate(names):
        n = n.strip() or f"_{i}"
        k = seen.get(n, -1) + 1
        seen[n] = k
        out.append(f"{n}_{k}" if k else n)
    return out


def read_csv(
    spark: SparkSession, path: str, delimiter: str = ",", header: bool = True, encoding: str = "UTF-8",
    schema: T.StructType | str | None = None, all_string: bool = False, order_by=(), **options,
) -> Frame:
    """Empty cells are missing; long rows are cut and short ones filled. Kinds are inferred in a pass
    of their own unless a schema (which large inputs should have) or all_string is given."""
    reader = spark.read.option("sep", delimiter).option("encoding", encoding).option("nullValue", "").options(**options)
    if schema is not None:
        return Frame(reader.option("header", header).schema(schema).csv(path), order_by)
    first = spark.read.option("encoding", encoding).option("wholetext", False).text(path).limit(1).collect()
    cells = next(csvlib.reader([first[0][0].lstrip("\ufeff")], delimiter=delimiter)) if first and first[0][0] else []
    names = unique_names(cells) if header else [f"_{i}" for i in range(len(cells))]
    if not names:
        return Frame(spark.createDataFrame([], T.StructType()))
    texts = T.StructType([T.StructField(n, T.StringType()) for n in names])
    if all_string:
        return Frame(reader.option("header", header).schema(texts).csv(path), order_by)
    df = reader.option("header", header).option("enforceSchema", True).schema(texts).csv(path)
    return Frame(df, order_by).infer_objects()


def read_tsv(spark: SparkSession, path: str, **options) -> Frame:
    return read_csv(spark, path, delimiter="\t", **options)


read_table = read_tsv


def read_fwf(spark: SparkSession, path: str, widths: list[int], names: list[str] | None = None, header: bool = False, infer: bool = True) -> Frame:
    """Lines cut by widths, trimmed; empty cells are missing."""
    lines = spark.read.text(path)
    starts = [1 + sum(widths[:i]) for i in range(len(widths))]
    if header:
        first = lines.first()[0]
        names = unique_names([first[s - 1 : s - 1 + w] for s, w in zip(starts, widths, strict=True)])
        lines = lines.where(F.col("value") != first)
    names = names or [f"_{i}" for i in range(len(widths))]
    cells = [F.nullif(F.trim(F.substring("value", s, w)), F.lit("")).alias(n) for n, s, w in zip(names, starts, widths, strict=True)]
    out = Frame(lines.select(*cells))
    return out.infer_objects() if infer else out


def read_xml(spark: SparkSession, path: str, row_name: str = "row", schema=None, order_by=()) -> Frame:
    reader = spark.read.option("rowTag", row_name).option("nullValue", "")
    return Frame((reader.schema(schema) if schema is not None else reader).xml(path), order_by)


def read_parquet(spark: SparkSession, path: str, order_by=()) -> Frame:
    return Frame(spark.read.parquet(path), order_by)


def read_orc(spark: SparkSession, path: str, order_by=()) -> Frame:
    return Frame(spark.read.orc(path), order_by)


def _laid(frame: Frame, single: bool) -> DataFrame:
    return frame.df.coalesce(1) if single else frame.df


def _sanitized(df: DataFrame) -> DataFrame:
    """Text that a spreadsheet would run gets a quote in front, in cells and in the header."""
    new = {f.name: F.regexp_replace(col(f.name), FORMULA, "'$1") for f in df.schema.fields if kind_of(f.dataType) == "string"}
    out = df.withColumns(new) if new else df
    return out.toDF(*["'" + n if n.lstrip()[:1] in ("=", "+", "-", "@") else n for n in out.columns])


def write_csv(
    frame: Frame, path: str, delimiter: str = ",", header: bool = True, encoding: str = "UTF-8",
    sanitize_formulas: bool = True, single: bool = False, mode: str = "overwrite",
) -> None:
    df = _laid(frame, single)
    df = _sanitized(df) if sanitize_formulas else df
    df.write.mode(mode).option("sep", delimiter).option("header", header).option("encoding", encoding).option("emptyValue", "").csv(path)


def write_tsv(frame: Frame, path: str, **options) -> None:
    write_csv(frame, path, delimiter="\t", **options)


def write_xml(frame: Frame, path: str, root_name: str = "rows", row_name: str = "row", single: bool = False, mode: str = "overwrite") -> None:
    _laid(frame, single).write.mode(mode).option("rootTag", root_name).option("rowTag", row_name).xml(path)


def write_parquet(frame: Frame, path: str, single: bool = False, mode: str = "overwrite", partition_by=()) -> None:
    _laid(frame, single).write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_orc(frame: Frame, path: str, single: bool = False, mode: str = "overwrite", partition_by=()) -> None:
    _laid(frame, single).write.mode(mode).partitionBy(*partition_by).orc(path)


def write_bucketed(frame: Frame, table: str, buckets: int, *names: str, mode: str = "overwrite") -> None:
    """A table that later joins and groupings on names read without a shuffle."""
    if not names:
        raise FrameError("buckets need a column")
    frame.df.write.mode(mode).bucketBy(buckets, *names).sortBy(*names).saveAsTable(table)


def to_tsv_text(frame: Frame, most_rows: int = 100_000) -> str:
    """For a clipboard: a header and tab-separated cells, missing ones empty."""
    import io

    out = io.StringIO()
    writer = csvlib.writer(out, delimiter="\t", lineterminator="\n")
    writer.writerow(frame.df.columns)
    for row in frame._with(frame.df.limit(most_rows)).iter_rows():
        writer.writerow(["" if v is None else v for v in row])
    return out.getvalue()


def from_tsv_text(spark: SparkSession, text: str) -> Frame:
    rows = list(csvlib.reader(text.splitlines(), delimiter="\t"))
    names = unique_names(rows[0])
    from loomframe.frame import frame

    body = [tuple((r[i] or None) if i < len(r) else None for i in range(len(names))) for r in rows[1:]]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return frame(body, schema=schema, spark=spark).infer_objects(*names)
