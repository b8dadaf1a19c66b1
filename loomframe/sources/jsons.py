"""JSON in five layouts (records, columns, values, index, split), and flattening."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.frame import Frame
from loomframe.functions.values import FrameError, col, is_float
from loomframe.operators import ordered
from loomframe.sources.paths import write_bytes

ORIENTS = ("records", "columns", "values", "index", "split")


def _parsed(spark: SparkSession, texts: DataFrame, name: str) -> DataFrame:
    """texts with the column of that name read as JSON, its schema inferred from all of them."""
    schema = spark.read.json(texts.select(col(name)).where(col(name).isNotNull()).rdd.map(lambda r: r[0])).schema
    return texts.withColumn(name, F.from_json(col(name), schema))


def read_json(spark: SparkSession, path: str, orient: str = "records", lines: bool = False, schema=None) -> Frame:
    """Records are Spark's own source: one object a line (lines, which splits) or an array. The other
    layouts are one document, which is one row until it is taken apart."""
    if orient not in ORIENTS:
        raise FrameError(f"unknown orient {orient!r}; there are {list(ORIENTS)}")
    if orient == "records":
        reader = spark.read.option("multiLine", not lines)
        df = (reader.schema(schema) if schema is not None else reader).json(path)
        arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
        if not lines and len(arrays) == len(df.columns) > 0 and df.limit(2).count() == 1:
            return Frame(_columns(df), "__pos__")  # an object of arrays
        return Frame(df)
    if orient == "columns":
        return Frame(_columns(spark.read.option("multiLine", True).json(path)), "__pos__")
    text = spark.read.option("wholetext", True).text(path)
    if orient == "values":
        rows = text.select(F.posexplode(F.from_json("value", "array<array<string>>")).alias("__pos__", "r"))
        width = rows.agg(F.max(F.size("r"))).first()[0] or 0
        cells = [F.get("r", F.lit(i)).alias(str(i)) for i in range(width)]
        return Frame(rows.select(*cells, "__pos__"), "__pos__").infer_objects()
    if orient == "index":
        rows = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("index", "r"))
        parsed = _parsed(spark, rows, "r").select("index", "r.*")
        numbers = parsed.agg(F.bool_and(F.col("index").try_cast("bigint").isNotNull())).first()[0]
        parsed = parsed.withColumn("index", F.col("index").cast("bigint")) if numbers else parsed
        return Frame(parsed, "index")
    one = text.select(F.from_json("value", "columns array<string>, index array<string>, data array<array<string>>").alias("d")).select("d.*")
    names = one.first()["columns"]
    rows = one.select(F.posexplode("data").alias("__pos__", "r"))
    if (rows.agg(F.max(F.size("r"))).first()[0] or 0) > len(names):
        raise FrameError("a row is wider than its columns")
    return Frame(rows.select(*[F.get("r", F.lit(i)).alias(n) for i, n in enumerate(names)], "__pos__"), "__pos__").infer_objects()


def _columns(df: DataFrame) -> DataFrame:
    names = df.columns
    zipped = F.arrays_zip(*[col(n).alias(f"c{i}") for i, n in enumerate(names)])
    rows = df.select(F.posexplode(zipped).alias("__pos__", "r"))
    return rows.select(*[F.col("r")[f"c{i}"].alias(n) for i, n in enumerate(names)], "__pos__")


def _finite(frame: Frame) -> DataFrame:
    """NaN and the infinities as missing."""
    odd = {f.name: F.when(~F.isnan(col(f.name)) & (F.abs(col(f.name)) != float("inf")), col(f.name)) for f in frame.df.schema.fields if is_float(f.dataType)}
    return frame.df.withColumns(odd) if odd else frame.df


def write_json(frame: Frame, path: str, orient: str = "records", mode: str = "overwrite", index: str | None = None) -> None:
    """Records are written as one object a line, in parallel; other layouts are one document that
    the driver puts together, and so for results of a size to be looked at."""
    if orient == "records":
        _finite(frame).write.mode(mode).option("ignoreNullFields", False).json(path)
    else:
        write_bytes(frame.spark, path, to_json_string(frame, orient, index).encode())


def to_json_string(frame: Frame, orient: str = "records", index: str | None = None) -> str:
    if orient not in ORIENTS:
        raise FrameError(f"unknown orient {orient!r}; there are {list(ORIENTS)}")
    df = _finite(frame)
    names = [c for c in df.columns if c != index]
    rows = df.orderBy(*ordered.order_columns(frame.order_by)) if frame.order_by else df
    records = [json.loads(r[0]) for r in rows.select(F.to_json(F.struct(*map(col, df.columns)), {"ignoreNullFields": "false"})).toLocalIterator()]
    labels = [r.get(index) for r in records] if index else list(range(len(records)))
    cells = [[r[n] for n in names] for r in records]
    made = {
        "records": lambda: [dict(zip(names, c, strict=True)) for c in cells],
        "columns": lambda: {n: [c[i] for c in cells] for i, n in enumerate(names)},
        "values": lambda: cells,
        "index": lambda: {str(k): dict(zip(names, c, strict=True)) for k, c in zip(labels, cells, strict=True)},
        "split": lambda: {"columns": names, "index": labels, "data": cells},
    }
    return json.dumps(made[orient](), ensure_ascii=False)


def flattened(df: DataFrame, separator: str = ".") -> DataFrame:
    """Structs to columns a.b, arrays of structs to columns a.0.b up to the longest array (one pass
    finds it); arrays of plain values stay."""
    while True:
        lists = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
        structs = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StructType)]
        if not lists and not structs:
            return df
        longest = df.agg(*[F.max(F.size(col(n))).alias(str(i)) for i, n in enumerate(lists)]).first() if lists else []
        out: list[Column] = []
        for f in df.schema.fields:
            if f.name in structs:
                out += [col(f.name)[s.name].alias(f"{f.name}{separator}{s.name}") for s in f.dataType.fields]
            elif f.name in lists:
                for i in range(longest[lists.index(f.name)] or 0):
                    out += [F.get(col(f.name), F.lit(i))[s.name].alias(f"{f.name}{separator}{i}{separator}{s.name}") for s in f.dataType.elementType.fields]
            else:
                out.append(col(f.name))
        df = df.select(*out)


def json_normalize(source: DataFrame, name: str, path: str = "", schema: str | T.StructType | None = None) -> Frame:
    """A column of JSON texts (or structs), walked down path, an array there giving a row for each
    element, and flattened."""
    spark = source.sparkSession
    rows = source.select(col(name).alias("v"))
    if isinstance(rows.schema["v"].dataType, T.StringType):
        rows = rows.select(F.from_json("v", schema).alias("v")) if schema is not None else _parsed(spark, rows, "v")
    for part in [p for p in path.split(".") if p]:
        rows = rows.select(F.col("v")[part].alias("v"))
        if isinstance(rows.schema["v"].dataType, T.ArrayType):
            rows = rows.select(F.explode("v").alias("v"))
    if isinstance(rows.schema["v"].dataType, T.ArrayType):
        rows = rows.select(F.explode("v").alias("v"))
    if isinstance(rows.schema["v"].dataType, T.StructType):
        rows = rows.select("v.*")
    return Frame(flattened(rows))


def normalize_text(spark: SparkSession, text: str, path: str = "") -> Frame:
    whole = json.loads(text)
    records = whole if isinstance(whole, list) else [whole]
    return json_normalize(spark.createDataFrame([(json.dumps(r),) for r in records], "v string"), "v", path)
