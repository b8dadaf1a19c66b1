"""Shared helpers: scratch tables on shared storage, Arrow row mapping, ASCII word rules."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Java pattern of a whitespace-delimited word: only the six ASCII blanks separate.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: Bytes to themselves, but A-Z to a-z and ASCII other than digits and letters to a blank.
ALNUM_TABLE = bytes(
    (c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32) for c in range(256)
)

_written: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where that is unset, a temporary one if all of
    Spark runs in this process, as in tests; on a cluster that raises, as executors share no disk."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="loomframe-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared scratch folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/loomframe-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete every scratch table written so far. Frames built on them are of no use afterwards."""
    while _written:
        spark, path = _written.pop()
        if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
            continue
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Py4JError:  # the folder is gone, or the JVM is: go on with the others
            continue


atexit.register(release)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, mod modulus; null for a null id."""
    return F.crc32(doc_id.cast("string")) % F.lit(modulus)


def unused(names: list[str], stem: str) -> str:
    """A column name that does not clash, whatever the case, with those given."""
    taken, name = {n.lower() for n in names}, stem
    while name.lower() in taken:
        name += "_"
    return name


def quoted(names: list[str]) -> list[Column]:
    """Columns by exact name, whatever characters it holds."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, so that extra columns cannot clash; a missing one is a null."""
    have = {f.name for f in df.schema.fields}
    kinds = {"doc_id": "long", "item_id": "long"}
    return df.select(
        *[df[n].alias(n) if n in have else F.lit(None).cast(kinds.get(n, "string")).alias(n) for n in names]
    )


def map_bytes(
    df: DataFrame, fn: Callable[[dict, list[bytes | None]], dict], schema: T.StructType, text: str = "text"
) -> DataFrame:
    """Arrow-batched map without a shuffle. fn gets the batch's other columns (Arrow) and the texts
    as UTF-8 bytes, and returns the columns of schema by name, as lists or Arrow arrays."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in split_batch(batch, text):
                others = {n: part.column(i) for i, n in enumerate(names) if n != text}
                out = fn(others, texts)
                arrays = [x if isinstance(x := out[f.name], pa.Array) else pa.array(x, f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return plain_names(df, text).mapInArrow(run, schema)


def plain_names(df: DataFrame, text: str) -> DataFrame:
    """Columns but for text by place: mapInArrow takes names with dots for nested fields."""
    return df.toDF(*[n if n == text else f"__c{i}" for i, n in enumerate(df.columns)])


def filter_bytes(df: DataFrame, keep: Callable[[list[bytes | None]], list[bool]], text: str = "text") -> DataFrame:
    """The rows of df, all columns as they are, whose texts keep() marks. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in split_batch(batch, text):
                yield part.filter(pa.array(keep(texts), pa.bool_()))

    plain = plain_names(df, text)
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def split_batch(
    batch: pa.RecordBatch, text: str, most: int = 4 << 20
) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of at most about most text bytes, and their texts; a longer text is a slice of its own."""
    import pyarrow.compute as pc

    raw = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
    sizes = pc.fill_null(pc.binary_length(raw), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(start, i - start), raw.slice(start, i - start).to_pylist()
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start), raw.slice(start).to_pylist()
