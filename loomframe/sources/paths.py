"""Small files of one name, through Spark's file systems so that any of its paths will do."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

PIECE = 1 << 20


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def read_bytes(spark: SparkSession, path: str) -> bytes:
    row = spark.read.format("binaryFile").load(path).select("content").first()
    if row is None:
        raise FileNotFoundError(path)
    return bytes(row[0])


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Parents are made; a file of the name is replaced."""
    write_pieces(spark, path, [data])


def write_pieces(spark: SparkSession, path: str, pieces: Iterable[bytes]) -> None:
    """As write_bytes, of pieces that need not be held together."""
    fs, target = _fs(spark, path)
    if target.getParent() is not None:
        fs.mkdirs(target.getParent())
    out, held = fs.create(target, True), bytearray()
    try:
        for piece in pieces:
            held += piece
            if len(held) >= PIECE:
                _put(out, held)
                held = bytearray()
        _put(out, held)
    finally:
        out.close()


def _put(out, data: bytearray) -> None:
    for i in range(0, len(data), PIECE):
        out.write(data[i : i + PIECE])


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target)
