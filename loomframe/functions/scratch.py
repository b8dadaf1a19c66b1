"""Scratch tables on storage that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.functions.values import FrameError

_written: list[tuple[SparkSession, str]] = []


def one_process(spark: SparkSession) -> bool:
    """Whether all of Spark runs in this process, as in tests."""
    return bool(re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master))


def root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a temporary one if all of Spark
    runs in this process, as in tests; on a cluster that raises, as executors share no disk."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not one_process(spark):
            raise FrameError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="loomframe-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the root, deleted by release() and at the end of the Python process."""
    path = f"{root(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet and read back: lineage ends there, and what is read stays the same. Columns
    go by place, so that any names will do, and those that hold nothing are made again."""
    path = scratch(df.sparkSession, label)
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    empty = {f.name for f in plain.schema.fields if isinstance(f.dataType, T.NullType)}
    plain = plain.drop(*empty)
    plain.write.parquet(path)
    back = df.sparkSession.read.schema(plain.schema).parquet(path)
    return back.select(*[
        (F.lit(None) if f"c{i}" in empty else F.col(f"c{i}")).alias(f.name, metadata=f.metadata) for i, f in enumerate(df.schema.fields)
    ])


def release() -> None:
    """Delete what was written so far. Frames built on it are of no use afterwards."""
    while _written:
        spark, path = _written.pop()
        if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
            continue
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Py4JError:  # the folder is gone, or the JVM is: go on with the others
            continue


atexit.register(release)
