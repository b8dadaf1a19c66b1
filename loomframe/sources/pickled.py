"""A checked container of one frame: a magic, the payload's length, JSON, and its CRC-32. Reading it
runs no code."""

from __future__ import annotations

import json
import struct
import zlib

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from loomframe.frame import Frame
from loomframe.functions.values import FrameError
from loomframe.sources.jsons import to_json_string
from loomframe.sources.paths import read_bytes, write_bytes

# Fixed value: the first bytes of a container.
MAGIC = b"JPK2"


def write_pickle(frame: Frame, path: str) -> None:
    body = {"schema": json.loads(frame.df.schema.json()), "order_by": frame.order_by, "data": json.loads(to_json_string(frame, "values"))}
    payload = json.dumps(body, ensure_ascii=False).encode()
    write_bytes(frame.spark, path, MAGIC + struct.pack(">I", len(payload)) + payload + struct.pack(">I", zlib.crc32(payload)))


def read_pickle(spark: SparkSession, path: str) -> Frame:
    data = read_bytes(spark, path)
    if data[:4] != MAGIC or len(data) < 12:
        raise FrameError(f"{path} is no container")
    (size,) = struct.unpack(">I", data[4:8])
    payload, check = data[8 : 8 + size], data[8 + size : 12 + size]
    if len(payload) != size or len(check) != 4 or struct.unpack(">I", check)[0] != zlib.crc32(payload):
        raise FrameError(f"{path} is damaged")
    body = json.loads(payload)
    schema = T.StructType.fromJson(body["schema"])
    texts = spark.createDataFrame([(json.dumps(dict(zip(schema.names, r, strict=True))),) for r in body["data"]], "v string")
    from pyspark.sql import functions as F

    return Frame(texts.select(F.from_json("v", schema).alias("r")).select("r.*"), body["order_by"])
