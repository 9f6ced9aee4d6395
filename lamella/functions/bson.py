"""BSON documents as JSON text and back (the binary format of bsonspec.org), in Arrow batches.

JSON types map to double, string, document, array, boolean, null, int32 and int64. Other BSON types that are read become
JSON as follows: binary as hex text, object id as hex text, datetime as milliseconds, timestamp as an integer.
"""

from __future__ import annotations

import json
import struct
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The type bytes of the format.
DOUBLE, STRING, DOCUMENT, ARRAY, BINARY = 0x01, 0x02, 0x03, 0x04, 0x05
OBJECT_ID, BOOLEAN, DATETIME, NULL = 0x07, 0x08, 0x09, 0x0A
INT32, TIMESTAMP, INT64 = 0x10, 0x11, 0x12


def _element(name: str, value) -> bytes:
    key = name.encode()
    if b"\0" in key:
        raise ValueError("a BSON name cannot hold a zero byte")
    if value is None:
        kind, body = NULL, b""
    elif isinstance(value, bool):
        kind, body = BOOLEAN, bytes([value])
    elif isinstance(value, int):
        if -(2**31) <= value < 2**31:
            kind, body = INT32, struct.pack("<i", value)
        else:
            kind, body = INT64, struct.pack("<q", value)
    elif isinstance(value, float):
        kind, body = DOUBLE, struct.pack("<d", value)
    elif isinstance(value, str):
        text = value.encode() + b"\0"
        kind, body = STRING, struct.pack("<i", len(text)) + text
    elif isinstance(value, (bytes, bytearray)):
        kind, body = BINARY, struct.pack("<iB", len(value), 0) + bytes(value)
    elif isinstance(value, dict):
        kind, body = DOCUMENT, dumps(value)
    elif isinstance(value, (list, tuple)):
        kind, body = ARRAY, dumps({str(i): v for i, v in enumerate(value)})
    else:
        raise ValueError(f"no BSON type for {type(value).__name__}")
    return bytes([kind]) + key + b"\0" + body


def dumps(document: dict) -> bytes:
    if not isinstance(document, dict):
        raise ValueError("a BSON document is an object")
    body = b"".join(_element(k, v) for k, v in document.items())
    return struct.pack("<i", len(body) + 5) + body + b"\0"


def _value(kind: int, data: bytes, at: int):
    if kind == DOUBLE:
        return struct.unpack_from("<d", data, at)[0], at + 8
    if kind == STRING:
        size = struct.unpack_from("<i", data, at)[0]
        return data[at + 4 : at + 3 + size].decode(), at + 4 + size
    if kind in (DOCUMENT, ARRAY):
        size = struct.unpack_from("<i", data, at)[0]
        inner = loads(data[at : at + size])
        return (inner if kind == DOCUMENT else list(inner.values())), at + size
    if kind == BINARY:
        size = struct.unpack_from("<i", data, at)[0]
        return data[at + 5 : at + 5 + size].hex(), at + 5 + size
    if kind == OBJECT_ID:
        return data[at : at + 12].hex(), at + 12
    if kind == BOOLEAN:
        return data[at] != 0, at + 1
    if kind == NULL:
        return None, at
    if kind == INT32:
        return struct.unpack_from("<i", data, at)[0], at + 4
    if kind in (DATETIME, INT64):
        return struct.unpack_from("<q", data, at)[0], at + 8
    if kind == TIMESTAMP:
        return struct.unpack_from("<Q", data, at)[0], at + 8
    raise ValueError(f"BSON type 0x{kind:02x} is not supported")


def loads(data: bytes) -> dict:
    size = struct.unpack_from("<i", data)[0]
    if size != len(data) or data[-1] != 0:
        raise ValueError("not a BSON document")
    out, at = {}, 4
    while data[at]:
        end = data.index(b"\0", at + 1)
        out[data[at + 1 : end].decode()], at = _value(data[at], data, end + 1)
    return out


@F.pandas_udf(T.BinaryType())
def _encode(texts: pd.Series) -> pd.Series:
    def one(text):
        try:
            return None if text is None else dumps(json.loads(text))
        except ValueError:
            return None

    return texts.map(one)


@F.pandas_udf(T.StringType())
def _decode(documents: pd.Series) -> pd.Series:
    return documents.map(lambda d: None if d is None else json.dumps(loads(bytes(d)), separators=(",", ":"), ensure_ascii=False))


def from_json(text: Column) -> Column:
    """BSON of JSON text; NULL where the text is not a JSON object."""
    return _encode(text)


def to_json(document: Column) -> Column:
    return _decode(document)


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package
