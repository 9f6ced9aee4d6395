"""Logical types: how each is stored, and which Spark type carries it."""

from __future__ import annotations

import sys
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import types as T

INTERVAL = T.StructType([T.StructField(c, T.LongType()) for c in ("months", "days", "milliseconds")])


@dataclass(frozen=True)
class Logical:
    """physical: type in the file. stored: Spark type of the physical value. spark: type in a DataFrame.

    low and high bound the integers that are accepted; None is no bound.
    """

    physical: str
    stored: T.DataType
    spark: T.DataType
    low: int | None = None
    high: int | None = None


_INT, _LONG, _BYTES, _TEXT = T.IntegerType(), T.LongType(), T.BinaryType(), T.StringType()

# The type names, what they are stored as, and their bounds.
TYPES: dict[str, Logical] = {
    "BOOLEAN": Logical("BOOLEAN", T.BooleanType(), T.BooleanType()),
    "INT32": Logical("INT32", _INT, _INT, -(2**31), 2**31 - 1),
    "INT64": Logical("INT64", _LONG, _LONG, -(2**63), 2**63 - 1),
    "INT96": Logical("INT96", _LONG, _LONG, -(2**63), 2**63 - 1),
    "FLOAT": Logical("FLOAT", T.FloatType(), T.FloatType()),
    "DOUBLE": Logical("DOUBLE", T.DoubleType(), T.DoubleType()),
    "BYTE_ARRAY": Logical("BYTE_ARRAY", _BYTES, _BYTES),
    "FIXED_LEN_BYTE_ARRAY": Logical("FIXED_LEN_BYTE_ARRAY", _BYTES, _BYTES),
    "UTF8": Logical("BYTE_ARRAY", _BYTES, _TEXT),
    "TIME_MILLIS": Logical("INT32", _INT, _INT, 0, 2**31 - 1),
    "TIME_MICROS": Logical("INT64", _LONG, _LONG, 0, 2**63 - 1),
    "DATE": Logical("INT32", _INT, T.DateType(), 0, 2**31 - 1),
    "TIMESTAMP_MILLIS": Logical("INT64", _LONG, T.TimestampType(), 0, 2**63 - 1),
    "TIMESTAMP_MICROS": Logical("INT64", _LONG, T.TimestampType(), 0, 2**63 - 1),
    "UINT_8": Logical("INT32", _INT, T.ShortType(), 0, 2**8 - 1),
    "UINT_16": Logical("INT32", _INT, _INT, 0, 2**16 - 1),
    "UINT_32": Logical("INT32", _LONG, _LONG, 0, 2**32 - 1),
    "UINT_64": Logical("INT64", T.DecimalType(20, 0), T.DecimalType(20, 0), 0, 2**64 - 1),
    "INT_8": Logical("INT32", _INT, T.ByteType(), -(2**7), 2**7 - 1),
    "INT_16": Logical("INT32", _INT, T.ShortType(), -(2**15), 2**15 - 1),
    "INT_32": Logical("INT32", _INT, _INT, -(2**31), 2**31 - 1),
    "INT_64": Logical("INT64", _LONG, _LONG, -(2**63), 2**63 - 1),
    "JSON": Logical("BYTE_ARRAY", _BYTES, _TEXT),
    "BSON": Logical("BYTE_ARRAY", _BYTES, _BYTES),
    "INTERVAL": Logical("FIXED_LEN_BYTE_ARRAY", _BYTES, INTERVAL),
}
ENCODINGS = ("PLAIN", "RLE")
COMPRESSIONS = ("UNCOMPRESSED", "GZIP", "SNAPPY", "LZO", "BROTLI")


def logical(kind: str) -> Logical:
    if kind not in TYPES:
        raise ValueError(f"invalid type: {kind}")
    return TYPES[kind]


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package
