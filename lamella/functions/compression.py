"""Compression methods, over binary columns and as options of Spark's Parquet writer."""

from __future__ import annotations

import sys
import zlib

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lamella.functions.logical import COMPRESSIONS

# The brotli quality that is used, and gzip's window with its header.
BROTLI_QUALITY, GZIP_WINDOW = 8, 31
#: Codec class that Spark needs beside its own ones.
_CLASSES = {"LZO": "com.hadoop.compression.lzo.LzoCodec", "BROTLI": "org.apache.hadoop.io.compress.BrotliCodec"}


class CodecUnavailable(ValueError):
    pass


def _known(method: str) -> str:
    if method not in COMPRESSIONS:
        raise ValueError(f"invalid compression method: {method}")
    if method == "LZO":
        raise CodecUnavailable("codec not available: LZO")
    return method


def _codec(method: str) -> pa.Codec:
    return pa.Codec("brotli", compression_level=BROTLI_QUALITY) if method == "BROTLI" else pa.Codec("snappy")


def compress(method: str, data: bytes) -> bytes:
    _known(method)
    if method == "UNCOMPRESSED":
        return bytes(data)
    if method == "GZIP":
        deflater = zlib.compressobj(wbits=GZIP_WINDOW)
        return deflater.compress(data) + deflater.flush()
    return _codec(method).compress(bytes(data), asbytes=True)


def _snappy_size(data: bytes) -> int:
    size = shift = 0
    for byte in data:
        size |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            break
    return size


def decompress(method: str, data: bytes) -> bytes:
    """What compress() was given."""
    _known(method)
    if method == "UNCOMPRESSED":
        return bytes(data)
    if method == "GZIP":
        return zlib.decompress(data, wbits=GZIP_WINDOW)
    if method == "SNAPPY":
        return _codec(method).decompress(bytes(data), _snappy_size(data), asbytes=True)
    return pa.input_stream(pa.py_buffer(data), compression="brotli").read()


def deflate(method: str, data: Column) -> Column:
    """A binary column, compressed; NULL stays."""
    _known(method)

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else compress(method, v))

    return data if method == "UNCOMPRESSED" else run(data)


def inflate(method: str, data: Column) -> Column:
    _known(method)

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else decompress(method, v))

    return data if method == "UNCOMPRESSED" else run(data)


def writer_option(spark: SparkSession, method: str) -> str:
    """The value of the compression option for a method; CodecUnavailable if the session lacks its class."""
    if method not in COMPRESSIONS:
        raise ValueError(f"invalid compression method: {method}")
    if method in _CLASSES:
        try:
            spark._jvm.java.lang.Class.forName(_CLASSES[method])
        except Exception as missing:
            raise CodecUnavailable(f"codec not available: {method}") from missing
    return method.lower()


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package
