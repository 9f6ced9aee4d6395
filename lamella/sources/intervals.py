"""INTERVAL in files: 12 bytes there, a struct of months, days and milliseconds in DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.functions.convert import pack_interval, unpack_interval
from lamella.functions.logical import INTERVAL


def _changed(kind: T.DataType, from_kind: Callable, to: T.DataType) -> T.DataType:
    if from_kind(kind):
        return to
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_changed(kind.elementType, from_kind, to), kind.containsNull)
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _changed(f.dataType, from_kind, to), f.nullable, f.metadata) for f in kind.fields])
    return kind


def _mapped(value: Column, kind: T.DataType, changed: T.DataType, convert: Callable) -> Column:
    if kind == changed:
        return value
    if isinstance(kind, T.ArrayType) and isinstance(changed, T.ArrayType):
        return F.transform(value, lambda x: _mapped(x, kind.elementType, changed.elementType, convert))
    if isinstance(kind, T.StructType) and isinstance(changed, T.StructType):
        inner = [
            _mapped(value[a.name], a.dataType, b.dataType, convert).alias(a.name, metadata=a.metadata)
            for a, b in zip(kind.fields, changed.fields, strict=True)
        ]
        return F.when(value.isNotNull(), F.struct(*inner))
    return convert(value)


def packed(df: DataFrame) -> DataFrame:
    """df with every interval struct as 12 bytes."""
    fields = df.schema.fields
    to = [_changed(f.dataType, lambda k: k == INTERVAL, T.BinaryType()) for f in fields]
    if all(f.dataType == t for f, t in zip(fields, to, strict=True)):
        return df
    return df.select(
        *[_mapped(F.col(f"`{f.name}`"), f.dataType, t, pack_interval).alias(f.name, metadata=f.metadata) for f, t in zip(fields, to, strict=True)]
    )


def stored_type(kind: T.DataType) -> T.DataType:
    """A DataFrame type as files hold it."""
    return _changed(kind, lambda k: k == INTERVAL, T.BinaryType())


def unpacked(df: DataFrame, wanted: T.StructType) -> DataFrame:
    """df, read with stored types, in the types wanted; further columns stay."""
    known = {f.name: f for f in df.schema.fields}
    if all(known[f.name].dataType == f.dataType for f in wanted.fields):
        return df
    columns = [
        _mapped(F.col(f"`{f.name}`"), stored_type(f.dataType), f.dataType, unpack_interval).alias(f.name, metadata=f.metadata)
        for f in wanted.fields
    ]
    return df.select(*columns, *[F.col(f"`{c}`") for c in df.columns if c not in {f.name for f in wanted.fields}])
