"""Conversions between values and what a file stores, as Spark columns.

In the strict mode a value that a type refuses raises an error when the row is read; in the permissive mode it becomes
NULL, and conversion_error() says what was wrong. NULL stays NULL in either.

Integers are read leniently: a string counts up to its last leading digit, fractions are cut off. Strings for FLOAT and
DOUBLE count up to the end of the leading number. A string for JSON or BSON is JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.functions import bson
from lamella.functions.logical import INTERVAL, logical

STRICT, PERMISSIVE = "strict", "permissive"
_WIDE = "decimal(38,0)"
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_U32 = 2**32 - 1
_FLOAT = r"^\s*([+-]?(?:Infinity|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?))"


def bit_width(value: Column) -> Column:
    """Bits that a non-negative integer needs: 0 for 0."""
    return F.when(value == 0, 0).otherwise(F.length(F.bin(value))).cast("int")


def whole_number(value: Column, source: T.DataType) -> Column:
    """The integer that a value starts with, as a wide decimal; NULL if there is none."""
    if isinstance(source, T.StringType):
        return F.regexp_extract(value, r"^\s*([+-]?[0-9]+)", 1).try_cast(_WIDE)
    if isinstance(source, (*_INTEGERS, T.DecimalType)):
        scale = getattr(source, "scale", 0)
        return (F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value)) if scale else value).cast(_WIDE)
    if isinstance(source, (T.FloatType, T.DoubleType)):
        cut = F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value))
        whole = F.when(F.abs(value) < 2**53, cut.cast(_WIDE)).otherwise(value.cast("double").try_cast(_WIDE))
        return F.when(~F.isnan(value), whole)
    return F.lit(None).cast(_WIDE)


def _number(value: Column, source: T.DataType) -> Column:
    if isinstance(source, T.StringType):
        found = F.regexp_extract(value, _FLOAT, 1).try_cast("double")
    elif isinstance(source, (*_INTEGERS, T.DecimalType, T.FloatType, T.DoubleType)):
        found = value.cast("double")
    else:
        return F.lit(None).cast("double")
    return F.when(~F.isnan(found), found)


def truth(value: Column, source: T.DataType) -> Column:
    """Zero, NaN and the empty string are false; every other value is true."""
    if isinstance(source, T.BooleanType):
        return value
    if isinstance(source, T.StringType):
        return value != ""
    if isinstance(source, (T.FloatType, T.DoubleType)):
        return (value != 0) & ~F.isnan(value)
    if isinstance(source, (*_INTEGERS, T.DecimalType)):
        return value != 0
    return F.when(value.isNotNull(), F.lit(True))


def _octets(value: Column, source: T.DataType) -> Column:
    return value.cast("binary") if isinstance(source, (T.StringType, T.BinaryType)) else F.lit(None).cast("binary")


def _json(value: Column, source: T.DataType) -> Column:
    if isinstance(source, (T.StructType, T.MapType, T.ArrayType, T.VariantType)):
        return F.to_json(value)
    return F.when(F.try_parse_json(value).isNotNull(), value) if isinstance(source, T.StringType) else F.lit(None).cast("string")


def _little_endian(value: Column) -> Column:
    digits = F.lpad(F.hex(value.cast("long")), 8, "0")
    return F.concat(*[F.substring(digits, i, 2) for i in (7, 5, 3, 1)])


def pack_interval(value: Column) -> Column:
    """A struct of months, days and milliseconds as 12 bytes: three unsigned little-endian numbers; NULL if any is out
    of range."""
    parts = [value[c] for c in INTERVAL.names]
    fine = F.lit(True)
    for part in parts:
        fine = fine & part.between(0, _U32)
    return F.when(F.coalesce(fine, F.lit(False)), F.unhex(F.concat(*map(_little_endian, parts))))


def unpack_interval(value: Column) -> Column:
    digits = F.hex(value)
    swapped = [F.concat(*[F.substring(digits, 8 * k + i, 2) for i in (7, 5, 3, 1)]) for k in range(3)]
    parts = [F.conv(s, 16, 10).cast("long").alias(c) for s, c in zip(swapped, INTERVAL.names, strict=True)]
    return F.when(value.isNotNull(), F.struct(*parts))


def _moment(value: Column, source: T.DataType, kind: str) -> Column | None:
    if not isinstance(source, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return None
    if kind == "DATE":
        return F.unix_date(F.to_date(value))
    at = value.cast("timestamp")
    return F.unix_millis(at) if kind == "TIMESTAMP_MILLIS" else F.unix_micros(at)


def _stored(kind: str, value: Column, source: T.DataType, type_length: int | None) -> Column:
    """The physical value; NULL also where a value is refused."""
    of = logical(kind)
    if kind == "BOOLEAN":
        return truth(value, source)
    if kind in ("FLOAT", "DOUBLE"):
        return _number(value, source).cast(of.stored)
    if kind in ("BYTE_ARRAY", "UTF8"):
        return _octets(value, source)
    if kind == "FIXED_LEN_BYTE_ARRAY":
        octets = _octets(value, source)
        return octets if type_length is None else F.when(F.octet_length(octets) == type_length, octets)
    if kind == "JSON":
        return _json(value, source).cast("binary")
    if kind == "BSON":
        return value if isinstance(source, T.BinaryType) else bson.from_json(_json(value, source))
    if kind == "INTERVAL":
        named = isinstance(source, T.StructType) and set(INTERVAL.names) <= set(source.names)
        return pack_interval(value) if named else F.lit(None).cast("binary")
    moment = _moment(value, source, kind) if kind.startswith(("DATE", "TIMESTAMP")) else None
    if moment is not None:
        return moment.cast(of.stored)
    whole = whole_number(value, source)
    low, high = (F.lit(str(b)).cast(_WIDE) for b in (of.low, of.high))
    return F.when(whole.between(low, high), whole.cast(of.stored))


def _refused(kind: str, value: Column, source: T.DataType) -> Column:
    shown = F.to_json(F.struct(value.alias("value"))) if isinstance(source, (T.StructType, T.ArrayType, T.MapType)) else value.cast("string")
    if isinstance(source, T.BinaryType):
        shown = F.hex(value)
    return F.concat(F.lit(f"invalid value for {kind}: "), F.coalesce(shown, F.lit("?")))


def to_primitive(kind: str, value: Column, source: T.DataType, type_length: int | None = None, mode: str = STRICT) -> Column:
    """The value that a file stores for a value of a logical type, which is a column of the Spark type source."""
    found = _stored(kind, value, source, type_length)
    if mode == PERMISSIVE:
        return found
    return F.when(value.isNull() | found.isNotNull(), found).otherwise(F.raise_error(_refused(kind, value, source)))


def conversion_error(kind: str, value: Column, source: T.DataType, type_length: int | None = None) -> Column:
    """What to_primitive() would raise; NULL if the value is fine."""
    found = _stored(kind, value, source, type_length)
    return F.when(value.isNotNull() & found.isNull(), _refused(kind, value, source))


def from_primitive(kind: str, stored: Column) -> Column:
    """The value of a logical type from what a file stores."""
    of = logical(kind)
    if kind in ("UTF8", "JSON"):
        return F.decode(stored, "UTF-8")
    if kind == "DATE":
        return F.date_from_unix_date(stored)
    if kind == "TIMESTAMP_MILLIS":
        return F.timestamp_millis(stored)
    if kind == "TIMESTAMP_MICROS":
        return F.timestamp_micros(stored)
    if kind == "INTERVAL":
        return unpack_interval(stored)
    return stored.cast(of.spark)


def to_logical(kind: str, value: Column, source: T.DataType, type_length: int | None = None, mode: str = STRICT) -> Column:
    """A value as the Spark type of its logical type, checked. Types that need no check pass as they are."""
    of = logical(kind)
    free = kind in ("BOOLEAN", "UTF8", "BYTE_ARRAY", "BSON", "DATE", "TIMESTAMP_MICROS")
    full = kind in ("INT32", "INT64", "INT96", "INT_8", "INT_16", "INT_32", "INT_64")
    if source == of.spark and (free or full or kind == "FIXED_LEN_BYTE_ARRAY" and type_length is None):
        return value
    return from_primitive(kind, to_primitive(kind, value, source, type_length, mode))
