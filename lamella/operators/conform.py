"""Records checked against a schema, and brought to its shape.

NULL, a missing column and an empty array are one state: no value. A value for a repeated field is taken as an array of
one, and an array of one as the value of a field that is not repeated. Columns that the schema lacks are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.functions.convert import STRICT, to_logical
from lamella.operators.schema import REPEATED, REQUIRED, Field, Schema


def _raise(text: str, kind: T.DataType) -> Column:
    return F.raise_error(F.lit(text)).cast(kind)


def _name(field: Field) -> str:
    return ".".join(field.path)


def _single(field: Field, value: Column, source: T.DataType, mode: str) -> Column:
    """One value of a field, never NULL before; a group's fields are conformed in turn."""
    if not field.is_group:
        return to_logical(field.type, value, source, field.type_length, mode)
    if not isinstance(source, T.StructType):
        raise TypeError(f"{_name(field)} is a group; its column is {source.simpleString()}")
    known = {f.name: f.dataType for f in source.fields}
    inner = [
        _field(c, value[c.name] if c.name in known else None, known.get(c.name), mode).alias(c.name) for c in field.children
    ]
    return F.when(value.isNotNull(), F.struct(*inner))


def _field(field: Field, value: Column | None, source: T.DataType | None, mode: str) -> Column:
    kind = field.spark().dataType
    missing = F.lit(None).cast(kind)
    if field.repetition == REQUIRED and mode == STRICT:
        missing = _raise(f"missing required field: {_name(field)}", kind)
    if value is None or isinstance(source, T.NullType):
        return missing
    listed = isinstance(source, T.ArrayType)
    if field.repetition == REPEATED:
        items = value if listed else F.array(value)
        inner = source.elementType if listed else source
        found = F.transform(items, lambda x: _element(field, x, inner, mode))
        if not listed or source.containsNull:
            return F.when(value.isNotNull() & (F.size(items) > 0), found)
        return F.when(F.size(items) > 0, found)
    if listed:
        inner = source.elementType
        many = _raise(f"too many values for field: {_name(field)}", kind) if mode == STRICT else F.lit(None).cast(kind)
        first = F.get(value, F.lit(0))
        one = _single(field, first, inner, mode)
        return F.when(F.size(value) > 1, many).when(first.isNotNull(), one).otherwise(missing)
    one = _single(field, value, source, mode)
    if field.repetition == REQUIRED and mode == STRICT:
        return F.when(value.isNotNull(), one).otherwise(missing)
    return one


def _element(field: Field, value: Column, source: T.DataType, mode: str) -> Column:
    one = _single(field, value, source, mode)
    if mode != STRICT:
        return one
    return F.when(value.isNotNull(), one).otherwise(_raise(f"null element in field: {_name(field)}", field.element()))


def conform(df: DataFrame, schema: Schema, mode: str = STRICT, keep: tuple[str, ...] = ()) -> DataFrame:
    """df as records of the schema, and the columns to keep beside them.

    In the strict mode a record that breaks the schema raises an error: a missing required field of a parent that is
    there, several values for a field that is not repeated, a NULL inside an array, a value that a type refuses. In the
    permissive mode those become NULL.
    """
    known = {f.name: f.dataType for f in df.schema.fields}
    return df.select(
        *[F.col(f"`{c}`") for c in keep],
        *[
            _field(f, F.col(f"`{f.name}`") if f.name in known else None, known.get(f.name), mode).alias(f.name, metadata=f.spark().metadata)
            for f in schema.roots
        ],
    )


def canonical(df: DataFrame, schema: Schema, keep: tuple[str, ...] = ()) -> DataFrame:
    """df, which has the schema's shape, with NULL in place of empty arrays at any depth."""

    def plain(field: Field, value: Column) -> Column:
        if field.repetition == REPEATED:
            items = F.transform(value, lambda x: inside(field, x)) if field.is_group else value
            return F.when(F.size(value) > 0, items)
        return inside(field, value)

    def inside(field: Field, value: Column) -> Column:
        if not field.is_group:
            return value
        return F.when(value.isNotNull(), F.struct(*[plain(c, value[c.name]).alias(c.name) for c in field.children]))

    return df.select(*[F.col(f"`{c}`") for c in keep], *[plain(f, F.col(f"`{f.name}`")).alias(f.name) for f in schema.roots])
