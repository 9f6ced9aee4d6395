"""Declared schemas of strictly typed, nested records, and the levels that follow from them."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lamella.functions.logical import COMPRESSIONS, ENCODINGS, INTERVAL, logical

REQUIRED, OPTIONAL, REPEATED = "REQUIRED", "OPTIONAL", "REPEATED"
#: Key under which a field's declaration stands in the metadata of its Spark field.
METADATA_KEY = "lamella"
#: Key under which the metadata of a whole table stands in the metadata of its first field.
TABLE_KEY = "lamella.table"


@dataclass(frozen=True)
class Field:
    """A leaf (type is set) or a group (children are). r_max and d_max count repeated, and optional or repeated, fields
    of the path, this one included."""

    name: str
    path: tuple[str, ...]
    repetition: str
    r_max: int
    d_max: int
    type: str | None = None
    type_length: int | None = None
    encoding: str | None = None
    compression: str | None = None
    children: tuple[Field, ...] = ()

    @property
    def is_group(self) -> bool:
        return self.type is None

    @property
    def child_count(self) -> int:
        return len(self.children)

    def walk(self) -> Iterator[Field]:
        yield self
        for child in self.children:
            yield from child.walk()

    def element(self) -> T.DataType:
        """The Spark type of one value."""
        if not self.is_group:
            return logical(self.type).spark
        return T.StructType([c.spark() for c in self.children])

    def spark(self) -> T.StructField:
        kind = self.element()
        if self.repetition == REPEATED:
            kind = T.ArrayType(kind, containsNull=False)
        return T.StructField(self.name, kind, True, {METADATA_KEY: json.dumps(self.declaration())})

    def declaration(self) -> dict:
        """What declares this field again."""
        out: dict = {}
        if self.repetition == OPTIONAL:
            out["optional"] = True
        if self.repetition == REPEATED:
            out["repeated"] = True
        if self.is_group:
            out["fields"] = {c.name: c.declaration() for c in self.children}
            return out
        out |= {"type": self.type, "encoding": self.encoding, "compression": self.compression}
        if self.type_length is not None:
            out["typeLength"] = self.type_length
        return out


def _one_of(value: str, allowed: Sequence[str], what: str) -> str:
    if value not in allowed:
        raise ValueError(f"unsupported {what}: {value}")
    return value


def _declare(definition: dict, path: tuple[str, ...], r: int, d: int) -> tuple[Field, ...]:
    found = []
    for name, options in definition.items():
        repeated, optional = bool(options.get("repeated")), bool(options.get("optional"))
        own = {
            "name": name,
            "path": (*path, name),
            "repetition": REPEATED if repeated else OPTIONAL if optional else REQUIRED,
            "r_max": r + repeated,
            "d_max": d + (repeated or optional),
        }
        if "fields" in options:
            own["children"] = _declare(options["fields"], own["path"], own["r_max"], own["d_max"])
        else:
            kind = options.get("type")
            logical(kind)
            width = options.get("typeLength", options.get("bitWidth"))
            own |= {
                "type": kind,
                "type_length": 12 if kind == "INTERVAL" else width,
                "encoding": _one_of(options.get("encoding") or "PLAIN", ENCODINGS, "encoding"),
                "compression": _one_of(options.get("compression") or "UNCOMPRESSED", COMPRESSIONS, "compression"),
            }
        found.append(Field(**own))
    return tuple(found)


class Schema:
    """A strict schema, declared once; the definition is not changed.

    A definition maps names to options: ``type`` or ``fields`` (which wins), ``optional``, ``repeated``, ``encoding``,
    ``compression``, ``typeLength`` (``bitWidth`` is taken too).
    """

    def __init__(self, definition: dict):
        self.roots = _declare(definition, (), 0, 0)

    @property
    def fields(self) -> dict[str, Field]:
        return {f.name: f for f in self.roots}

    @property
    def field_list(self) -> list[Field]:
        """All fields, groups included, each before its children."""
        return [f for root in self.roots for f in root.walk()]

    @property
    def leaves(self) -> list[Field]:
        return [f for f in self.field_list if not f.is_group]

    def find_branch(self, path: str | Sequence[str]) -> list[Field]:
        """The field at a path, after its ancestors. A path is a list of names, or they with dots or commas between."""
        if isinstance(path, str):
            path = path.split("," if "," in path else ".")
        branch, level = [], self.fields
        for name in path:
            if name not in level:
                raise KeyError(f"no such field: {'.'.join(path)}")
            branch.append(level[name])
            level = {c.name: c for c in level[name].children}
        return branch

    def find(self, path: str | Sequence[str]) -> Field:
        return self.find_branch(path)[-1]

    def select(self, columns: Sequence[str | Sequence[str]] | None) -> Schema:
        """The schema of a projection: bare names, or paths to leaves or groups, whose parents keep their shape.

        Fields stay in their own order. No columns mean all. An unknown name raises KeyError.
        """
        if not columns:
            return self
        chosen = {self.find([c] if isinstance(c, str) else c).path for c in columns}

        def narrowed(fields: tuple[Field, ...]) -> dict:
            out = {}
            for f in fields:
                if f.path in chosen:
                    out[f.name] = f.declaration()
                elif inner := narrowed(f.children):
                    out[f.name] = f.declaration() | {"fields": inner}
            return out

        return Schema(narrowed(self.roots))

    def spark(self, metadata: dict[str, str] | None = None) -> T.StructType:
        """The Spark schema. Every field is nullable in it: Parquet reads so; conform() holds what is required.

        metadata goes with the first field, and through Parquet.
        """
        fields = [f.spark() for f in self.roots]
        if metadata and fields:
            first = fields[0]
            texts = json.dumps({str(k): str(v) for k, v in metadata.items()})
            fields[0] = T.StructField(first.name, first.dataType, True, first.metadata | {TABLE_KEY: texts})
        return T.StructType(fields)

    def declaration(self) -> dict:
        return {f.name: f.declaration() for f in self.roots}

    def levels(self, spark: SparkSession) -> DataFrame:
        """The fields as rows, in order."""
        rows = [
            (i, ".".join(f.path), f.repetition, f.r_max, f.d_max, f.type, f.type_length, f.encoding, f.compression, f.child_count)
            for i, f in enumerate(self.field_list)
        ]
        columns = "ord int, path string, repetition string, r_max int, d_max int, type string, type_length int, encoding string, compression string, child_count int"
        return spark.createDataFrame(rows, columns)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Schema) and self.roots == other.roots

    def __repr__(self) -> str:
        return f"Schema({self.declaration()!r})"


def declared(schema: T.StructType) -> dict:
    """A definition from a Spark schema: what our own metadata declares, else by type, every field optional."""
    kinds = {
        T.BooleanType: "BOOLEAN", T.ByteType: "INT_8", T.ShortType: "INT_16", T.IntegerType: "INT32", T.LongType: "INT64",
        T.FloatType: "FLOAT", T.DoubleType: "DOUBLE", T.StringType: "UTF8", T.BinaryType: "BYTE_ARRAY", T.DateType: "DATE",
        T.TimestampType: "TIMESTAMP_MICROS", T.TimestampNTZType: "TIMESTAMP_MICROS",
    }
    def options(field: T.StructField, known: dict | None) -> dict:
        if known is None and field.metadata and METADATA_KEY in field.metadata:
            known = json.loads(field.metadata[METADATA_KEY])
        repeated = isinstance(field.dataType, T.ArrayType)
        inner = field.dataType.elementType if repeated else field.dataType
        out = dict(known) if known is not None else {"repeated": True} if repeated else {"optional": True}
        if known is not None and "fields" in known and isinstance(inner, T.StructType):
            out["fields"] = {c.name: options(c, known["fields"].get(c.name)) for c in inner.fields}
        elif known is None:
            if inner == INTERVAL:
                out["type"] = "INTERVAL"
            elif isinstance(inner, T.StructType):
                out["fields"] = declared(inner)
            elif isinstance(inner, T.DecimalType) and inner.scale == 0 and inner.precision <= 20:
                out["type"] = "UINT_64"
            elif type(inner) in kinds:
                out["type"] = kinds[type(inner)]
            else:
                raise ValueError(f"no logical type for {field.name}: {inner.simpleString()}")
        return out

    return {f.name: options(f, None) for f in schema.fields}


def table_metadata(schema: T.StructType) -> dict[str, str]:
    """The metadata that Schema.spark() put into a Spark schema; empty if there is none."""
    for f in schema.fields:
        if f.metadata and TABLE_KEY in f.metadata:
            return json.loads(f.metadata[TABLE_KEY])
    return {}
