"""Reading: schema, metadata, row count, and projected scans in file order."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.operators.records import to_record
from lamella.operators.schema import METADATA_KEY, Schema, declared, table_metadata
from lamella.operators.shared import shared_path
from lamella.sources.footer import SPARK_SCHEMA, Footer, data_files, read_footer, read_footers, row_groups, user_metadata
from lamella.sources.intervals import stored_type, unpacked

Columns = Sequence[str | Sequence[str]] | None


def narrowed(schema: T.StructType, columns: Columns) -> T.StructType:
    """The part of a Spark schema on the paths of columns; parents keep their shape, fields their order.

    A path that ends at a group takes the whole group. KeyError names an unknown path.
    """
    if not columns:
        return schema
    paths = [[c] if isinstance(c, str) else list(c) for c in columns]

    def cut(kind: T.DataType, rest: list[list[str]], of: list[str]) -> T.DataType:
        if any(not r for r in rest):
            return kind
        if isinstance(kind, T.ArrayType):
            return T.ArrayType(cut(kind.elementType, rest, of), kind.containsNull)
        names = {f.name for f in kind.fields} if isinstance(kind, T.StructType) else set()
        for r in rest:
            if r[0] not in names:
                raise KeyError(f"no such field: {'.'.join([*of, *r])}")
        kept = []
        for f in kind.fields:
            if own := [r[1:] for r in rest if r[0] == f.name]:
                kept.append(T.StructField(f.name, cut(f.dataType, own, [*of, f.name]), f.nullable, f.metadata))
        return T.StructType(kept)

    return cut(schema, paths, [])


class Cursor:
    """A scan of chosen columns. frame has the rows for distributed work; the cursor itself walks them in file order."""

    def __init__(self, reader: Reader, columns: Columns):
        self._reader = reader
        self._wanted = narrowed(reader.spark_schema, columns)
        self._rows: Iterator | None = None

    def _scan(self) -> DataFrame:
        stored = T.StructType([T.StructField(f.name, stored_type(f.dataType), f.nullable, f.metadata) for f in self._wanted.fields])
        return self._reader.spark.read.schema(stored).parquet(self._reader.path)

    @property
    def frame(self) -> DataFrame:
        """The rows, in no given order. Only the chosen leaves are read."""
        self._reader.check_open()
        return unpacked(self._scan(), self._wanted)

    def numbered(self, name: str = "row_index") -> DataFrame:
        """The rows with their number in their file; for a single file it is the row's identity."""
        self._reader.check_open()
        return unpacked(self._scan().withColumn(name, F.col("_metadata.row_index")), self._wanted)

    def ordered(self) -> DataFrame:
        """The rows in file order, files by path: a sort over the cluster by two numbers of each row."""
        self._reader.check_open()
        places = {"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")}
        rows = unpacked(self._scan().withColumns(places), self._wanted)
        return rows.orderBy("_file", "_row").drop("_file", "_row")

    def row_group(self, group: int, file: int = 0) -> DataFrame:
        """The rows of one row group of one of the reader's files. IndexError if there is no such group."""
        self._reader.check_open()
        name = self._reader.files[file]
        sizes = [n for n, _ in read_footer(self._reader.spark, name).groups]
        first = sum(sizes[:group])
        places = {"_file": F.col("_metadata.file_name"), "_row": F.col("_metadata.row_index")}
        rows = self._scan().withColumns(places).where(F.col("_file") == name.rpartition("/")[2])
        inside = rows.where(F.col("_row").between(first, first + sizes[group] - 1))
        return unpacked(inside, self._wanted).orderBy("_row").drop("_file", "_row")

    def next(self) -> dict | None:
        """The next record, without keys for fields that have no value; None after the last."""
        self._reader.check_open()
        if self._rows is None:
            self._rows = self.ordered().toLocalIterator(prefetchPartitions=True)
        row = next(self._rows, None)
        return None if row is None else to_record(self._reader.known_schema, row)

    def rewind(self) -> None:
        self._rows = None

    def __iter__(self) -> Iterator[dict]:
        while (record := self.next()) is not None:
            yield record


class Reader:
    """A Parquet file, or a folder of them with one schema.

    Every file's footer is read on opening. ValueError names a file whose schema is not that of the first one (unless a
    schema is given, by which all are read), that is no Parquet file, or that Spark would misread.
    """

    def __init__(self, spark: SparkSession, path: str, schema: Schema | None = None, int96: str = "refuse"):
        self.spark, self.path, self.closed = spark, path, False
        self.files = data_files(spark, path)
        if not self.files:
            raise FileNotFoundError(f"no data files: {path}")
        self.footer: Footer = read_footer(spark, self.files[0])
        self._given = schema
        self._rows, self._metadata = 0, {}
        self._take(self.files[0], self.footer)
        for file, footer in read_footers(spark, self.files[1:]):
            self._take(file, footer)
        self._inferred = self._spark_schema_of_files()
        own = self._inferred is not None and any(f.metadata and METADATA_KEY in f.metadata for f in self._inferred.fields)
        self._definition = declared(self._inferred) if own else self.footer.definition
        if int96 == "refuse" and not own and (wide := self._integers_of_96_bits(self._definition)):
            raise ValueError(f"INT96 is read as a timestamp only (int96='timestamp'): {', '.join(wide)}")
        self.spark_schema = self._read_schema(own)

    def _spark_schema_of_files(self) -> T.StructType | None:
        """What Spark wrote into the footer, which takes no job, or infers; None where it cannot."""
        text = self.footer.metadata.get(SPARK_SCHEMA)
        if text and not any("=" in f[len(self.path) :] for f in self.files):  # no partition columns in the path
            return T.StructType.fromJson(json.loads(text))
        try:
            return self.spark.read.parquet(self.path).schema
        except AnalysisException:  # TIME and INTERVAL of other writers need an explicit schema
            return None

    def _take(self, file: str, footer: Footer) -> None:
        """Checks one file and adds its rows and metadata; of a key with several values the first file's stays."""
        if self._given is None and footer.message != self.footer.message:
            raise ValueError(f"schema differs from that of {self.files[0]}: {file}")
        self._refuse_misread(file, footer)
        self._rows += footer.rows
        self._metadata = user_metadata(footer) | self._metadata

    def _refuse_misread(self, file: str, footer: Footer) -> None:
        """Spark's vectorized reader returns wrong bytes for delta-coded byte arrays in uncompressed pages."""
        if self.spark.conf.get("spark.sql.parquet.enableVectorizedReader") != "true":
            return
        for _, columns in footer.groups:
            for path, codec, encodings, *_ in columns:
                if codec == "UNCOMPRESSED" and any(e.endswith("BYTE_ARRAY") and e.startswith("DELTA") for e in encodings):
                    raise ValueError(
                        f"{path} is delta-coded and uncompressed in {file}: set spark.sql.parquet.enableVectorizedReader to false"
                    )

    def _integers_of_96_bits(self, definition: dict, above: str = "") -> list[str]:
        found = []
        for name, options in definition.items():
            if "fields" in options:
                found += self._integers_of_96_bits(options["fields"], f"{above}{name}.")
            elif options["type"] == "INT96":
                found.append(above + name)
        return found

    def _read_schema(self, own: bool) -> T.StructType:
        if self._given is not None:
            return self._given.spark()
        if self._inferred is None or own:
            return Schema(self._definition).spark()
        return self._inferred

    @property
    def known_schema(self) -> Schema | None:
        """The schema, or None for files whose types have no logical type here."""
        try:
            return self.schema
        except ValueError:
            return None

    @property
    def schema(self) -> Schema:
        return self._given or Schema(self._definition)

    def check_open(self) -> None:
        if self.closed:
            raise ValueError("reader was closed")

    def cursor(self, columns: Columns = None) -> Cursor:
        """Names, or paths (lists of names) to leaves or groups. None: all. KeyError for an unknown one."""
        self.check_open()
        return Cursor(self, columns)

    def row_count(self) -> int:
        """The sum of the footers' counts, known since opening."""
        self.check_open()
        return self._rows

    def metadata(self) -> dict[str, str]:
        return self._metadata | table_metadata(self._inferred or T.StructType([]))

    def row_groups(self) -> DataFrame:
        """What the footers say of each row group and column."""
        return row_groups(self.spark, self.files)

    def close(self) -> None:
        self.closed = True

    def __enter__(self) -> Reader:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def open_file(spark: SparkSession, path: str, schema: Schema | None = None, int96: str = "refuse") -> Reader:
    """A reader. FileNotFoundError, or ValueError ("not valid parquet file"), if there is nothing to read."""
    return Reader(spark, path, schema, int96)


def open_bytes(spark: SparkSession, data: bytes, schema: Schema | None = None) -> Reader:
    """A reader of a file held in memory: it is put into the shared folder, where executors see it."""
    path = shared_path(spark, "bytes") + ".parquet"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return Reader(spark, path, schema)


