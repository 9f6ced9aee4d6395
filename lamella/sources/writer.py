"""Writing: whole DataFrames, and records one by one."""

from __future__ import annotations

from collections.abc import Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lamella.functions.compression import writer_option
from lamella.functions.convert import STRICT
from lamella.operators.conform import conform
from lamella.operators.records import to_row
from lamella.operators.schema import Schema
from lamella.operators.shared import shared_path
from lamella.sources.intervals import packed

#: Rows of a row group where records are written one by one.
ROW_GROUP_ROWS = 4096
#: Records that are held on the driver before they are staged.
STAGED_ROWS = 65_536


def compression_of(schema: Schema) -> str:
    """The one compression of all leaves. ValueError if they differ: Spark has one for a file."""
    found = sorted({leaf.compression for leaf in schema.leaves})
    if len(found) > 1:
        raise ValueError(f"one compression for all columns is supported, not {', '.join(found)}")
    return found[0]


def _options(spark: SparkSession, schema: Schema, **given) -> dict[str, str]:
    method = given["compression"] or compression_of(schema)
    plain = method == "UNCOMPRESSED"
    if given["page_v2"] and plain:
        raise ValueError("V2 pages need a compression: Spark's vectorized reader misreads delta-coded bytes that have none")
    out = {
        "compression": writer_option(spark, method),
        "parquet.writer.version": "v1" if plain or given["page_v2"] is False else "v2",
        "parquet.enable.dictionary": str(bool(given["dictionary"])).lower(),
    }
    names = {"row_group_size": "parquet.block.row.count.limit", "page_size": "parquet.page.size", "page_rows": "parquet.page.row.count.limit"}
    return out | {option: str(int(given[name])) for name, option in names.items() if given[name]}


@contextmanager
def plain_timestamps(spark: SparkSession):
    """Timestamps in files as microseconds (Spark's default is INT96); the setting has no option, so it is put back."""
    key = "spark.sql.parquet.outputTimestampType"
    before = spark.conf.get(key)
    spark.conf.set(key, "TIMESTAMP_MICROS")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def prepared(df: DataFrame, schema: Schema, metadata: dict | None = None, mode: str = STRICT) -> DataFrame:
    """df as files of the schema hold it."""
    if not schema.roots:
        raise ValueError("cannot write a file with zero fields")
    rows = packed(conform(df, schema, mode))
    if not metadata:
        return rows
    first = schema.spark(metadata).fields[0]
    return rows.withMetadata(first.name, first.metadata)


def write(
    df: DataFrame, path: str, schema: Schema, *, row_group_size: int | None = None, page_size: int | None = None,
    page_rows: int | None = None, page_v2: bool | None = None, dictionary: bool = True, compression: str | None = None,
    metadata: dict | None = None, single_file: bool = False, mode: str = "errorifexists", checks: str = STRICT,
) -> None:
    """Write df, checked against the schema, as a folder of Parquet files, one for each partition.

    row_group_size counts rows (None: by bytes, as Spark does). page_size is in bytes. dictionary=False leaves dictionary
    pages out. page_v2 None means V2 pages for compressed files and V1 pages for others. single_file puts all rows through one task.
    """
    options = _options(
        df.sparkSession, schema, compression=compression, page_v2=page_v2, dictionary=dictionary,
        row_group_size=row_group_size, page_size=page_size, page_rows=page_rows,
    )
    rows = prepared(df, schema, metadata, checks)
    with plain_timestamps(df.sparkSession):
        (rows.coalesce(1) if single_file else rows).write.mode(mode).options(**options).parquet(path)


class Writer:
    """Records, one by one, into the files at path, in order.

    A record that breaks the schema raises ValueError and leaves the writer as it was. Records are staged in the shared
    folder, STAGED_ROWS at a time, and written when the writer closes.
    """

    def __init__(self, spark: SparkSession, schema: Schema, path: str, *, row_group_size: int = ROW_GROUP_ROWS, **options):
        if not schema.roots:
            raise ValueError("cannot write a file with zero fields")
        self._spark, self._schema, self._path = spark, schema, path
        self._options = {"row_group_size": row_group_size} | options
        self._metadata: dict[str, str] = {}
        self._rows: list[tuple] = []
        self._staged, self._parts, self.closed = shared_path(spark, "records"), 0, False

    def append(self, record: Mapping) -> None:
        if self.closed:
            raise ValueError("writer was closed")
        self._rows.append(to_row(self._schema, record))
        if len(self._rows) >= STAGED_ROWS:
            self._stage()

    def set_metadata(self, key, value) -> None:
        self._metadata[str(key)] = str(value)

    def set_row_group_size(self, rows: int) -> None:
        self._options["row_group_size"] = rows

    def set_page_size(self, size: int) -> None:
        self._options["page_size"] = size

    def _frame(self) -> DataFrame:
        first = self._parts * STAGED_ROWS
        kind = T.StructType([T.StructField("place", T.LongType()), T.StructField("record", self._schema.spark())])
        return self._spark.createDataFrame([(first + i, r) for i, r in enumerate(self._rows)], kind)

    def _stage(self) -> None:
        self._frame().write.mode("append").parquet(self._staged)
        self._parts, self._rows = self._parts + 1, []

    def close(self) -> None:
        if self.closed:
            raise ValueError("writer was closed")
        self.closed = True
        if self._parts:
            self._stage()
            rows = self._spark.read.parquet(self._staged).orderBy("place").select("record.*")
            write(rows, self._path, self._schema, metadata=self._metadata, **self._options)
            at = self._spark._jvm.org.apache.hadoop.fs.Path(self._staged)
            at.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(at, True)
        else:
            rows = self._frame().coalesce(1).sortWithinPartitions("place").select("record.*")
            write(rows, self._path, self._schema, metadata=self._metadata, **self._options)
        self._rows = []

    def __enter__(self) -> Writer:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None and not self.closed:
            self.close()


def write_to(df: DataFrame, output, schema: Schema, **options) -> None:
    """Write df as one file into an object with write(bytes), and close it if it has close(). All rows go through one
    task and then the driver, so this is for files of a moderate size."""
    spark = df.sparkSession
    path = shared_path(spark, "stream")
    write(df, path, schema, single_file=True, **options)
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(s.getPath() for s in system.listStatus(at) if s.getPath().getName().startswith("part-"))
    stream = system.open(part)
    try:
        while chunk := bytes(stream.readNBytes(1 << 20)):
            output.write(chunk)
    finally:
        stream.close()
    system.delete(at, True)
    if hasattr(output, "close"):
        output.close()


