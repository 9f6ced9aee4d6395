"""File footers, read by the Parquet library inside Spark: what Spark's data source does not tell."""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

# Annotations of the format, where their name is not that of the logical type.
_ANNOTATIONS = {
    "STRING": "UTF8", "INTEGER(8,true)": "INT_8", "INTEGER(16,true)": "INT_16", "INTEGER(32,true)": "INT_32", "INTEGER(64,true)": "INT_64",
    "INTEGER(8,false)": "UINT_8", "INTEGER(16,false)": "UINT_16", "INTEGER(32,false)": "UINT_32", "INTEGER(64,false)": "UINT_64",
    "TIME(MILLIS,true)": "TIME_MILLIS", "TIME(MILLIS,false)": "TIME_MILLIS", "TIME(MICROS,true)": "TIME_MICROS",
    "TIME(MICROS,false)": "TIME_MICROS", "TIMESTAMP(MILLIS,true)": "TIMESTAMP_MILLIS", "TIMESTAMP(MILLIS,false)": "TIMESTAMP_MILLIS",
    "TIMESTAMP(MICROS,true)": "TIMESTAMP_MICROS", "TIMESTAMP(MICROS,false)": "TIMESTAMP_MICROS",
}
_SPARK_KEYS = "org.apache.spark."
#: Key under which Spark's writer keeps the schema of a DataFrame.
SPARK_SCHEMA = "org.apache.spark.sql.parquet.row.metadata"
#: Footers that are read at the same time; opening one is waiting for storage.
THREADS = 32


@dataclass
class Footer:
    definition: dict
    rows: int
    metadata: dict[str, str]
    created_by: str
    #: The fields of the file's schema as the format writes them.
    message: str = ""
    #: Of each row group: rows, and (path, codec, encodings, values, compressed and uncompressed bytes) of its columns.
    groups: list[tuple[int, list[tuple]]] = field(default_factory=list)


def data_files(spark: SparkSession, path: str) -> list[str]:
    """The data files at a path, in order of their names."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(at):
        raise FileNotFoundError(path)
    if not system.getFileStatus(at).isDirectory():
        return [path]
    found, todo = [], system.listFiles(at, True)
    while todo.hasNext():
        status = todo.next()
        parts = status.getPath().toString()[len(system.makeQualified(at).toString()) :].split("/")
        if not any(p.startswith(("_", ".")) for p in parts if p):
            found.append(status.getPath().toString())
    return sorted(found)


def _annotated(leaf) -> str:
    note = leaf.getLogicalTypeAnnotation()
    physical = str(leaf.getPrimitiveTypeName())
    if note is None:
        return {"BINARY": "BYTE_ARRAY"}.get(physical, physical)
    name = str(note)
    if name.startswith("INTERVAL"):
        return "INTERVAL"
    return _ANNOTATIONS.get(name, name)


def _declared(group) -> dict:
    out = {}
    for i in range(group.getFieldCount()):
        node = group.getType(i)
        repetition = str(node.getRepetition())
        options = {"OPTIONAL": {"optional": True}, "REPEATED": {"repeated": True}}.get(repetition, {})
        if node.isPrimitive():
            leaf = node.asPrimitiveType()
            options["type"] = _annotated(leaf)
            if str(leaf.getPrimitiveTypeName()) == "FIXED_LEN_BYTE_ARRAY":
                options["typeLength"] = leaf.getTypeLength()
        elif str(node.getLogicalTypeAnnotation()) == "LIST":
            options = {"repeated": True} | _listed(node.asGroupType().getType(0))
        else:
            options["fields"] = _declared(node.asGroupType())
        out[node.getName()] = options
    return out


def _listed(repeated) -> dict:
    """The declaration of a list's elements, from the repeated node below it."""
    if repeated.isPrimitive():
        return {"type": _annotated(repeated.asPrimitiveType())}
    group = repeated.asGroupType()
    if group.getFieldCount() != 1 or group.getName() == "array":
        return {"fields": _declared(group)}
    inner = next(iter(_declared(group).values()))
    return {k: v for k, v in inner.items() if k not in ("optional", "repeated")}


def read_footer(spark: SparkSession, file: str, with_schema: bool = True) -> Footer:
    """The footer of one file, its definition left empty on demand. ValueError if it is no Parquet file."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.parquet.hadoop
    try:
        source = hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(file), conf)
        reader = hadoop.ParquetFileReader.open(source)
    except Py4JJavaError as error:
        if "is not a Parquet file" in str(error.java_exception) or "Parquet" in str(error.java_exception):
            raise ValueError(f"not valid parquet file: {file}") from error
        raise
    try:
        footer = reader.getFooter()
        about = footer.getFileMetaData()
        pairs = about.getKeyValueMetaData()
        groups = []
        for block in json.loads(hadoop.metadata.ParquetMetadata.toJSON(footer))["blocks"]:
            columns = [
                (".".join(c["path"]), c["codec"], sorted(c["encodings"]), c["valueCount"], c["totalSize"], c["totalUncompressedSize"])
                for c in block["columns"]
            ]
            groups.append((block["rowCount"], columns))
        return Footer(
            definition=_declared(about.getSchema()) if with_schema else {},
            rows=sum(n for n, _ in groups),
            metadata={k: pairs[k] for k in pairs},
            created_by=about.getCreatedBy() or "",
            message=about.getSchema().toString().partition("{")[2],
            groups=groups,
        )
    finally:
        reader.close()


def read_footers(spark: SparkSession, files: list[str]) -> Iterator[tuple[str, Footer]]:
    """(file, footer) in the order of files, THREADS at a time and only as many in memory; without definitions."""
    with ThreadPoolExecutor(THREADS) as pool:
        for at in range(0, len(files), THREADS):
            some = files[at : at + THREADS]
            yield from zip(some, pool.map(lambda f: read_footer(spark, f, with_schema=False), some), strict=True)


def user_metadata(footer: Footer) -> dict[str, str]:
    """A footer's keys and values, without those of Spark's own writer."""
    return {k: v for k, v in footer.metadata.items() if not k.startswith(_SPARK_KEYS)}


def row_groups(spark: SparkSession, files: list[str]):
    """(file, row_group, rows, column, codec, encodings, num_values, compressed, uncompressed) of the files' footers."""
    rows = []
    for file, footer in read_footers(spark, files):
        for i, (n, columns) in enumerate(footer.groups):
            rows += [(file, i, n, *c) for c in columns]
    return spark.createDataFrame(
        rows, "file string, row_group int, rows long, column string, codec string, encodings array<string>, num_values long, compressed long, uncompressed long"
    )

