"""What the operators share: byte-level tokenisers, tables in the shared folder, Arrow maps."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z; every ASCII byte that is not a letter or digit becomes a space. Bytes from 0x80 stay: they are
#: parts of non-ASCII characters, all of which belong to words.
_ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def alnum_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 text, with A-Z lower-cased. Null has none."""
    return text.translate(_ALNUM).split() if text else []


def space_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 text, with A-Z lower-cased. Null has none."""
    return text.lower().split() if text else []


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; and Python workers on this machine will find this package. (On a cluster it is installed or sent.)"""
    here, known = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if here not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, [here, known.get("PYTHONPATH", "")]))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one of our own only if that is
    unset in local mode, as in tests."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="lamella-")
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df once into the shared folder and read it back: cuts lineage, and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_bytes(column: str, alias: str | None = None):
    """A string column as UTF-8 bytes, which Arrow hands to Python without decoding."""
    return F.col(column).cast("binary").alias(alias or column)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply fn to each Arrow batch; fn must be a plain picklable function or closure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


def chunks(rows: list, weight: Callable, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows whose summed weight stays near most; one heavy row forms a range alone."""
    start, total = 0, 0
    for i, row in enumerate(rows):
        w = weight(row)
        if total and total + w > most:
            yield start, i
            start, total = i, 0
        total += w
    if start < len(rows):
        yield start, len(rows)


def held_out(doc_id):
    """crc32 of doc_id as text, modulo 5, is 0. A null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0
