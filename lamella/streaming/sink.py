"""A streaming sink: records of a stream, checked against a schema, into Parquet files."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lamella.functions.convert import STRICT
from lamella.operators.schema import Schema
from lamella.sources.writer import _options, plain_timestamps, prepared


def sink(
    stream: DataFrame, path: str, schema: Schema, checkpoint: str, *, row_group_size: int | None = None, page_size: int | None = None,
    page_rows: int | None = None, page_v2: bool | None = None, dictionary: bool = True, compression: str | None = None,
    metadata: dict | None = None, checks: str = STRICT, available_now: bool = False, interval: str | None = None,
) -> StreamingQuery:
    """Start writing a stream. Rows without any value are skipped. Each micro-batch commits whole files, exactly once.

    available_now ends the query when what is there has been written; interval is the time between micro-batches.
    """
    options = _options(
        stream.sparkSession, schema, compression=compression, page_v2=page_v2, dictionary=dictionary,
        row_group_size=row_group_size, page_size=page_size, page_rows=page_rows,
    )
    known = [F.col(f"`{f.name}`").isNotNull() for f in schema.roots if f.name in stream.columns]
    filled = stream.where(reduce(or_, known)) if known else stream
    rows = prepared(filled, schema, metadata, checks)
    writer = rows.writeStream.format("parquet").options(**options).option("checkpointLocation", checkpoint).option("path", path)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif interval:
        writer = writer.trigger(processingTime=interval)
    with plain_timestamps(stream.sparkSession):
        return writer.start()
