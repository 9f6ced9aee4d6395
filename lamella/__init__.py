"""A Spark engine for strictly typed, nested records in Parquet."""

from lamella.operators.schema import Schema
from lamella.sources.reader import Reader, open_bytes, open_file
from lamella.sources.writer import Writer, write, write_to

__all__ = ["Reader", "Schema", "Writer", "open_bytes", "open_file", "write", "write_to"]
