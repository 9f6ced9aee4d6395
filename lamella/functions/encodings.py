"""Value encodings of pages: sizes and runs as Spark columns, and the bytes themselves in Arrow batches.

Spark's own Parquet writer encodes files; these functions show, measure and check what the two declared encodings give.
"""

from __future__ import annotations

import struct
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamella.functions.logical import ENCODINGS, logical

# Little-endian layouts of the PLAIN encoding.
_NUMBERS = {"INT32": "<i4", "INT64": "<i8", "FLOAT": "<f4", "DOUBLE": "<f8"}
#: A run of as many equal values is stored once; bit-packed values come in groups of as many.
GROUP = 8


def plain_size(kind: str, value: Column, type_length: int | None = None) -> Column:
    """Bytes that a stored value of a logical type takes; NULL takes none. BOOLEAN gives an eighth."""
    physical = logical(kind).physical
    if physical == "BYTE_ARRAY":
        size = 4 + F.octet_length(value)
    elif physical == "FIXED_LEN_BYTE_ARRAY":
        size = F.lit(type_length) if type_length else F.octet_length(value)
    else:
        size = F.lit({"BOOLEAN": 0.125, "INT32": 4, "INT64": 8, "INT96": 12, "FLOAT": 4, "DOUBLE": 8}[physical])
    return F.when(value.isNull(), F.lit(0)).otherwise(size)


def plain_bytes(kind: str, total: Column) -> Column:
    """Whole bytes of a page from the sum of plain_size()."""
    return F.ceil(total).cast("long")


def rle_runs(df: DataFrame, value: str, page: list[str], order: list[str]) -> DataFrame:
    """The runs of equal values: page columns, run (from 0), value, run_length.

    Runs end where a page does, so pages are independent and no task needs more than one. NULL equals NULL.
    """
    of_page = W.partitionBy(*page).orderBy(*order)
    first = F.row_number().over(of_page) == 1
    new = first | ~F.col(value).eqNullSafe(F.lag(value).over(of_page))
    marked = df.withColumn("_new", F.when(new, 1).otherwise(0)).withColumn("_run", F.sum("_new").over(of_page) - 1)
    return marked.groupBy(*page, F.col("_run").cast("long").alias("run")).agg(
        F.first(value).alias("value"), F.count(F.lit(1)).alias("run_length")
    )


def rle_expand(runs: DataFrame, page: list[str]) -> DataFrame:
    """The values of rle_runs() again: page columns, run, place in the run, value."""
    places = F.explode(F.sequence(F.lit(1).cast("long"), F.col("run_length"))).alias("place")
    return runs.select(*page, "run", places, "value").withColumn("place", F.col("place") - 1)


def encode_plain(physical: str, values, type_length: int | None = None) -> bytes:
    if physical == "BOOLEAN":
        return np.packbits(np.asarray(values, dtype=bool), bitorder="little").tobytes()
    if physical in _NUMBERS:
        return np.asarray(values, dtype=_NUMBERS[physical]).tobytes()
    if physical == "INT96":
        low = np.asarray(values, dtype=np.int64)
        out = np.empty(len(low), dtype=[("low", "<i8"), ("high", "<i4")])
        out["low"], out["high"] = low, low >> 63
        return out.tobytes()
    if physical == "BYTE_ARRAY":
        return b"".join(struct.pack("<I", len(v)) + bytes(v) for v in values)
    if physical == "FIXED_LEN_BYTE_ARRAY":
        if not type_length:
            raise ValueError("missing option: typeLength (required for FIXED_LEN_BYTE_ARRAY)")
        for v in values:
            if len(v) != type_length:
                raise ValueError(f"invalid value for FIXED_LEN_BYTE_ARRAY: {len(v)} bytes, not {type_length}")
        return b"".join(map(bytes, values))
    raise ValueError(f"unsupported type: {physical}")


def decode_plain(physical: str, data: bytes, count: int, type_length: int | None = None) -> list:
    if physical == "BOOLEAN":
        return np.unpackbits(np.frombuffer(data, np.uint8), count=count, bitorder="little").astype(bool).tolist()
    if physical in _NUMBERS:
        return np.frombuffer(data, _NUMBERS[physical], count).tolist()
    if physical == "INT96":
        return np.frombuffer(data, [("low", "<i8"), ("high", "<i4")], count)["low"].tolist()
    if physical == "BYTE_ARRAY":
        out, at = [], 0
        for _ in range(count):
            size = struct.unpack_from("<I", data, at)[0]
            out.append(data[at + 4 : at + 4 + size])
            at += 4 + size
        return out
    if physical == "FIXED_LEN_BYTE_ARRAY":
        if not type_length:
            raise ValueError("missing option: typeLength (required for FIXED_LEN_BYTE_ARRAY)")
        return [data[i * type_length : (i + 1) * type_length] for i in range(count)]
    raise ValueError(f"unsupported type: {physical}")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _packed(values: np.ndarray, width: int) -> bytes:
    groups = -(-len(values) // GROUP)
    full = np.zeros(groups * GROUP, dtype=np.uint64)
    full[: len(values)] = values
    bits = (full[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return _varint(groups << 1 | 1) + np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def encode_rle(values, width: int, envelope: bool = False) -> bytes:
    """Runs of GROUP equal values or more as one value, others bit-packed; envelope puts the length in front.

    Bit-packed values fill whole groups before a repeated run: what a group lacks is taken from the run.
    """
    v = np.asarray(values, dtype=np.int64).astype(np.uint64)
    out, open_from = [], 0
    starts = np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else v[:0].astype(np.int64)
    for start, end in zip(starts.tolist(), np.append(starts[1:], len(v)).tolist(), strict=False):
        first = start + -(start - open_from) % GROUP
        if end - first < GROUP:
            continue
        if first > open_from:
            out.append(_packed(v[open_from:first], width))
        out.append(_varint((end - first) << 1) + int(v[start]).to_bytes(-(-width // 8), "little"))
        open_from = end
    if open_from < len(v):
        out.append(_packed(v[open_from:], width))
    data = b"".join(out)
    return struct.pack("<I", len(data)) + data if envelope else data


def decode_rle(data: bytes, width: int, count: int, envelope: bool = False) -> list[int]:
    at = 4 if envelope else 0
    parts: list[np.ndarray] = []
    have = 0
    while have < count:
        head = shift = 0
        while True:
            byte = data[at]
            at += 1
            head |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                break
        if head & 1:
            size = (head >> 1) * width
            bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), bitorder="little").reshape(-1, width)
            parts.append((bits.astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64))
            at += size
        else:
            size = -(-width // 8)
            parts.append(np.full(head >> 1, int.from_bytes(data[at : at + size], "little"), dtype=np.uint64))
            at += size
        have += len(parts[-1])
    return np.concatenate(parts)[:count].astype(np.int64).tolist() if parts else []


def encode_values(kind: str, encoding: str, values, type_length: int | None = None) -> bytes:
    """The bytes of stored values in a declared encoding. RLE is for BOOLEAN, INT32 and INT64; type_length is its width."""
    physical = logical(kind).physical
    if encoding not in ENCODINGS:
        raise ValueError(f"unsupported encoding: {encoding}")
    if encoding == "PLAIN":
        return encode_plain(physical, values, type_length)
    if physical not in ("BOOLEAN", "INT32", "INT64"):
        raise ValueError(f"unsupported type for RLE: {physical}")
    return encode_rle(values, type_length or 1, envelope=True)


def decode_values(kind: str, encoding: str, data: bytes, count: int, type_length: int | None = None) -> list:
    physical = logical(kind).physical
    if encoding not in ENCODINGS:
        raise ValueError(f"unsupported encoding: {encoding}")
    if encoding == "PLAIN":
        return decode_plain(physical, data, count, type_length)
    found = decode_rle(data, type_length or 1, count, envelope=True)
    return [bool(x) for x in found] if physical == "BOOLEAN" else found


def encode_pages(df: DataFrame, kind: str, value: str, page: str, order: str, encoding: str = "PLAIN", type_length: int | None = None) -> DataFrame:
    """(page, num_values, data): the encoded values of each page, NULL left out. value holds stored values.

    A page is one task's unit, so pages must be of a bounded size.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values("o")["v"].dropna().tolist()
        data = encode_values(kind, encoding, values, type_length)
        return pd.DataFrame({"page": [pdf["page"].iloc[0]], "num_values": [len(values)], "data": [data]})

    chosen = df.select(F.col(page).cast("long").alias("page"), F.col(order).alias("o"), F.col(value).alias("v"))
    return chosen.groupBy("page").applyInPandas(run, "page long, num_values long, data binary")


def decode_pages(pages: DataFrame, kind: str, result: str, encoding: str = "PLAIN", type_length: int | None = None) -> DataFrame:
    """(page, place, value) from the pages of encode_pages(); result is the Spark type of a value. A page is one batch."""

    def run(batches):
        for pdf in batches:
            for page, count, data in zip(pdf["page"], pdf["num_values"], pdf["data"], strict=True):
                values = decode_values(kind, encoding, bytes(data), int(count), type_length)
                yield pd.DataFrame({"page": page, "place": np.arange(len(values)), "value": values})

    return pages.select("page", "num_values", "data").mapInPandas(run, f"page long, place long, value {result}")


def encode_levels(levels, most: int, envelope: bool) -> bytes:
    """Repetition or definition levels of a page: RLE at the width of the highest level; nothing if that is 0."""
    return encode_rle(levels, most.bit_length(), envelope) if most else b""


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package
