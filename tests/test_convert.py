import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.functions import bson, convert
from lamella.functions.logical import TYPES
from lamella.operators.records import to_value

BOUNDS = [("INT_8", -(2**7), 2**7 - 1), ("UINT_8", 0, 2**8 - 1), ("INT_16", -(2**15), 2**15 - 1), ("UINT_16", 0, 2**16 - 1), ("INT32", -(2**31), 2**31 - 1),
          ("INT_32", -(2**31), 2**31 - 1), ("UINT_32", 0, 2**32 - 1), ("INT64", -(2**63), 2**63 - 1), ("UINT_64", 0, 2**64 - 1), ("INT96", -(2**63), 2**63 - 1),
          ("TIME_MILLIS", 0, 2**31 - 1), ("TIME_MICROS", 0, 2**63 - 1)]
INTERVAL = "months long, days long, milliseconds long"


def stored(spark, kind, values, source, length=None, mode=convert.PERMISSIVE):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {source}")
    column = convert.to_primitive(kind, F.col("v"), rows.schema["v"].dataType, length, mode)
    return [r.s for r in rows.select("i", column.alias("s")).orderBy("i").collect()]


@pytest.mark.parametrize(("kind", "low", "high"), BOUNDS)
def test_integer_bounds(spark, kind, low, high):
    texts = [str(low), str(high), str(low - 1), str(high + 1), f" {high}.9 apples", "12abc", "", "x1", None]
    found = stored(spark, kind, texts, "string")
    assert [None if x is None else int(x) for x in found] == [low, high, None, None, high, 12, None, None, None]
    for text, value in zip(texts[:-1], found):
        if value is None:
            with pytest.raises(ValueError, match=f"invalid value for {kind}"):
                to_value(kind, text)
        else:
            assert to_value(kind, text) == value


def test_integers_from_numbers(spark):
    assert stored(spark, "INT32", [1.9, -1.9, float("nan"), float("inf"), 3e9, 5.0], "double") == [1, -1, None, None, None, 5]
    assert stored(spark, "INT32", [Decimal("7.99"), Decimal("-7.99")], "decimal(10,2)") == [7, -7]
    assert stored(spark, "INT64", [True], "boolean") == [None]
    assert [to_value("INT32", x) for x in (1.9, -1.9, Decimal("7.99"))] == [1, -1, 7]


def test_floats(spark):
    texts = ["2.5kg", "-.5e1", "Infinity", "none", "3."]
    assert stored(spark, "DOUBLE", texts, "string") == [2.5, -5.0, float("inf"), None, 3.0]
    assert stored(spark, "DOUBLE", [float("nan"), 1.0], "double") == [None, 1.0]
    assert stored(spark, "FLOAT", [3], "int") == [3.0]
    assert [to_value("DOUBLE", t) for t in ("2.5kg", "-.5e1")] == [2.5, -5.0]
    for bad in ("none", float("nan"), True):
        with pytest.raises(ValueError):
            to_value("DOUBLE", bad)


def test_truth(spark):
    assert stored(spark, "BOOLEAN", ["false", "", "0"], "string") == [True, False, True]
    assert stored(spark, "BOOLEAN", [0.0, float("nan"), 2.0, None], "double") == [False, False, True, None]
    assert [to_value("BOOLEAN", x) for x in ("false", "", 0, 7)] == [True, False, False, True]


def test_bytes_and_text(spark):
    assert stored(spark, "UTF8", ["é"], "string") == ["é".encode()]
    assert stored(spark, "FIXED_LEN_BYTE_ARRAY", ["FNORD", "FNOR"], "string", 5) == [b"FNORD", None]
    assert stored(spark, "BYTE_ARRAY", [b"\x00\xff"], "binary") == [b"\x00\xff"]
    assert stored(spark, "UTF8", [3], "int") == [None]
    with pytest.raises(ValueError):
        to_value("FIXED_LEN_BYTE_ARRAY", b"FNOR", 5)


def test_moments(spark):
    at = dt.datetime(2017, 11, 26, 12, 30, 1, 234567, tzinfo=dt.UTC)
    micros = int(at.timestamp()) * 10**6 + 234567
    assert stored(spark, "DATE", [at], "timestamp") == [17496]
    assert stored(spark, "DATE", [dt.datetime(1969, 12, 31, 12, tzinfo=dt.UTC)], "timestamp") == [-1]
    assert stored(spark, "TIMESTAMP_MILLIS", [at], "timestamp") == [micros // 1000]
    assert stored(spark, "TIMESTAMP_MICROS", [at], "timestamp") == [micros]
    assert stored(spark, "TIMESTAMP_MILLIS", [dt.date(1970, 1, 2)], "date") == [86_400_000]
    assert stored(spark, "DATE", ["17496.5", "-1"], "string") == [17496, None]
    assert to_value("DATE", 17496) == dt.date(2017, 11, 26) == to_value("DATE", at)
    assert to_value("TIMESTAMP_MILLIS", at).microsecond == 234000
    with pytest.raises(ValueError):
        to_value("TIMESTAMP_MICROS", -1)


def test_intervals(spark):
    values = [(42, 23, 777), (0, 0, 2**32 - 1), (-1, 0, 0), (0, 2**32, 0), (1, None, 1), None]
    found = stored(spark, "INTERVAL", values, f"struct<{INTERVAL.replace(' ', ':')}>".replace(",:", ","))
    assert found == [bytes.fromhex("2a0000001700000009030000"), bytes.fromhex("0000000000000000ffffffff"), None, None, None, None]
    back = spark.createDataFrame([(found[0],), (found[1],)], "b binary").select(convert.unpack_interval(F.col("b")).alias("i")).collect()
    assert [tuple(r.i) for r in back] == [(42, 23, 777), (0, 0, 2**32 - 1)]


def test_json_and_bson(spark):
    texts = ['{"a": [1, 2.5, "x", null, true], "b": {"c": 1099511627776}}', "{", "[1]", None]
    assert stored(spark, "JSON", texts, "string") == [texts[0].encode(), None, b"[1]", None]
    packed = stored(spark, "BSON", texts, "string")
    assert packed[1:] == [None, None, None]
    assert bson.loads(packed[0]) == {"a": [1, 2.5, "x", None, True], "b": {"c": 2**40}}
    assert bson.dumps({}) == b"\x05\x00\x00\x00\x00"
    assert bson.loads(bytes.fromhex("160000000268656c6c6f0006000000776f726c640000")) == {"hello": "world"}
    assert to_value("JSON", {"b": [1]}) == '{"b":[1]}'
    rows = spark.createDataFrame([(packed[0],), (None,)], "b binary").select(bson.to_json(F.col("b")).alias("t")).collect()
    assert [r.t for r in rows] == ['{"a":[1,2.5,"x",null,true],"b":{"c":1099511627776}}', None]


def test_strict_mode_raises_and_errors_are_told(spark):
    with pytest.raises(Exception, match="invalid value for INT_8: 300"):
        stored(spark, "INT_8", [1, 300], "int", mode=convert.STRICT)
    rows = spark.createDataFrame([(1,), (300,), (None,)], "v int")
    found = rows.select(convert.conversion_error("INT_8", F.col("v"), T.IntegerType()).alias("e")).collect()
    assert [r.e for r in found] == [None, "invalid value for INT_8: 300", None]


@pytest.mark.parametrize("kind", sorted(set(TYPES) - {"BSON", "INTERVAL", "FIXED_LEN_BYTE_ARRAY"}))
def test_every_type_comes_back(spark, kind):
    value = {"UTF8": "é", "JSON": "[1]", "BYTE_ARRAY": "x", "BOOLEAN": "y"}.get(kind, "100")
    rows = spark.createDataFrame([(value,)], "v string")
    of = TYPES[kind]
    back = convert.to_logical(kind, F.col("v"), T.StringType())
    again = convert.to_primitive(kind, F.col("b"), of.spark)
    once = convert.to_primitive(kind, F.col("v"), T.StringType())
    row = rows.select(back.alias("b"), once.alias("once")).select("b", "once", again.alias("again")).first()
    assert row.once == row.again is not None
    assert rows.select(back.alias("b")).schema["b"].dataType == of.spark


def test_unknown_type():
    with pytest.raises(ValueError, match="invalid type: MAP"):
        convert.to_primitive("MAP", F, T.StringType())


@pytest.mark.parametrize(("value", "width"), [(0, 0), (1, 1), (2, 2), (7, 3), (8, 4), (2**40, 41)])
def test_bit_width(spark, value, width):
    assert spark.range(1).select(convert.bit_width(F.lit(value)).alias("w")).first().w == width
