"""Registered queries of the engine over the tables of a folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.functions import compression, convert, encodings
from lamella.operators.conform import conform
from lamella.operators.ordinal import with_ordinal
from lamella.operators.schema import Schema
from lamella.operators.shared import shared_path
from lamella.operators.shred import materialize, shred, shred_leaf
from lamella.plans.oracles import SQL, converted_sql, levels_sql
from lamella.sources.reader import open_file
from lamella.sources.writer import write
from lamella.streaming.sink import sink

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

ORDERS = Schema({
    "o_orderkey": {"type": "INT64"},
    "o_orderpriority": {"type": "UTF8"},
    "items": {
        "repeated": True,
        "fields": {"l_linenumber": {"type": "INT32"}, "l_quantity": {"type": "DOUBLE"}, "l_note": {"type": "UTF8", "optional": True}},
    },
})
VECTORS = Schema({"vec_id": {"type": "INT64"}, "embedding": {"type": "FLOAT", "repeated": True}})
LABELLED = Schema({"l_key": {"type": "INT64"}, "l_quantity": {"type": "DOUBLE", "optional": True}, "l_returnflag": {"type": "UTF8"}})
CUSTOMERS = Schema({
    "c_nation": {"type": "INT64"},
    "segments": {"repeated": True, "fields": {"name": {"type": "UTF8"}, "keys": {"type": "INT64", "repeated": True}}},
})
#: Rows of a row group, and values of a page, in the queries that show layouts.
GROUP_ROWS, PAGE_VALUES = 4096, 8192
TOTAL_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nested_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their items, the input of the nested queries; lines of one supplier in three carry a note."""
    note = F.when(F.col("l_suppkey") % 3 == 0, F.col("l_returnflag"))
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").cast("double").alias("l_quantity"), note.alias("l_note"))
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("items"))  # by the item's fields, in this order
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return orders.join(items, orders.o_orderkey == items.l_orderkey, "left").drop("l_orderkey")


def nested_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with segments with customers: arrays in arrays. Customers in debt leave their segment without keys."""
    keys = F.array_sort(F.collect_list(F.when(F.col("c_acctbal") >= 0, F.col("c_custkey"))))
    segments = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(keys.alias("keys"))
    segment = F.struct(F.col("c_mktsegment").alias("name"), "keys")
    return segments.groupBy(F.col("c_nationkey").cast("long").alias("c_nation")).agg(F.array_sort(F.collect_list(segment)).alias("segments"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested orders written in small row groups, then read by a nested projection."""
    path = shared_path(spark, "flagship")
    write(nested_orders(spark, sf_dir), path, ORDERS, row_group_size=GROUP_ROWS, compression="SNAPPY")
    cursor = open_file(spark, path).cursor([["o_orderkey"], ["items", "l_quantity"]])
    return cursor.frame.select("o_orderkey", F.explode("items").alias("i")).select("o_orderkey", "i.l_quantity")


def _scan(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return open_file(spark, f"{sf_dir}/{name}.parquet").cursor().frame

    return run


def project_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return open_file(spark, f"{sf_dir}/orders.parquet").cursor(["o_orderkey", "o_orderpriority"]).frame


def row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(t, open_file(spark, f"{sf_dir}/{t}.parquet").row_count()) for t in TABLES]
    return spark.createDataFrame(rows, "name string, n long")


def column_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of each leaf, counted as a column chunk does: an entry for every value, or for its absence."""
    rows = table(spark, sf_dir, "embeddings")
    counts = rows.agg(F.count(F.lit(1)).alias("vec_id"), F.sum(F.greatest(F.size("embedding"), F.lit(1))).cast("long").alias("embedding"))
    return counts.unpivot([], ["vec_id", "embedding"], "path", "num_values")


def footer_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row groups that a write with a limit made, from the footers of all its files: rows, and groups that break the
    limit or are not full though others follow in their file."""
    path = shared_path(spark, "groups")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    flat = Schema({"o_orderkey": {"type": "INT64"}, "o_orderpriority": {"type": "UTF8"}})
    write(rows, path, flat, row_group_size=GROUP_ROWS, compression="SNAPPY")
    groups = open_file(spark, path).row_groups()
    last = F.col("row_group") == F.max("row_group").over(W.partitionBy("file", "column"))
    odd = (F.col("rows") > GROUP_ROWS) | (~last & (F.col("rows") != GROUP_ROWS))
    return groups.withColumn("odd", odd.cast("long")).groupBy("column").agg(F.sum("num_values").alias("n_rows"), F.sum("odd").alias("n_odd"))


def file_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codecs and value encodings in a folder of files that were written in several ways, from their footers."""
    path = shared_path(spark, "encodings")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    schema = Schema({"p_partkey": {"type": "INT64"}, "p_name": {"type": "UTF8"}})
    ways = {"v1": {"compression": "GZIP", "page_v2": False}, "v2": {"compression": "SNAPPY", "page_v2": True}, "none": {"compression": "UNCOMPRESSED", "page_v2": False}}
    for name, options in ways.items():
        write(rows, f"{path}/{name}", schema, dictionary=False, **options)
    found = open_file(spark, path).row_groups().withColumn("way", F.element_at(F.split("file", "/"), -2))
    of_values = F.filter("encodings", lambda e: ~e.isin("RLE", "BIT_PACKED"))
    return found.groupBy("way", "column", "codec", F.array_join(of_values, ",").alias("encoding")).agg(F.sum("num_values").alias("num_values"))


def row_group_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each row group of lineitem in its total order."""
    rows = with_ordinal(table(spark, sf_dir, "lineitem").select(*TOTAL_ORDER), TOTAL_ORDER, "n")
    group = F.floor(F.col("n") / GROUP_ROWS).cast("long")
    return rows.groupBy(group.alias("row_group")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("l_linenumber").cast("long").alias("lines"))


def cursor_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 100 to 149 of a cursor: a few rows, which is what a caller takes who stops early."""
    rows = open_file(spark, f"{sf_dir}/orders.parquet").cursor(["o_orderkey", "o_orderpriority"]).frame
    return rows.orderBy("o_orderkey").offset(100).limit(50)


def cursor_rewind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cursor walked, rewound and walked again gives the same records."""
    cursor = open_file(spark, f"{sf_dir}/region.parquet").cursor(["r_regionkey", "r_name"])
    first = [cursor.next() for _ in range(3)]
    cursor.rewind()
    again = list(cursor)
    same = first == again[:3]
    return spark.createDataFrame([(int(r["r_regionkey"]), r["r_name"], same) for r in again], "r_regionkey long, r_name string, same boolean")


def project_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path into a repeated group: its parents keep their shape, its siblings are not read."""
    path = shared_path(spark, "nested")
    write(nested_orders(spark, sf_dir), path, ORDERS, compression="SNAPPY")
    frame = open_file(spark, path).cursor([["o_orderkey"], ["items", "l_linenumber"]]).frame
    return frame.select("o_orderkey", F.explode_outer("items").alias("i")).select("o_orderkey", F.col("i.l_linenumber").cast("long").alias("l_linenumber"))


def nest_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = conform(nested_orders(spark, sf_dir), ORDERS)
    items = F.array_join(F.transform("items", lambda i: F.concat_ws(":", i["l_linenumber"].cast("string"), i["l_quantity"].cast("int").cast("string"), F.coalesce(i["l_note"], F.lit("")))), ",")
    return nested.select("o_orderkey", F.coalesce(items, F.lit("")).alias("items"))


def schema_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ORDERS.levels(spark).select(F.col("ord").cast("long").alias("ord"), "path", "repetition", F.col("r_max").cast("long").alias("r_max"), F.col("d_max").cast("long").alias("d_max"))


def metadata_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "metadata")
    rows = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("r_regionkey"))
    write(rows, path, Schema({"r_regionkey": {"type": "INT64"}}), metadata={"myuid": 420, "fnord": "dronf"})
    return spark.createDataFrame(sorted(open_file(spark, path).metadata().items()), "key string, value string")


def _levels(df: DataFrame, schema: Schema, path: list[str], key: str) -> DataFrame:
    found = shred_leaf(conform(df, schema, keep=("row_id",)), schema, path)
    place = F.when(F.size("place") > 0, F.array_join(F.col("place").cast("array<string>"), ",")).otherwise("")
    return found.select(F.col("row_id").alias(key), place.alias("place"), F.col("r").cast("long").alias("r"), F.col("d").cast("long").alias("d"), F.col("value").cast("string").alias("value"))


def _rowed(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("row_id", F.col(key).cast("long"))


def shred_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_mktsegment")
    return _levels(_rowed(rows, "c_custkey"), Schema({"c_custkey": {"type": "INT64"}, "c_mktsegment": {"type": "UTF8"}}), ["c_mktsegment"], "c_custkey")


def shred_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority = F.nullif(F.col("o_orderpriority"), F.lit("1-URGENT")).alias("o_orderpriority")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", priority)
    return _levels(_rowed(rows, "o_orderkey"), Schema({"o_orderpriority": {"type": "UTF8", "optional": True}}), ["o_orderpriority"], "o_orderkey")


def shred_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conform(_rowed(table(spark, sf_dir, "embeddings"), "vec_id"), VECTORS, keep=("row_id",))
    found = shred_leaf(rows, VECTORS, ["embedding"])
    value = F.round(F.col("value").cast("double") * 10_000).cast("long").alias("value")
    return found.select(F.col("row_id").alias("vec_id"), F.array_join(F.col("place").cast("array<string>"), ",").alias("place"), *[F.col(c).cast("long").alias(c) for c in "rd"], value)


def _shred_items(leaf: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _levels(_rowed(nested_orders(spark, sf_dir), "o_orderkey"), ORDERS, ["items", leaf], "o_orderkey").withColumn("value", F.expr("if(value like '%.0', left(value, length(value) - 2), value)"))

    return run


def shred_arrays_in_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(_rowed(nested_customers(spark, sf_dir), "c_nation"), CUSTOMERS, ["segments", "keys"], "c_nation")


def materialize_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders taken apart and put together again."""
    rows = conform(_rowed(nested_orders(spark, sf_dir), "o_orderkey"), ORDERS, keep=("row_id",))
    back = materialize(shred(rows, ORDERS), ORDERS)
    back = back.select("o_orderkey", "o_orderpriority", F.posexplode_outer("items").alias("place", "i"))
    return back.select("o_orderkey", "o_orderpriority", F.coalesce("place", F.lit(0)).cast("long").alias("place"), F.col("i.l_linenumber").cast("long").alias("l_linenumber"), F.col("i.l_quantity").alias("l_quantity"), F.col("i.l_note").alias("l_note"))


def materialize_arrays_in_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conform(_rowed(nested_customers(spark, sf_dir), "c_nation"), CUSTOMERS, keep=("row_id",))
    back = materialize(shred(rows, CUSTOMERS), CUSTOMERS).select("c_nation", F.posexplode_outer("segments").alias("place", "s"))
    keys = F.coalesce(F.array_join(F.col("s.keys").cast("array<string>"), ","), F.lit(""))
    return back.select("c_nation", F.col("place").cast("long").alias("place"), F.col("s.name").alias("name"), keys.alias("keys"))


def _roundtrip(**options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = shared_path(spark, "roundtrip")
        rows = table(spark, sf_dir, "part")
        schema = Schema({"p_partkey": {"type": "INT64"}, "p_name": {"type": "UTF8"}, "p_brand": {"type": "UTF8"}, "p_retailprice": {"type": "DOUBLE", "optional": True}})
        write(rows.select(*schema.fields), path, schema, **options)
        return open_file(spark, path).cursor().frame

    return run


def stream_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream into Parquet files, and back."""
    kind = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(kind).parquet(f"{sf_dir}/events.parquet*")  # a pattern: the table may be one file
    schema = Schema({"event_id": {"type": "INT64"}, "user_id": {"type": "INT64"}, "event_type": {"type": "UTF8"}, "value": {"type": "DOUBLE"}})
    path, checkpoint = shared_path(spark, "sink"), shared_path(spark, "sink-checkpoint")
    sink(stream, path, schema, checkpoint, compression="SNAPPY", available_now=True).awaitTermination()
    return open_file(spark, path).cursor().frame


def _events(spark: SparkSession, sf_dir: str, **values: Column) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", *[v.alias(k) for k, v in values.items()])


def _converted(kind: str, value: Column, source: T.DataType, result: str = "bigint"):
    """Stored values of a logical type; what it refuses is NULL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _events(spark, sf_dir, v=value)
        return rows.select("event_id", convert.to_primitive(kind, F.col("v"), source, mode=convert.PERMISSIVE).cast(result).alias("stored"))

    return run


#: Factors that spread (value - 100) beyond the bounds of the integer types.
SPREADS = {
    "INT_8": 1.5, "UINT_8": 1.5, "INT_16": 400.0, "UINT_16": 400.0, "INT_32": 2.0e7, "INT32": 2.0e7, "UINT_32": 2.0e7, "INT_64": 1.0e12,
    "INT64": 1.0e12, "UINT_64": 1.0e12, "INT96": 1.0e12, "TIME_MILLIS": 1.0e6, "TIME_MICROS": 1.0e9,
}


def convert_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers at the beginning of text; text without one has none."""
    text = F.when(F.col("event_id") % 5 == 0, F.col("event_type")).otherwise(F.concat(F.lit("  -"), F.col("user_id").cast("string"), F.lit("7e2x")))
    rows = _events(spark, sf_dir, v=text)
    stored = convert.to_primitive("INT64", F.col("v"), T.StringType(), mode=convert.PERMISSIVE)
    return rows.select("event_id", stored.alias("stored"))


def conversion_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir, v=F.col("user_id"))
    return rows.select("event_id", convert.conversion_error("INT_8", F.col("v"), T.LongType()).alias("error"))


def convert_double(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_id") % 7 == 0, F.lit("none")).otherwise(F.concat(F.col("user_id").cast("string"), F.lit(".25e1kg")))
    rows = _events(spark, sf_dir, v=text)
    return rows.select("event_id", convert.to_primitive("DOUBLE", F.col("v"), T.StringType(), mode=convert.PERMISSIVE).alias("stored"))


def convert_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir, n=F.col("event_id") % 3, t=F.when(F.col("event_id") % 2 == 0, F.lit("")).otherwise(F.lit("false")))
    to = lambda c, kind: convert.to_primitive("BOOLEAN", F.col(c), kind)
    return rows.select("event_id", to("n", T.LongType()).alias("of_number"), to("t", T.StringType()).alias("of_text"))


def convert_utf8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir, v=F.concat("event_type", F.lit(" \u00e9")))
    stored = convert.to_primitive("UTF8", F.col("v"), T.StringType())
    return rows.select("event_id", F.hex(stored).alias("stored"), convert.from_primitive("UTF8", stored).alias("text"))


def fixed_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types of five bytes; others are refused."""
    rows = _events(spark, sf_dir, v=F.col("event_type"))
    stored = convert.to_primitive("FIXED_LEN_BYTE_ARRAY", F.col("v"), T.StringType(), 5, convert.PERMISSIVE)
    return rows.select("event_id", F.hex(stored).alias("stored"))


def json_stringify(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = T.StructType([T.StructField("event_type", T.StringType()), T.StructField("user_id", T.LongType())])
    rows = _events(spark, sf_dir, v=F.struct("event_type", "user_id"))
    stored = convert.to_primitive("JSON", F.col("v"), kind)
    return rows.select("event_id", convert.from_primitive("JSON", stored).alias("text"))


def json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir, v=F.col("props"))
    text = convert.from_primitive("JSON", convert.to_primitive("JSON", F.col("v"), T.StringType()))
    return rows.select("event_id", F.get_json_object(text, "$.k").alias("k"))


def bson_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir, v=F.col("props"))
    stored = convert.to_primitive("BSON", F.col("v"), T.StringType())
    return rows.select("event_id", F.hex(stored).alias("stored"), convert.bson.to_json(stored).alias("text"))


def convert_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir, v=F.col("ts"))
    days = convert.to_primitive("DATE", F.col("v"), T.TimestampNTZType())
    return rows.select("event_id", days.cast("long").alias("stored"), convert.from_primitive("DATE", days).cast("string").alias("day"))


def convert_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir, v=F.col("ts"))
    of = {k: convert.to_primitive(k, F.col("v"), T.TimestampNTZType()) for k in ("TIMESTAMP_MILLIS", "TIMESTAMP_MICROS")}
    back = [F.unix_micros(convert.from_primitive(k, c)).alias(f"{k[10:].lower()}_back") for k, c in of.items()]
    return rows.select("event_id", *[c.alias(k[10:].lower()) for k, c in of.items()], *back)


def interval_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals as 12 bytes and back. Parts beyond 32 bits have no such bytes: what the type refuses is NULL."""
    kind = T.StructType([T.StructField(c, T.LongType()) for c in ("months", "days", "milliseconds")])
    parts = F.struct(F.col("user_id").alias("months"), (F.col("event_id") % 31).alias("days"), (F.col("event_id") * 70_000).alias("milliseconds"))
    rows = _events(spark, sf_dir, v=parts)
    stored = convert.to_primitive("INTERVAL", F.col("v"), kind, mode=convert.PERMISSIVE)
    return rows.select("event_id", F.hex(stored).alias("stored"), convert.from_primitive("INTERVAL", stored)["milliseconds"].alias("milliseconds"))


def bit_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, width=convert.bit_width(F.col("event_id")).cast("long"))


def plain_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of PLAIN values of each type, by event type."""
    rows = table(spark, sf_dir, "events").withColumn("flag", F.col("value") > 100)
    of = {"BOOLEAN": "flag", "INT32": "user_id", "INT64": "event_id", "INT96": "event_id", "FLOAT": "value", "DOUBLE": "value", "UTF8": "props"}
    sizes = [encodings.plain_bytes(k, F.sum(encodings.plain_size(k, F.col(c)))).alias(k.lower()) for k, c in of.items()]
    fixed = F.sum(encodings.plain_size("FIXED_LEN_BYTE_ARRAY", F.col("props"), 5)).cast("long").alias("fixed")
    return rows.groupBy("event_type").agg(*sizes, fixed)


def _paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_ordinal(table(spark, sf_dir, "lineitem").select(*TOTAL_ORDER, "l_returnflag"), TOTAL_ORDER, "n")
    return rows.withColumn("page", F.floor(F.col("n") / PAGE_VALUES).cast("long"))


def rle_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encodings.rle_runs(_paged(spark, sf_dir), "l_returnflag", ["page"], ["n"])


def rle_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = encodings.rle_expand(rle_runs(spark, sf_dir), ["page"])
    return values.groupBy("page", "value").agg(F.count(F.lit(1)).alias("n_values"), F.max("run").alias("last_run"))


def plain_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the PLAIN bytes of each page of line numbers."""
    return _digests(encodings.encode_pages(_paged(spark, sf_dir), "INT32", "l_linenumber", "page", "n"))


def _digests(pages: DataFrame) -> DataFrame:
    return pages.select("page", "num_values", F.sha2(F.hex("data").cast("binary"), 256).alias("sha256"))


#: Stored values whose pages of PLAIN bytes are shown, and the length of a fixed one.
PLAIN_VALUES = {
    "BOOLEAN": ("value > 100", None), "INT32": ("cast(user_id - 50 as int)", None), "INT64": ("event_id * -3000000000", None),
    "INT96": ("5 - event_id", None), "FLOAT": ("cast(value as float)", None), "DOUBLE": ("value - 100", None),
    "BYTE_ARRAY": ("cast(props as binary)", None), "FIXED_LEN_BYTE_ARRAY": ("cast(lpad(event_id, 12, '0') as binary)", 12),
}


def _plain_of(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        value, length = PLAIN_VALUES[kind]
        rows = table(spark, sf_dir, "events").select("event_id", F.expr(f"event_id div {PAGE_VALUES}").alias("page"), F.expr(value).alias("v"))
        return _digests(encodings.encode_pages(rows, kind, "v", "page", "event_id", type_length=length))

    return run


def _rle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of runs of 100 values of three bits; the rest of a page may be too short for a run and is bit-packed."""
    value = F.expr(f"n % {PAGE_VALUES} div 100 % 5").cast("long")
    return encodings.encode_pages(_paged(spark, sf_dir).withColumn("v", value), "INT64", "v", "page", "n", "RLE", 3)


def rle_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the RLE bytes of each page, with their length in front."""
    return _digests(_rle(spark, sf_dir))


def rle_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of those bytes again."""
    values = encodings.decode_pages(_rle(spark, sf_dir), "INT64", "long", "RLE", 3)
    return values.groupBy("page", "value").agg(F.count(F.lit(1)).alias("n_values"), F.max("place").alias("last"))


def packed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the RLE bytes of pages without runs: bit-packed groups of eight values."""
    rows = _paged(spark, sf_dir).withColumn("v", (F.col("n") % PAGE_VALUES % 7).cast("long"))
    return _digests(encodings.encode_pages(rows, "INT64", "v", "page", "n", "RLE", 3))


def convert_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = convert.to_primitive("FLOAT", F.col("v"), T.DoubleType(), mode=convert.PERMISSIVE)
    return _events(spark, sf_dir, v=F.col("value") / 3).select("event_id", stored.cast("double").alias("stored"))


def convert_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = convert.to_primitive("BYTE_ARRAY", F.col("v"), T.StringType())
    return _events(spark, sf_dir, v=F.concat("event_type", F.lit(" \u00e9"))).select("event_id", F.hex(stored).alias("stored"))


#: Bytes of a compressed value that its format fixes: first bytes, and the length of the text.
FRAMES = {
    "UNCOMPRESSED": {"head": "packed"}, "GZIP": {"head": "substring(packed, 1, 3)", "size": "substring(packed, -4, 4)"},
    "SNAPPY": {"head": "substring(packed, 1, 1)"}, "BROTLI": {},
}


def _deflated(method: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _events(spark, sf_dir, v=F.concat("props", F.lit(" "), "event_type"))
        rows = rows.withColumn("packed", compression.deflate(method, F.col("v").cast("binary")))
        text = compression.inflate(method, F.col("packed")).cast("string").alias("text")
        return rows.select("event_id", text, *[F.hex(F.expr(v)).alias(k) for k, v in FRAMES[method].items()])

    return run


def conform_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value for a repeated field, an array of one for a single field, and an empty array for none."""
    schema = Schema({"event_id": {"type": "INT64"}, "kinds": {"type": "UTF8", "repeated": True}, "one": {"type": "INT64"}, "none": {"type": "INT64", "repeated": True}})
    none = F.when(F.col("event_id") % 2 == 0, F.array().cast("array<bigint>")).otherwise(F.array("user_id", "event_id"))
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kinds"), F.array("user_id").alias("one"), none.alias("none"))
    found = conform(rows, schema)
    return found.select("event_id", F.array_join("kinds", ",").alias("kinds"), "one", F.coalesce(F.size("none"), F.lit(0)).cast("long").alias("n"), F.col("none").isNull().alias("missing"))


QUERIES = {
    **{f"scan_{t}": _scan(t) for t in TABLES},
    **{f.__name__: f for f in (
        flagship, project_flat, project_nested, row_count, column_value_counts, row_group_layout, footer_values, cursor_page, cursor_rewind,
        nest_items, schema_levels, metadata_roundtrip, shred_required, shred_optional, shred_repeated, shred_arrays_in_arrays,
        materialize_roundtrip, materialize_arrays_in_arrays, stream_sink, convert_text, conversion_errors, convert_double, convert_boolean,
        convert_utf8, fixed_length, json_stringify, json_parse, bson_bytes, convert_date, convert_timestamps, interval_pack, bit_width,
        plain_sizes, rle_runs, rle_expand, plain_pages, rle_pages, rle_decode, packed_pages, conform_shapes, file_encodings, convert_float,
        convert_bytes,
    )},
    "shred_group_required": _shred_items("l_quantity"),
    "shred_group_optional": _shred_items("l_note"),
    **{f"roundtrip_{m.lower()}": _roundtrip(compression=m) for m in ("UNCOMPRESSED", "GZIP", "SNAPPY")},
    "roundtrip_v2": _roundtrip(compression="SNAPPY", page_v2=True),
    "roundtrip_v1": _roundtrip(compression="SNAPPY", page_v2=False, dictionary=False, row_group_size=1000, page_size=4096),
    **{f"plain_{k.lower()}": _plain_of(k) for k in PLAIN_VALUES},
    **{f"deflate_{m.lower()}": _deflated(m) for m in ("UNCOMPRESSED", "GZIP", "SNAPPY", "BROTLI")},
}


def queries() -> dict:
    """All queries. Columns need a session, so conversions by type are made here."""
    of = lambda k, s: lambda spark, sf_dir: _converted(k, (F.col("value") - 100) * s, T.DoubleType())(spark, sf_dir)
    return QUERIES | {f"convert_{k.lower()}": of(k, s) for k, s in SPREADS.items()}


def oracle_sql() -> dict[str, str]:
    return SQL | {"schema_levels": levels_sql(ORDERS)} | {f"convert_{k.lower()}": converted_sql(k, s) for k, s in SPREADS.items()}
