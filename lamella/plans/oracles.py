"""SQL twins of the registered queries, over the same tables."""

from __future__ import annotations

from lamella.functions.logical import logical
from lamella.operators.schema import Schema

_TOTAL = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
_NUMBERED = f"SELECT *, row_number() OVER (ORDER BY {_TOTAL}) - 1 AS n FROM lineitem"
_ITEMS = f"""SELECT o_orderkey, o_orderpriority, l_linenumber, l_quantity, CASE WHEN l_suppkey % 3 = 0 THEN l_returnflag END AS l_note,
  coalesce(row_number() OVER (PARTITION BY o_orderkey ORDER BY {_TOTAL}) - 1, 0) AS p, l_orderkey
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey"""
_KEYS = """SELECT c_nationkey::BIGINT AS c_nation, c_mktsegment AS name, list(c_custkey ORDER BY c_custkey) FILTER (c_acctbal >= 0) AS keys,
  row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) - 1 AS p FROM customer GROUP BY c_nationkey, c_mktsegment"""


def _little(number: str) -> str:
    """Hexadecimal digits of four little-endian bytes."""
    digits = f"printf('%08X', {number})"
    return " || ".join(f"substr({digits}, {i}, 2)" for i in (7, 5, 3, 1))


def _reversed(digits: str, size: int) -> str:
    """Hexadecimal digits of size bytes, last byte first."""
    return " || ".join(f"substr({digits}, {2 * i + 1}, 2)" for i in reversed(range(size)))


def _varint(number: str) -> str:
    """Hexadecimal digits of a number below 2^14 in groups of seven bits."""
    number = f"({number})"
    return f"CASE WHEN {number} < 128 THEN printf('%02X', {number}) ELSE printf('%02X', {number} % 128 + 128) || printf('%02X', {number} // 128) END"


def _plain_sql(value: str) -> str:
    return f"""SELECT event_id // 8192 AS page, count(*) AS num_values, sha256(string_agg({value}, '' ORDER BY event_id)) AS sha256
FROM events GROUP BY 1"""


def converted_sql(kind: str, spread: float) -> str:
    of = logical(kind)
    return f"""SELECT event_id, CASE WHEN trunc(v) BETWEEN {of.low} AND {of.high} THEN trunc(v)::BIGINT END AS stored
FROM (SELECT event_id, (value - 100) * {spread!r}::DOUBLE AS v FROM events)"""


def levels_sql(schema: Schema) -> str:
    """The levels by their definition: of the repeated, and of the optional or repeated, fields of each path."""
    repeats = {f.path: f.repetition for f in schema.field_list}
    rows = []
    for i, f in enumerate(schema.field_list):
        path = [repeats[f.path[:k]] for k in range(1, len(f.path) + 1)]
        r, d = path.count("REPEATED"), len(path) - path.count("REQUIRED")
        rows.append(f"({i}, '{'.'.join(f.path)}', '{f.repetition}', {r}, {d})")
    return f"SELECT ord::BIGINT AS ord, path, repetition, r_max::BIGINT AS r_max, d_max::BIGINT AS d_max FROM (VALUES {', '.join(rows)}) AS t(ord, path, repetition, r_max, d_max)"


def _shred_items(value: str, most: int) -> str:
    return f"""SELECT o_orderkey, p::VARCHAR AS place, CASE WHEN p > 0 THEN 1 ELSE 0 END::BIGINT AS r,
  CASE WHEN l_orderkey IS NULL THEN 0 WHEN {value} IS NULL THEN 1 ELSE {most} END::BIGINT AS d, {value} AS value FROM ({_ITEMS})"""


_PART = "SELECT p_partkey, p_name, p_brand, p_retailprice FROM part"
_DEFLATED = "SELECT event_id, props || ' ' || event_type AS text FROM events"

SQL: dict[str, str] = {
    **{f"scan_{t}": f"SELECT * FROM {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")},
    "flagship": "SELECT o_orderkey, l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey",
    "project_flat": "SELECT o_orderkey, o_orderpriority FROM orders",
    "project_nested": "SELECT o_orderkey, l_linenumber::BIGINT AS l_linenumber FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey",
    "row_count": " UNION ALL ".join(
        f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
    ),
    "column_value_counts": """SELECT 'vec_id' AS path, count(*) AS num_values FROM embeddings
UNION ALL SELECT 'embedding', sum(greatest(len(embedding), 1))::BIGINT FROM embeddings""",
    "row_group_layout": f"SELECT n // 4096 AS row_group, count(*) AS n_rows, sum(l_linenumber)::BIGINT AS lines FROM ({_NUMBERED}) GROUP BY 1",
    "footer_values": """SELECT unnest(['o_orderkey', 'o_orderpriority']) AS "column", n AS n_rows, 0::BIGINT AS n_odd FROM (SELECT count(*) AS n FROM orders)""",
    "file_encodings": """SELECT way, c AS "column", codec, CASE WHEN way <> 'v2' THEN 'PLAIN' WHEN c = 'p_partkey' THEN 'DELTA_BINARY_PACKED' ELSE 'DELTA_BYTE_ARRAY' END AS encoding, n AS num_values
  FROM (VALUES ('v1', 'GZIP'), ('v2', 'SNAPPY'), ('none', 'UNCOMPRESSED')) AS w(way, codec), (VALUES ('p_partkey'), ('p_name')) AS k(c), (SELECT count(*) AS n FROM part)""",
    "cursor_page": "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100",
    "cursor_rewind": "SELECT r_regionkey::BIGINT AS r_regionkey, r_name, true AS same FROM region",
    "nest_items": f"""SELECT o_orderkey, coalesce(string_agg(CASE WHEN l_orderkey IS NOT NULL THEN
  l_linenumber || ':' || l_quantity::INT || ':' || coalesce(l_note, '') END, ',' ORDER BY p), '') AS items FROM ({_ITEMS}) GROUP BY o_orderkey""",
    "metadata_roundtrip": "SELECT * FROM (VALUES ('fnord', 'dronf'), ('myuid', '420')) AS t(key, value)",
    "shred_required": "SELECT c_custkey, '' AS place, 0::BIGINT AS r, 0::BIGINT AS d, c_mktsegment AS value FROM customer",
    "shred_optional": """SELECT o_orderkey, '' AS place, 0::BIGINT AS r, CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END::BIGINT AS d,
  nullif(o_orderpriority, '1-URGENT') AS value FROM orders""",
    "shred_repeated": """SELECT vec_id, (i - 1)::VARCHAR AS place, CASE WHEN i > 1 THEN 1 ELSE 0 END::BIGINT AS r, 1::BIGINT AS d,
  round(v::DOUBLE * 10000)::BIGINT AS value FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)""",
    "shred_group_required": _shred_items("l_quantity::INT::VARCHAR", 1),
    "shred_group_optional": _shred_items("l_note", 2),
    "shred_arrays_in_arrays": f"""SELECT c_nation, p || ',' || i AS place, CASE WHEN i > 0 THEN 2 WHEN p > 0 THEN 1 ELSE 0 END::BIGINT AS r,
  CASE WHEN k IS NULL THEN 1 ELSE 2 END::BIGINT AS d, k::VARCHAR AS value
  FROM (SELECT c_nation, p, unnest(coalesce(keys, [NULL])) AS k, unnest(range(len(coalesce(keys, [NULL])))) AS i FROM ({_KEYS}))""",
    "materialize_roundtrip": f"SELECT o_orderkey, o_orderpriority, p::BIGINT AS place, l_linenumber::BIGINT AS l_linenumber, l_quantity, l_note FROM ({_ITEMS})",
    "materialize_arrays_in_arrays": f"SELECT c_nation, p AS place, name, coalesce(array_to_string(keys, ','), '') AS keys FROM ({_KEYS})",
    "stream_sink": "SELECT event_id, user_id, event_type, value FROM events",
    "convert_text": """SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN -(user_id || '7')::BIGINT END AS stored FROM events""",
    "conversion_errors": """SELECT event_id, CASE WHEN user_id NOT BETWEEN -128 AND 127 THEN 'invalid value for INT_8: ' || user_id END AS error FROM events""",
    "convert_double": "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN (user_id || '.25e1')::DOUBLE END AS stored FROM events",
    "convert_boolean": "SELECT event_id, event_id % 3 <> 0 AS of_number, event_id % 2 <> 0 AS of_text FROM events",
    "convert_utf8": "SELECT event_id, hex(encode(event_type || ' é')) AS stored, event_type || ' é' AS text FROM events",
    "fixed_length": "SELECT event_id, CASE WHEN strlen(event_type) = 5 THEN hex(encode(event_type)) END AS stored FROM events",
    "json_stringify": "SELECT event_id, to_json({'event_type': event_type, 'user_id': user_id})::VARCHAR AS text FROM events",
    "json_parse": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    "bson_bytes": f"""SELECT event_id, '0C000000106B00' || {_little("k")} || '00' AS stored, replace(props, ' ', '') AS text
  FROM (SELECT event_id, props, json_extract_string(props, '$.k')::INT AS k FROM events)""",
    "convert_date": "SELECT event_id, (ts::DATE - DATE '1970-01-01')::BIGINT AS stored, ts::DATE::VARCHAR AS day FROM events",
    "convert_timestamps": """SELECT event_id, epoch_us(ts) // 1000 AS millis, epoch_us(ts) AS micros, epoch_us(ts) // 1000 * 1000 AS millis_back,
  epoch_us(ts) AS micros_back FROM events""",
    "interval_pack": f"""SELECT event_id, {_little("user_id")} || {_little("event_id % 31")} || {_little("event_id * 70000")} AS stored,
  event_id * 70000 AS milliseconds FROM events""",
    "bit_width": "SELECT event_id, CASE WHEN event_id = 0 THEN 0 ELSE length(bin(event_id)) END::BIGINT AS width FROM events",
    "plain_sizes": """SELECT event_type, ceil(count(*) / 8)::BIGINT AS boolean, 4 * count(*) AS int32, 8 * count(*) AS int64, 12 * count(*) AS int96,
  4 * count(*) AS float, 8 * count(*) AS double, sum(4 + strlen(props))::BIGINT AS utf8, 5 * count(*) AS fixed FROM events GROUP BY event_type""",
    "rle_runs": f"""SELECT page, run, any_value(l_returnflag) AS value, count(*) AS run_length FROM (
  SELECT page, l_returnflag, (sum(new) OVER (PARTITION BY page ORDER BY n))::BIGINT - 1 AS run FROM (
    SELECT *, CASE WHEN lag(l_returnflag) OVER (PARTITION BY page ORDER BY n) = l_returnflag THEN 0 ELSE 1 END AS new
    FROM (SELECT *, n // 8192 AS page FROM ({_NUMBERED})))) GROUP BY page, run""",
    "plain_pages": f"""SELECT n // 8192 AS page, count(*) AS num_values, sha256(string_agg({_little("l_linenumber")}, '' ORDER BY n)) AS sha256
  FROM ({_NUMBERED}) GROUP BY 1""",
    "conform_shapes": """SELECT event_id, event_type AS kinds, user_id AS one, CASE WHEN event_id % 2 = 0 THEN 0 ELSE 2 END::BIGINT AS n,
  event_id % 2 = 0 AS missing FROM events""",
    **{f"roundtrip_{m}": _PART for m in ("uncompressed", "gzip", "snappy", "v1", "v2")},
    "convert_float": "SELECT event_id, (value / 3)::FLOAT::DOUBLE AS stored FROM events",
    "convert_bytes": "SELECT event_id, hex(encode(event_type || ' é')) AS stored FROM events",
    "plain_boolean": f"""SELECT page, sum(c)::BIGINT AS num_values, sha256(string_agg(printf('%02X', byte), '' ORDER BY g)) AS sha256 FROM (
  SELECT event_id // 8192 AS page, (event_id - f) // 8 AS g, count(*) AS c, sum(CASE WHEN value > 100 THEN 1 << ((event_id - f) % 8) ELSE 0 END)::BIGINT AS byte
  FROM (SELECT *, min(event_id) OVER (PARTITION BY event_id // 8192) AS f FROM events) GROUP BY ALL) GROUP BY page""",
    "plain_int32": _plain_sql(_reversed("right(printf('%016X', (user_id - 50)::BIGINT), 8)", 4)),
    "plain_int64": _plain_sql(_reversed("printf('%016X', event_id * -3000000000)", 8)),
    "plain_int96": _plain_sql(_reversed("printf('%016X', 5 - event_id)", 8) + " || CASE WHEN event_id > 5 THEN 'FFFFFFFF' ELSE '00000000' END"),
    "plain_float": _plain_sql(_reversed("printf('%08X', value::FLOAT::BIT::INT)", 4)),
    "plain_double": _plain_sql(_reversed("printf('%016X', (value - 100)::BIT::BIGINT)", 8)),
    "plain_byte_array": _plain_sql(f"{_little('strlen(props)')} || hex(encode(props))"),
    "plain_fixed_len_byte_array": _plain_sql("hex(encode(lpad(event_id::VARCHAR, 12, '0')))"),
    "rle_pages": f"""SELECT page, sum(c)::BIGINT AS num_values, sha256(any_value({_little("total")}) || string_agg(piece, '' ORDER BY run)) AS sha256 FROM (
  SELECT *, (sum(length(piece)) OVER (PARTITION BY page) // 2)::BIGINT AS total FROM (
    SELECT page, run, c, CASE WHEN c >= 8 THEN {_varint("2 * c")} || printf('%02X', run % 5) ELSE '03' || {_reversed("printf('%06X', packed)", 3)} END AS piece FROM (
      SELECT n // 8192 AS page, n % 8192 // 100 AS run, count(*) AS c, sum((n % 8192 // 100 % 5) << (3 * (n % 8192 % 100 % 8)))::BIGINT AS packed
      FROM ({_NUMBERED}) GROUP BY 1, 2))) GROUP BY page""",
    "rle_decode": f"""SELECT n // 8192 AS page, n % 8192 // 100 % 5 AS value, count(*) AS n_values, max(n % 8192) AS last FROM ({_NUMBERED}) GROUP BY 1, 2""",
    "packed_pages": f"""SELECT page, sum(c)::BIGINT AS num_values, sha256(any_value({_little("groups * 3 + CASE WHEN groups < 64 THEN 1 ELSE 2 END")}) || any_value({_varint("2 * groups + 1")}) || string_agg({_reversed("printf('%06X', packed)", 3)}, '' ORDER BY g)) AS sha256 FROM (
  SELECT *, count(*) OVER (PARTITION BY page) AS groups FROM (
    SELECT n // 8192 AS page, n % 8192 // 8 AS g, count(*) AS c, sum((n % 8192 % 7) << (3 * (n % 8)))::BIGINT AS packed FROM ({_NUMBERED}) GROUP BY 1, 2)) GROUP BY page""",
    "deflate_uncompressed": f"SELECT *, hex(encode(text)) AS head FROM ({_DEFLATED})",
    "deflate_gzip": f"SELECT *, '1F8B08' AS head, {_little('strlen(text)')} AS size FROM ({_DEFLATED})",
    "deflate_snappy": f"SELECT *, printf('%02X', strlen(text)) AS head FROM ({_DEFLATED})",
    "deflate_brotli": _DEFLATED,
}
SQL["rle_expand"] = f"SELECT page, value, sum(run_length)::BIGINT AS n_values, max(run) AS last_run FROM ({SQL['rle_runs']}) GROUP BY page, value"
