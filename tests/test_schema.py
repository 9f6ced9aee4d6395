import pytest

from lamella.operators.schema import Schema, declared, table_metadata

STOCK = {"quantity": {"type": "INT64", "repeated": True}, "warehouse": {"type": "UTF8"}}


def levels(definition):
    return [(".".join(f.path), f.repetition, f.r_max, f.d_max) for f in Schema(definition).field_list]


def test_flat_fields_and_defaults():
    schema = Schema({"name": {"type": "UTF8"}, "quantity": {"type": "INT64", "optional": True}, "colours": {"type": "UTF8", "repeated": True}})
    assert levels(schema.declaration()) == [("name", "REQUIRED", 0, 0), ("quantity", "OPTIONAL", 0, 1), ("colours", "REPEATED", 1, 1)]
    assert {(f.encoding, f.compression) for f in schema.leaves} == {("PLAIN", "UNCOMPRESSED")}


def test_repeated_wins_over_optional_and_counts_once():
    assert levels({"a": {"type": "INT32", "repeated": True, "optional": True}}) == [("a", "REPEATED", 1, 1)]


@pytest.mark.parametrize(
    ("group", "expected"),
    [
        ({}, [("REQUIRED", 0, 0), ("REPEATED", 1, 1), ("REQUIRED", 0, 0)]),
        ({"optional": True}, [("OPTIONAL", 0, 1), ("REPEATED", 1, 2), ("REQUIRED", 0, 1)]),
        ({"repeated": True}, [("REPEATED", 1, 1), ("REPEATED", 2, 2), ("REQUIRED", 1, 1)]),
    ],
)
def test_groups_hand_their_levels_down(group, expected):
    found = levels({"stock": group | {"fields": STOCK}})
    assert [x[1:] for x in found] == expected
    assert [x[0] for x in found] == ["stock", "stock.quantity", "stock.warehouse"]


def test_deep_nesting():
    deep = {"a": {"repeated": True, "fields": {"b": {"optional": True, "fields": {"c": {"repeated": True, "fields": {"d": {"type": "INT32", "optional": True}}}}}}}}
    assert [x[2:] for x in levels(deep)] == [(1, 1), (1, 2), (2, 3), (2, 4)]


def test_definition_stays_and_fields_win_over_type():
    definition = {"a": {"type": "UTF8", "fields": {"b": {"type": "INT32"}}}, "c": {"type": "INT32", "bitWidth": 3}}
    before = repr(definition)
    schema = Schema(definition)
    assert repr(definition) == before
    assert schema.find("a").is_group and schema.find("a").child_count == 1
    assert schema.find("c").type_length == 3


@pytest.mark.parametrize(
    ("options", "message"),
    [({"type": "DECIMAL"}, "invalid type: DECIMAL"), ({}, "invalid type: None"), ({"type": "INT32", "encoding": "DELTA"}, "unsupported encoding: DELTA"), ({"type": "INT32", "compression": "ZSTD"}, "unsupported compression: ZSTD")],
)
def test_refused_definitions(options, message):
    with pytest.raises(ValueError, match=message):
        Schema({"a": options})


def test_paths():
    schema = Schema({"name": {"type": "UTF8"}, "stock": {"repeated": True, "fields": STOCK}})
    for path in ("stock.warehouse", "stock,warehouse", ["stock", "warehouse"]):
        assert schema.find(path).path == ("stock", "warehouse")
    assert [f.name for f in schema.find_branch(["stock", "quantity"])] == ["stock", "quantity"]
    with pytest.raises(KeyError, match="no such field: stock.colour"):
        schema.find("stock.colour")


def test_selection_keeps_shape_and_order():
    schema = Schema({"name": {"type": "UTF8"}, "stock": {"repeated": True, "fields": STOCK}, "price": {"type": "DOUBLE"}})
    assert [".".join(f.path) for f in schema.select(["price", ["stock", "warehouse"]]).field_list] == ["stock", "stock.warehouse", "price"]
    assert schema.select(None) is schema and schema.select(["stock"]).find("stock.quantity").r_max == 2
    with pytest.raises(KeyError):
        schema.select(["colour"])


def test_spark_schema_declares_itself_again():
    schema = Schema({
        "name": {"type": "UTF8"}, "day": {"type": "DATE", "optional": True}, "u": {"type": "UINT_64"}, "f": {"type": "FIXED_LEN_BYTE_ARRAY", "typeLength": 5},
        "i": {"type": "INTERVAL"}, "stock": {"repeated": True, "fields": STOCK},
    })
    made = schema.spark({"a": 1})
    assert made["stock"].dataType.simpleString() == "array<struct<quantity:array<bigint>,warehouse:string>>"
    assert Schema(declared(made)) == schema
    assert table_metadata(made) == {"a": "1"}
    assert table_metadata(schema.spark()) == {}


def test_levels_as_rows(spark):
    rows = Schema({"stock": {"repeated": True, "fields": STOCK}}).levels(spark).orderBy("ord").collect()
    assert [(r.path, r.r_max, r.d_max, r.child_count) for r in rows] == [("stock", 1, 1, 2), ("stock.quantity", 2, 2, 0), ("stock.warehouse", 1, 1, 0)]
