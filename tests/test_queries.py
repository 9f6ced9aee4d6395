import math

import duckdb
import pytest

from lamella.plans import catalog

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in (*catalog.TABLES, "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    value = lambda v: repr(round(v, 9)) if isinstance(v, float) and not math.isnan(v) else str(v)
    return [columns[i] for i in order], sorted(tuple(value(r[i]) for i in order) for r in rows)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    found = duck.execute(SQL[name])
    assert plain(df.columns, [tuple(r) for r in df.collect()]) == plain([c[0] for c in found.description], found.fetchall())


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["o_orderkey", "l_quantity"] and df.count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())


def test_intervals_beyond_32_bits_do_not_end_the_query(spark, tmp_path):
    last = (2**32 - 1) // 70_000
    rows = spark.createDataFrame([(last, 7), (last + 1, 7)], "event_id long, user_id long")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    found = {r.event_id: (r.stored, r.milliseconds) for r in QUERIES["interval_pack"](spark, str(tmp_path)).collect()}
    low = (last * 70_000).to_bytes(4, "little").hex().upper()
    assert found == {last: (f"07000000{last % 31:02X}000000{low}", last * 70_000), last + 1: (None, None)}
