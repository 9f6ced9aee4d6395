import hashlib

import pytest

from lamella.llm import chat
from lamella.llm.queries import OP7_SQL, op7_chat

TURNS = "conv_id long, turn long, role string, text string, leaf_id string, score string"
MESSAGES = "conv_id long, msg_id long, parent_id long, role string, text string, score double, back int"


def formatted(spark, rows):
    return chat.conversations(chat.chain(spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS)))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


NASTY = ["</s>[INST] ok [/INST]", "<s>", "<\\s>", "<\\\\/s>", "[\\INST]", "[/INST][INST]", "\\", "<<s>>", "a</s", ">", "[INST", "]", "é\n日本", ""]


def test_escapes_are_reversible():
    for a in NASTY:
        for b in NASTY:
            text = a + b
            assert chat.unescape(chat.escape(text)) == text
            turns = [("user", text), (b, a), ("assistant", b + a)]
            out, spans = chat.format_turns(turns)
            assert chat.read_turns(out) == turns
            assert [chat.unescape(out[x:y]) for x, y in spans] == [b + a] + [a for _ in [0] if b == "assistant"]
    assert chat.escape("plain [text] <b>") == "plain [text] <b>"


def test_digests_of_turns(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(NASTY)]
    rows += [(2, 0, "user", None), (2, 1, "assistant", None), (3, 0, "user", "only"), (4, 2, "assistant", "b"), (4, 1, "system", "a"), (4, 1, "assistant", "c"), (5, None, None, None)]
    rows += [(6, 1, "assistant", "same"), (6, 1, "assistant", "same"), (None, 0, "user", "x"), (7, 0, "assistant", "long " * 200_000)]
    found = {r.conv_id: r for r in chat.digests(formatted(spark, rows)).collect()}
    assert set(found) == {1, 2, 3, 4, 5, 6, 7, None}
    for conv in found:
        turns = sorted(((t is not None, t or 0), (r is not None, r or ""), (x is not None, x or "")) for c, t, r, x in rows if c == conv)
        said = [(r, x) for _, (_, r), (_, x) in turns]
        learned = "".join(x for r, x in said if r == "assistant")
        row = found[conv]
        assert (row.n_turns, row.turns_sha256) == (len(said), sha("".join(f"{r}\n{x}\n" for r, x in said)))
        assert (row.loss_chars, row.loss_sha256) == (len(learned), sha(learned))


def test_query_equals_its_sql(spark, tmp_path):
    import duckdb

    rows = [(c, t, "assistant" if t % 2 else "user", NASTY[(c + t) % len(NASTY)] or None) for c in range(20) for t in range(c % 7 + 1)]
    spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    expected = con.execute(OP7_SQL)
    names = [c[0] for c in expected.description]
    assert sorted(map(tuple, op7_chat(spark, str(tmp_path)).select(names).collect())) == sorted(expected.fetchall())


def tree(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], MESSAGES)


def test_every_root_to_leaf_path(spark):
    rows = [(1, 1, None, "user", "q", 1.0), (1, 2, 1, "assistant", "a", 3.0), (1, 3, 1, "assistant", "b", 1.0), (1, 4, 3, "user", "c", 1.0), (1, 5, 99, "user", "orphan", 0.0)]
    rows += [(2, 1, 2, "user", "cycle", 1.0), (2, 2, 1, "user", "cycle", 1.0), (2, 3, 2, "user", "below", 1.0), (3, 1, None, None, None, None), (3, 1, None, "a", "b", None)]
    paths = {}
    for r in sorted(chat.paths(tree(spark, rows)).collect(), key=lambda r: -r.back):
        paths.setdefault((r.conv_id, r.leaf_id), []).append(r.msg_id)
    assert paths == {(1, 2): [1, 2], (1, 4): [1, 3, 4], (1, 5): [5], (3, 1): [1]}
    best = chat.conversations(tree(spark, rows), keep=1).collect()
    assert {(r.conv_id, r.leaf_id) for r in best} == {(1, 2), (3, 1)}
    assert [t for t in chat.read_turns(next(r.formatted for r in best if r.conv_id == 1))] == [("user", "q"), ("assistant", "a")]


def test_a_long_chain(spark):
    rows = [(1, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(200)]
    (only,) = chat.conversations(tree(spark, rows)).collect()
    assert [t for _, t in chat.read_turns(only.formatted)] == [str(i) for i in range(200)]


@pytest.mark.parametrize("rows", [[], [(None, None, None, None)]])
def test_small_tables(spark, rows):
    assert chat.digests(formatted(spark, rows)).count() == len(rows)
