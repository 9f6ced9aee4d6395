import re

import duckdb
import numpy as np
import pytest

from lamella.llm import mixing
from lamella.llm.queries import oracle_sql

DOCS = "doc_id long, text string, source string, copy int, size string, target int"


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def shares(sizes):
    """Targets by sharing again until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        left = [s for s in order if s not in capped]
        rest, all_weight = total - sum(capped.values()), sum(weight[s] for s in left)
        found = {s: rest * weight[s] / all_weight for s in left}
        above = [s for s in left if found[s] >= 2 * sizes[s]]
        if not above:
            return capped | found
        capped |= {s: 2.0 * sizes[s] for s in above}


def corpus(n=1500, seed=2, hot=0.6):
    rng = np.random.default_rng(seed)
    names = ["web", "books", "code", "wiki", "Ü", None]
    rows = []
    for i in range(n):
        source = "web" if rng.random() < hot else names[rng.integers(len(names))]
        rows.append((i, " ".join(["word"] * int(rng.integers(0, 60))), source))
    return rows + [(n, None, "web"), (n + 1, "", None), (n + 2, " \t\n", "books"), (n + 3, "x " * 30_000, "code"), (5, "same row", "wiki"), (5, "same row", "wiki"), (None, "no id", "wiki"), (n + 4, "\x1c a b", "wiki")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "s", 2) for r in rows], DOCS)


def test_the_mix_meets_its_targets(spark):
    rows = corpus()
    found = mixing.mix(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    sizes, taken, largest = {}, {}, {}
    by_id = {(d, size(t)): s for d, t, s in rows}
    for d, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
        largest[s] = max(largest.get(s, 0), size(t))
    targets = shares(sizes)
    for r in found:
        s = by_id[r.doc_id, r.size]
        assert r.source_size == sizes[s] and np.isclose(r.target, targets[s])
        assert r.size == 0 and r.taken == 0 or r.taken % r.size == 0 and 0 <= r.taken <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    for s, target in targets.items():
        assert abs(taken[s] - target) <= max(largest[s], 1)
    assert sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_reruns_agree_and_order_does_not_matter(spark):
    rows = corpus(400)
    one = sorted(map(str, mixing.mix(frame(spark, rows)).collect()))
    two = sorted(map(str, mixing.mix(frame(spark, rows[::-1]).repartition(7)).collect()))
    assert one == two


@pytest.mark.parametrize("bucket_rows", [1, 64, 100_000])
def test_buckets_do_not_change_where_the_budget_ends(spark, monkeypatch, bucket_rows):
    rows = corpus(300)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket_rows)
    found = mixing.mix(frame(spark, rows)).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    total = sum(r.taken for r in found)
    assert abs(total - sum(shares(sizes).values())) <= 60 * len(sizes) + 30_000


def test_sql_gives_the_same(spark, tmp_path):
    rows = corpus(800)
    frame(spark, rows).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    found = [(r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.mix(frame(spark, rows)).collect()]
    twin = [(a, b, c, round(d, 6), e) for a, b, c, d, e in con.execute(oracle_sql()["op9_mix"]).fetchall()]
    assert sorted(found, key=str) == sorted(twin, key=str)


def test_the_sample_holds_what_the_mix_takes(spark):
    rows = corpus(500)
    docs = frame(spark, rows)
    sample = mixing.sample(docs)
    assert sample.columns == [*docs.columns, "copy_"]
    words = sum(size(r.text) for r in sample.select("text").collect())
    assert words == sum(r.taken for r in mixing.mix(docs).collect())


def test_copies_of_empty_documents(spark):
    """A source that is taken CAP times, one that is taken in part, and one without a word."""
    rows = [(i, "" if i % 2 else "a word or two", "large") for i in range(400)] + [(1000 + i, None if i % 2 else "word", "small") for i in range(40)]
    rows += [(2000 + i, "", "void") for i in range(20)]
    docs = frame(spark, rows)
    copies = {i: 0 for i, _, _ in rows}
    for r in mixing.sample(docs).select("doc_id", "copy_").collect():
        copies[r.doc_id] += 1
    plan = {r.doc_id: r for r in mixing.mix(docs).collect()}
    for i, text, source in rows:
        r = plan[i]
        epochs = int(r.target // r.source_size) if r.source_size else 0
        rest = r.target - epochs * r.source_size
        assert r.taken == copies[i] * r.size
        assert copies[i] in ((0,) if source == "void" else (epochs, epochs + 1) if rest > 0 else (epochs,))
        assert copies[i] <= mixing.CAP
    assert {copies[1000 + i] for i in range(40)} == {2} and {copies[i] for i in range(1, 400, 2)} == {1, 2}


def test_sources_beyond_the_broadcast_are_salted(spark, monkeypatch):
    rows = corpus(300)
    expected = sorted(map(str, mixing.mix(frame(spark, rows)).collect()))
    sample = sorted(map(str, mixing.sample(frame(spark, rows)).collect()))
    monkeypatch.setattr(mixing._lookup, "__defaults__", (0,))
    assert sorted(map(str, mixing.mix(frame(spark, rows)).collect())) == expected
    assert sorted(map(str, mixing.sample(frame(spark, rows)).collect())) == sample


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "one", "a")], [(1, "", "a"), (2, None, "b")]])
def test_small_tables(spark, rows):
    found = mixing.mix(frame(spark, rows)).collect()
    assert len(found) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in found)
    assert mixing.sample(frame(spark, rows)).count() >= 0


def test_quality_weights_make_good_documents_likelier(spark):
    rows = [(i, "good words of usual length here " * 5 if i % 2 else "a " * 30, "s" if i < 1500 else "t") for i in range(2000)]
    taken = {r.doc_id: r.taken / r.size for r in mixing.mix(frame(spark, rows)).collect()}
    part = [i for i in taken if 1 < len({taken[j] for j in taken if (j < 1500) == (i < 1500)})]
    good, bad = (np.mean([taken[i] for i in part if i % 2 == k]) for k in (1, 0))
    assert good > bad
    assert not re.search("Python|Pandas|Arrow", mixing.mix(frame(spark, rows))._jdf.queryExecution().executedPlan().toString())
