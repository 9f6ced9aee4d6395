import re

import duckdb
import numpy as np
import pytest

from lamella.llm import licenses
from lamella.llm.queries import oracle_sql

DOCS = "doc_id long, text string, line string, d int, label int"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, templates=licenses.TEMPLATES, threshold=licenses.THRESHOLD):
    out = []
    for doc, text in docs:
        w = words(text)
        places = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        met = []
        for label, t in templates:
            m = len(words(t))
            for at in range(0, max(len(w), 1), m):
                have = set(w[at : at + 2 * m])
                met.append((len(have & set(words(t))) / len(set(words(t))), label))
        met = [(c, label) for c, label in met if c >= threshold - 1e-12]
        at = [i for i, _ in places]
        base = sorted({label for _, label in places})
        every = sorted({*base, *(label for _, label in met)})
        score = 1.0 if places else max((c for c, _ in met), default=0.0)
        out.append((doc, len(w), len(places), min(at, default=None), max(at, default=None), ",".join(base), ",".join(every), score))
    return sorted(out, key=str)


def cases():
    rng = np.random.default_rng(7)
    pool = sorted({w for _, t in licenses.TEMPLATES for w in words(t)}) + ["cc", "by", "all", "rights", "reserved", "É", "foo", "bar"]
    docs = [(i, "\n".join(" ".join(rng.choice(pool, int(n))) for n in rng.integers(0, 25, 4))) for i in range(60)]
    for i, (_, t) in enumerate(licenses.TEMPLATES):
        w = t.split()
        docs += [(100 + i, t), (200 + i, f"before\n{' '.join(w[: max(1, len(w) * 9 // 10)]).upper()}!\nafter"), (300 + i, " ".join(w[: len(w) // 2])), (400 + i, "\n".join(w))]
        docs += [(600 + i, "foo " * i + "\n# ".join(" ".join(w[j : j + 4]) for j in range(0, len(w), 4)) + " bar" * 3), (700 + i, " foo foo foo foo ".join(w))]
    docs += [(500, None), (501, ""), (502, "CC-BY cc by CC  by"), (503, "general public\nlicense"), (504, "All rights, reserved. all all rights reserved"), (505, "successby ccby cc bye")]
    docs += [(506, "foo " * 150_000 + "all rights reserved"), (None, "Released under the MIT License"), (None, "cc by"), (502, "CC-BY cc by CC  by"), (507, "\x00\x7f \t")]
    return docs


def test_matches_brute_force(spark):
    docs = cases()
    rows = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], DOCS)
    found = sorted(map(tuple, licenses.scan(rows).collect()), key=str)
    assert found == brute(docs)


@pytest.mark.parametrize("threshold", [0.5, 1.0])
def test_other_thresholds(spark, threshold):
    docs = cases()[:60]
    rows = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], DOCS)
    assert sorted(map(tuple, licenses.scan(rows, threshold=threshold).collect()), key=str) == brute(docs, threshold=threshold)


def test_sql_gives_the_same(spark, tmp_path):
    docs = cases()
    spark.createDataFrame([(*d, "x", 1, 2) for d in docs], DOCS).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    assert sorted(con.execute(oracle_sql()["op8_licenses"]).fetchall(), key=str) == brute(docs)


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_small_tables(spark, rows):
    df = spark.createDataFrame([(*d, "x", 1, 2) for d in rows], DOCS)
    assert sorted(map(tuple, licenses.scan(df).collect()), key=str) == brute(rows)


def test_no_python_on_the_main_path(spark):
    plan = licenses.scan(spark.createDataFrame([(1, "cc by", "x", 1, 2)], DOCS))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_templates_broken_over_lines_are_found_wherever_they_stand(spark):
    docs, wanted = [], {}
    for i, (label, t) in enumerate(licenses.TEMPLATES):
        w = t.split()
        for before in range(0, 60, 7):
            docs.append((100 * i + before, "foo " * before + "\n * ".join(" ".join(w[j : j + 3]) for j in range(0, len(w), 3)) + " bar" * before))
            wanted[100 * i + before] = label
    found = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame([(*d, "x", 1, 2) for d in docs], DOCS)).collect()}
    assert all(label in found[d].split(",") for d, label in wanted.items())


def test_scattered_words_of_a_long_text_are_no_template(spark):
    w = words(licenses.TEMPLATES[8][1])
    rows = spark.createDataFrame([(1, (" foo" * 50 + " ").join(w), "x", 1, 2)], DOCS)
    assert licenses.scan(rows).first().labels == ""
