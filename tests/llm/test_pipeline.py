import numpy as np
import pytest

import corpus_pipeline
from lamella.llm import decontaminate, mixing, pii, quality, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of which each stage has something to decide; every case is a clean text but for what is planted."""
    rng = np.random.default_rng(1)
    prose = lambda n: ". ".join(" ".join(f"word{x}" for x in rng.integers(0, 3000, 9)) for _ in range(n))
    place = tmp_path_factory.mktemp("corpus")
    items = [(i, " ".join(f"q{i}x{k}" for k in range(20))) for i in range(4)]
    docs = [(i, prose(8), "en", ["web", "books", "code"][i % 3]) for i in range(200)]
    docs += [(200 + i, "BUY NOW!!! $$$ 100% " * int(rng.integers(8, 20)), "en", "web") for i in range(60)]
    docs += [(300 + i, docs[i][1], "en", "web") for i in range(20)]
    docs += [(330 + i, f"{docs[i][1]} {items[0][1]} {items[1][1]} {prose(9)}", "en", "books") for i in range(3)]
    docs += [(340 + i, f"{prose(8)} {items[i][1]} {prose(8)}", "en", "books") for i in range(4)]
    docs += [(350 + i, f"{prose(7)} mail me{i}@example.org", "en", "code") for i in range(5)] + [(400, None, "en", None), (401, prose(8), None, None)]
    docs = [(d, t, lang, s, len(t or "")) for d, t, lang, s in docs]
    labels = [(d, 0 if 200 <= d < 260 else 1, 0) for d, *_ in docs if d < 300]
    spark.createDataFrame(docs, DOCS).write.parquet(str(place / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(place / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(place / "benchmark.parquet"))
    return str(place)


def test_stages_are_the_ones_asked_for():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near-duplicates", "decontamination", "personal data", "mixing"]


def test_each_stage_against_its_operator(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, made = docs, stage(spark, docs, folder)
        docs = spark.createDataFrame(made.collect(), made.schema)
        seen[name] = (before, docs)
        assert docs.columns[: len(columns)] == columns

    before, after = seen["quality"]
    rules = quality.train(before, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = {r.doc_id for r in quality.score(before, rules).where("predicted = 1").collect()}
    assert {r.doc_id for r in after.collect()} == kept
    assert not kept & set(range(200, 260)) and set(range(200)) <= kept

    before, after = seen["near-duplicates"]
    groups = {}
    for r in simhash.near_duplicates(before).collect():
        groups.setdefault(r.component_id, []).append(r.doc_id)
    assert sorted(r.doc_id for r in after.collect()) == sorted(map(min, groups.values()))
    assert not {r.doc_id for r in after.collect()} & set(range(300, 320))

    before, after = seen["decontamination"]
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    bad = {r.doc_id for r in decontaminate.score(before, items).where("contaminated").collect()}
    assert bad and {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - bad
    assert decontaminate.score(after, items).where("n_hit > 0").count() == 0
    untouched = {r.doc_id for r in decontaminate.score(before, items).where("n_hit = 0").collect()}
    assert {r.doc_id: r.text for r in before.collect() if r.doc_id in untouched} == {r.doc_id: r.text for r in after.collect() if r.doc_id in untouched}

    before, after = seen["personal data"]
    assert sorted(r.doc_id for r in before.collect()) == sorted(r.doc_id for r in after.collect())
    assert pii.find(after).where("n_email > 0").count() == 0
    assert sum("[EMAIL]" in (r.text or "") for r in after.collect()) == 5

    before, after = seen["mixing"]
    taken = {r.doc_id: r.taken for r in mixing.mix(before).collect()}
    words = {}
    for r in after.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len((r.text or "").split())
    assert {d: n for d, n in taken.items() if n} == {d: n for d, n in words.items() if n}
    assert after.columns == [*columns, "copy"]


def test_run_applies_them_all(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    found = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, found.collect())) == sorted(map(str, docs.collect()))
    assert corpus_pipeline.ORACLE_SQL is None
