import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.llm import quality

DOCS, LABELS = "doc_id long, text string, stats string, score int, y int", "doc_id long, quality int, text string"


def corpus(n=400, seed=3):
    rng = np.random.default_rng(seed)
    docs, labels = [], []
    for i in range(n):
        good = bool(i % 3)
        if good:
            text = ". ".join(" ".join(f"word{x}" for x in rng.integers(0, 900, 9)) for _ in range(6))
        else:
            text = " ".join("$$$ BUY NOW!!! 100%".split() * int(rng.integers(4, 12)))
        docs.append((i, text))
        labels.append((i, int(good)))
    return docs, labels


def frames(spark, docs, labels):
    return (
        spark.createDataFrame([(*d, "s", 1, 2) for d in docs], DOCS),
        spark.createDataFrame([(*x, "t") for x in labels], LABELS),
    )


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_held_out_rows_are_told_apart(spark):
    docs, labels = corpus()
    docs += [(1000, None), (1001, ""), (1002, " \n"), (1003, "word " * 200_000), (None, "x y"), (7, docs[7][1])]
    d, lab = frames(spark, docs, labels)
    rules = quality.train(d, lab)
    found = quality.score(d, rules).collect()
    assert len(found) == len(docs)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    assert all(r.held_out == held(r.doc_id) for r in found if r.doc_id is not None)
    truth = dict(labels)
    tested = [r for r in found if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in tested]) > 0.95
    assert len({(r.score) for r in found if r.doc_id == 7}) == 1


def test_the_column_is_the_model(spark):
    docs, labels = corpus(200)
    d, lab = frames(spark, docs, labels)
    rules = quality.train(d, lab)
    assert rules.weighted
    by_column = {r.doc_id: r.score for r in quality.score(d, rules).collect()}
    x = np.array([quality.statistics(t.encode()) for _, t in docs])
    assert np.allclose(rules.score(x), [by_column[i] for i, _ in docs])


def test_learns_from_nothing_else_than_other_rows(spark):
    docs, labels = corpus(200)
    flipped = [(i, 1 - y if held(i) else y) for i, y in labels]
    one, two = (quality.train(*frames(spark, docs, x)) for x in (labels, flipped))
    assert one == two


@pytest.mark.parametrize(
    ("labels", "score"),
    [([], 0.5), ([(None, 1), (2, None), (10_000, 1)], 0.5), ([(i, 1) for i in range(30)], None)],
)
def test_few_labels(spark, labels, score):
    docs, _ = corpus(40)
    d, lab = frames(spark, docs, labels)
    found = {r.score for r in quality.score(d, quality.train(d, lab)).collect()}
    assert len(found) == 1 and (found == {score} or score is None and found.pop() > 0.8)


def test_empty_table_and_repeated_labels(spark):
    docs, labels = corpus(60)
    d, lab = frames(spark, docs, labels + labels + [(1, 1 - dict(labels)[1])])
    rules = quality.train(d, lab)
    assert quality.score(frames(spark, [], [])[0], rules).count() == 0


def test_keeping_the_good(spark):
    docs, labels = corpus(200)
    d, lab = frames(spark, docs, labels)
    clashing = d.withColumn("_statistics", F.lit(1))
    kept = quality.keep_good(clashing, quality.train(d, lab))
    assert kept.columns == clashing.columns
    assert {r.doc_id % 3 > 0 for r in kept.collect()} == {True}
    assert kept.count() == sum(y for _, y in labels)


def test_lasso_drops_useless_rules():
    rng = np.random.default_rng(0)
    z = rng.normal(size=(500, 8))
    y = (z[:, 0] + 0.3 * rng.normal(size=500) > 0).astype(float)
    _, w = quality._lasso(z, y, 0.05)
    assert w[0] > 0.3 and np.count_nonzero(w) <= 3
