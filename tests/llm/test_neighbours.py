import numpy as np
import pytest

from lamella.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, score string, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "s", 0) for i, v in rows], SCHEMA)


def brute(rows, queries, k=10):
    def fine(v):
        return v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(c != 0 for c in v)

    sizes = [len(v) for i, v in rows if i is not None and fine(v)]
    dims = min(set(sizes), key=lambda n: (-sizes.count(n), n)) if sizes else 0
    good = sorted({(i, tuple(np.float32(v).astype(float))) for i, v in rows if i is not None and fine(v) and len(v) == dims})
    out = []
    for q, v in good:
        if q in queries:
            best = {}
            for i, x in good:
                if i != q:
                    d = float(np.sqrt(((np.array(x) - np.array(v)) ** 2).sum()))
                    best[i] = min(d, best.get(i, d))
            out += [(q, r, i, d) for r, (i, d) in enumerate(sorted(best.items(), key=lambda e: (e[1], e[0]))[:k], 1)]
    return out


def clusters(n, dims=12, seed=5, spread=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, dims))
    return [(i, (centres[rng.integers(30)] + spread * rng.normal(size=dims)).astype(np.float32).tolist()) for i in range(n)]


def searched(spark, rows, every=100, **options):
    vectors = frame(spark, rows)
    return neighbours.search(vectors, vectors.where(f"vec_id % {every} = 0"), **options).collect()


def same(found, expected):
    assert sorted((r.query_id, r.rank, r.vec_id) for r in found) == [e[:3] for e in sorted(expected)]
    assert np.allclose([r.score for r in sorted(found, key=lambda r: (r.query_id, r.rank))], [e[3] for e in sorted(expected)], rtol=0, atol=1e-12)


def test_small_tables_are_exact(spark):
    rows = clusters(120)
    same(searched(spark, rows, every=10), brute(rows, {i for i, _ in rows if i % 10 == 0}))


def test_refused_vectors_ties_and_repeats(spark):
    rows = clusters(40, dims=3)
    one = [1.0, 0.0, 0.0]
    rows += [(100, one), (101, one), (102, one), (103, [0.0, 1.0, 0.0]), (104, [0.0, -1.0, 0.0]), (100, one), (101, one)]
    rows += [(200, None), (201, [0.0] * 3), (202, [1.0, None, 0.0]), (203, [float("nan"), 0.0, 1.0]), (204, [float("inf"), 0.0, 1.0]), (205, []), (300, [1.0]), (None, one), (400, [-0.0, 1.0, 0.0])]
    same(searched(spark, rows), brute(rows, {0, 100, 200, 300, 400}))


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 2.0])], [(0, None), (100, None)], [(0, [1.0, 2.0]), (100, [1.0, 2.0])]])
def test_tiny_tables(spark, rows):
    same(searched(spark, rows), brute(rows, {0, 100}))


def test_many_equal_vectors(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(600)] + clusters(300, dims=3)
    rows = [(i, v) for i, (_, v) in enumerate(rows)]
    same(searched(spark, rows), brute(rows, set(range(0, 900, 100))))


def test_recall_with_many_lists(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LIST_ROWS", 32)
    monkeypatch.setattr(neighbours, "BUNDLE_ROWS", 200)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 4)
    monkeypatch.setattr(neighbours, "SAMPLE", 1000)
    rows = clusters(3000)
    found = searched(spark, rows, every=50)
    expected = brute(rows, set(range(0, 3000, 50)))
    hits = {(r.query_id, r.vec_id) for r in found} & {(q, i) for q, _, i, _ in expected}
    assert len(hits) >= 0.9 * len(expected)
    by_query = {}
    for r in found:
        by_query.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    for ranked in by_query.values():
        ranked.sort()
        assert [x[0] for x in ranked] == list(range(1, len(ranked) + 1))
        assert [x[1:] for x in ranked] == sorted(x[1:] for x in ranked)


def test_lists_are_balanced():
    x = np.concatenate([np.random.default_rng(1).normal(size=(4000, 8)) * 0.01, np.random.default_rng(2).normal(size=(400, 8))])
    c = neighbours.balanced_centroids(x, 100)
    own = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert np.bincount(own, minlength=len(c)).max() < 12 * 100


def test_graph_finds_the_nearest_centroids():
    rng = np.random.default_rng(4)
    c = rng.normal(size=(500, 10))
    graph, x = neighbours.Graph(c), rng.normal(size=(60, 10))
    true = np.sqrt(((x[:, None] - c[None]) ** 2).sum(axis=2))
    found = graph.search(x, 8, 1.1)
    assert (found.argmin(axis=1) == true.argmin(axis=1)).mean() > 0.9
