import numpy as np
import pytest
from xxhash import xxh64_intdigest

from lamella.llm import simhash

DOCS = "doc_id long, text string, lang string, n int"


def brute_print(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def brute_components(rows):
    prints = [(d, brute_print(t)) for d, t in rows]
    group = list(range(len(rows)))
    for i, (_, a) in enumerate(prints):
        for j, (_, b) in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= 4 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {g: min((d for (d, _), h in zip(prints, group) if h == g and d is not None), default=None) for g in group}
    return sorted(((d, f"{p:016x}", least[g]) for (d, p), g in zip(prints, group)), key=str)


def check(spark, rows):
    docs = spark.createDataFrame([(d, t, "en", 1) for d, t in rows], DOCS).withColumnRenamed("n", "component_id")
    found = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert found == brute_components(rows)


def test_matches_brute_force_with_edges(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)] + ["É", "ÀB", "The"]
    base = [" ".join(rng.choice(words, 120)) for _ in range(12)]
    rows = []
    for i, t in enumerate(base):
        rows += [(10 * i + 5, t), (10 * i + 6, t), (10 * i + 2, t + " tail"), (10 * i + 3, t.replace("w1 ", "w2 ", 1))]
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "One"), (905, "a b c d"), (None, "a b c d"), (None, base[0])]
    rows += [(903, "one"), (999, " ".join(rng.choice(words, 70_000)))]
    check(spark, rows)


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, None), (2, None)]])
def test_small_tables(spark, rows):
    check(spark, rows)


@pytest.mark.parametrize("tile", [2, 16, 1024])
def test_tiles_keep_components(tile):
    rng = np.random.default_rng(tile)
    centre = rng.integers(0, 2**63, 20, dtype=np.uint64)
    values = np.unique(np.concatenate([centre ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for a, b in rng.integers(0, 63, (30, 2))]))
    a, b = simhash.tile_forest(values, tile=tile)
    for got in (a, b):
        assert set(got.tolist()) <= set(values.tolist())
    label = {v: v for v in values.tolist()}
    root = dict(zip(a.tolist(), b.tolist()))
    todo = values.tolist()
    for v in todo:
        seen, front = {v}, [v]
        while front:
            x = front.pop()
            for y in todo:
                if y not in seen and (x ^ y).bit_count() <= 4:
                    seen.add(y)
                    front.append(y)
        label[v] = min(seen)
    classes = {}
    for v in todo:
        classes.setdefault(root.get(v, v), set()).add(label[v])
    assert all(len(c) == 1 for c in classes.values()) and len(classes) == len(set(label.values()))


@pytest.mark.parametrize("n", [10, 10**6, 10**9, 10**12])
def test_bands_meet_every_pair_in_reach(n):
    m = simhash.blocks_for(n)
    masks = simhash._masks(m, 4)
    rng = np.random.default_rng(1)
    for _ in range(200):
        flips = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(flips & (mask & (2**64 - 1)) == 0 for mask in masks)


def test_hot_buckets_are_dealt_out(spark):
    rng = np.random.default_rng(5)
    flips = [sum(1 << int(b) for b in rng.choice(20, 3, replace=False)) for _ in range(300)]
    values = sorted({0, *flips})
    nodes = spark.createDataFrame([(v,) for v in values], "f long")
    links = simhash.links(nodes, tile=16, bucket_rows=32).collect()
    assert all((r.a ^ r.b).bit_count() <= 64 for r in links)
    up = {v: v for v in values}

    def find(v):
        while up[v] != v:
            v = up[v]
        return v

    for r in links:
        up[find(r.a)] = find(r.b)
    assert len({find(v) for v in values}) == 1
