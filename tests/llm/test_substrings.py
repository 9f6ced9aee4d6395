import time

import numpy as np
import pytest

from lamella.llm import substrings

SCHEMA = "doc_id long, text string, left_id string, key long"


def line(rng, n, pool=5000):
    return " ".join(f"w{x}" for x in rng.integers(0, pool, n))


def links(spark, docs):
    rows = spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA)
    return substrings.passages(rows).collect()


def jaccard(a, b):
    def shingles(text):
        w = text.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def classes(found, ids):
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for r in found:
        up[top(r.left_id)] = top(r.right_id)
    return {i: top(i) for i in ids}


def test_passages_shared_by_many_documents(spark):
    rng = np.random.default_rng(8)
    shared, other = line(rng, 70), line(rng, 60)
    docs = [(i, f"{line(rng, 100)} {shared} {line(rng, 90)}") for i in range(40)]
    docs += [(100 + i, f"{line(rng, 20)} {other}") for i in range(3)] + [(200 + i, line(rng, 150)) for i in range(20)]
    found = links(spark, docs)
    linked = {i for r in found for i in (r.left_id, r.right_id)}
    assert linked == {*range(40), 100, 101, 102}
    of = classes(found, [d for d, _ in docs])
    assert len({of[i] for i in range(40)}) == 1 and len({of[i] for i in (100, 101, 102)}) == 1 and of[0] != of[100]
    assert all(r.left_id != r.right_id and r.similarity >= 0.8 for r in found)
    assert len(found) < 3 * len(docs)  # stars, not all pairs


def test_near_passages_and_what_is_below_the_threshold(spark):
    rng = np.random.default_rng(9)
    base = line(rng, 120).split()
    near, far = list(base), list(base)
    near[60] = "changed"
    for i in range(0, 120, 6):
        far[i] = f"x{i}"
    docs = [(1, f"{line(rng, 80)} {' '.join(base)}"), (2, f"{' '.join(near)} {line(rng, 80)}"), (3, f"{line(rng, 40)} {' '.join(far)}")]
    assert jaccard(" ".join(base), " ".join(near)) >= 0.8 > jaccard(" ".join(base), " ".join(far))
    found = links(spark, docs)
    assert {(r.left_id, r.right_id) for r in found} | {(r.right_id, r.left_id) for r in found} == {(1, 2), (2, 1)}


def test_places_hold_the_passage(spark):
    rng = np.random.default_rng(10)
    shared = line(rng, 60)
    texts = {1: f"{line(rng, 30)} {shared} {line(rng, 30)}", 2: f"É {line(rng, 50)} {shared}"}
    (found,) = links(spark, list(texts.items()))
    for doc, byte, word, n in ((found.left_id, found.left_byte, found.left_word, found.left_words), (found.right_id, found.right_byte, found.right_word, found.right_words)):
        cut = texts[doc].encode()[byte:].decode().split()[word : word + n]
        assert shared.split() == cut


def test_copies_repeats_and_edges(spark):
    rng = np.random.default_rng(11)
    text, long = line(rng, 80), line(rng, 120_000)
    docs = [(1, text), (2, text), (1, text), (3, text.upper()), (4, None), (5, ""), (6, "few words"), (None, text), (7, long), (8, f"{line(rng, 60)} {' '.join(long.split()[5000:5100])}")]
    docs += [(9, " ".join([line(rng, 50)] * 1)), (10, "again " * 300), (11, "again " * 300)]
    found = links(spark, docs)
    of = classes([r for r in found if r.left_id is not None and r.right_id is not None], [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11])
    assert of[1] == of[2] == of[3] and of[7] == of[8] and of[10] == of[11]
    assert len({of[i] for i in (1, 4, 5, 6, 7, 9, 10)}) == 7
    assert any(None in (r.left_id, r.right_id) for r in found)
    assert len(found) == len(set(found))


@pytest.mark.parametrize("docs", [[], [(1, None)], [(1, "a b"), (2, "a b")]])
def test_small_tables(spark, docs):
    assert links(spark, docs) == []


def test_windows_equal_the_sliding_minimum():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**60, 400, dtype=np.uint64)
    found = substrings._sliding_min(h, 46)
    assert found.tolist() == [h[i : i + 46].min() for i in range(355)]


@pytest.mark.parametrize(("n", "pool"), [(400, 1 << 60), (300, 40), (200, 3)])
def test_nodes_and_their_joins_are_the_minima_of_all_subsequences(n, pool):
    h = np.random.default_rng(n).integers(0, pool, (2, n)).astype(np.uint64)
    least = [substrings._sliding_min(x, substrings.SPAN) for x in h]
    k = len(least[0])
    doc, inside, fresh = (np.arange(k) >= k // 2).astype(int), np.ones(k, dtype=bool), np.zeros(k, dtype=bool)
    fresh[[0, k // 2]] = True  # two texts
    one, two = (substrings.CompactWindows(x, inside, fresh, doc) for x in least)
    i, j, first, last = substrings.joined(one, two)
    found = set(zip(one.value[i].tolist(), two.value[j].tolist(), doc[first].tolist(), strict=True))
    ranges = [(u, v) for u in range(k) for v in range(u, k) if doc[u] == doc[v]]
    low = [{r: int(x[r[0] : r[1] + 1].min()) for r in ranges} for x in least]
    assert found == {(low[0][r], low[1][r], int(doc[r[0]])) for r in ranges}
    for a, b, u, v in zip(i, j, first, last, strict=True):
        assert (low[0][u, v], low[1][u, v]) == (one.value[a], two.value[b])
    owner = {}  # each range has one node, that of its minimum
    for c in range(len(one.start)):
        for u in range(one.left[c], one.stop[c] + 1):
            for v in range(max(u, one.start[c]), one.right[c] + 1):
                assert (u, v) not in owner and low[0][u, v] == one.value[c]
                owner[u, v] = c
    assert len(owner) == len(ranges)


def test_removal_keeps_one(spark):
    rng = np.random.default_rng(12)
    shared = line(rng, 70)
    docs = spark.createDataFrame([(i, f"{line(rng, 30)} {shared}") for i in range(5)] + [(9, line(rng, 99))], "doc_id long, text string")
    kept = substrings.remove_repeats(docs, substrings.passages(docs))
    assert {r.doc_id for r in kept.collect()} == {0, 9} and kept.columns == docs.columns


def test_one_row_per_document_with_class_and_links(spark):
    rng = np.random.default_rng(16)
    p, q, text = line(rng, 60), line(rng, 60), line(rng, 90)
    texts = [(5, f"{p} {line(rng, 40)}"), (3, f"{line(rng, 20)} {p} {line(rng, 30)} {q}"), (8, f"{line(rng, 9)} {q}"), (1, line(rng, 80)), (2, None), (7, text), (7, text), (None, text)]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    found = sorted(substrings.classes(rows, substrings.passages(rows)).collect(), key=str)
    assert {(r.doc_id, r.component_id, r.n_links) for r in found} == {(5, 3, 1), (3, 3, 2), (8, 3, 1), (1, 1, 0), (2, 2, 0), (7, 7, 1), (None, None, 1)}
    assert len(found) == len(texts)
    empty = rows.where("false")
    assert substrings.classes(empty, substrings.passages(empty)).collect() == []


def test_against_all_pairs(spark):
    """Pairs of texts whose passages are similar by the rule, found by verifying all with all: links join at least 0.9."""
    rng = np.random.default_rng(17)
    docs, near = [], 0
    for group in range(30):
        base = line(rng, 70).split()
        for _ in range(3):
            edited = list(base)
            for place in rng.integers(0, 70, near % 2):
                edited[place] = f"e{rng.integers(0, 10**6)}"
            near += 1
            docs.append((len(docs), f"{line(rng, 40)} {' '.join(edited)} {line(rng, 30)}"))
    every = {(i, j) for i, a in docs for j, b in docs if i < j and substrings.matches(a.encode(), b.encode())}
    of = classes(links(spark, docs), [i for i, _ in docs])
    assert len(every) > 60
    assert sum(of[i] == of[j] for i, j in every) >= 0.9 * len(every)
    assert all((i // 3 == j // 3) for i, _ in docs for j, _ in docs if of[i] == of[j])


@pytest.mark.parametrize("n", range(50, 76, 5))
def test_an_edit_at_every_place_of_a_passage(n):
    rng = np.random.default_rng(n)
    for i in range(n):
        base = line(rng, n).split()
        near = [*base[:i], "changed", *base[i + 1 :]]
        a, b = f"{line(rng, 30)} {' '.join(base)} {line(rng, 30)}", f"{line(rng, 20)} {' '.join(near)} {line(rng, 40)}"
        ((similarity, x, left, y, right),) = substrings.matches(a.encode(), b.encode())
        one, two = a.split()[x : x + left], b.split()[y : y + right]
        assert similarity == jaccard(" ".join(one), " ".join(two)) >= 0.8 and min(left, right) >= 50
        assert max(one.count(w) for w in base) and len(set(one) & set(base)) >= n - 7


def test_less_than_the_threshold_is_no_passage():
    rng = np.random.default_rng(13)
    for n in (30, 40, 44):  # 40 of 52 shingles at most
        shared = line(rng, n)
        assert not substrings.matches(f"{line(rng, 60)} {shared} {line(rng, 60)}".encode(), f"{shared} {line(rng, 60)}".encode())


def test_each_passage_of_two_documents_is_a_link(spark):
    rng = np.random.default_rng(14)
    p, q, often = line(rng, 60), line(rng, 60), line(rng, 12)
    docs = [(1, f"{p} {line(rng, 40)} {q} {line(rng, 30)}"), (2, f"{line(rng, 10)} {q} {line(rng, 90)} {p}")]
    found = links(spark, docs)
    assert sorted(n for r in found for n in (r.left_words, r.right_words)) == [60] * 4
    texts = dict(docs)
    cut = lambda i, byte, word, n: texts[i].encode()[byte:].decode().split()[word : word + n]
    for r in found:
        one, two = cut(r.left_id, r.left_byte, r.left_word, r.left_words), cut(r.right_id, r.right_byte, r.right_word, r.right_words)
        assert one == two
    assert {" ".join(cut(r.left_id, r.left_byte, r.left_word, r.left_words)) for r in found} == {p, q}
    a, b = f"{' '.join([often] * 30)} {line(rng, 50)} {p}", f"{often} {often} {line(rng, 50)} {p}"
    assert [f[2] for f in substrings.matches(a.encode(), b.encode())] == [60]


def test_copies_whose_key_begins_with_another_passage(spark):
    rng = np.random.default_rng(15)
    docs, twins = [], []
    for group in range(6):  # 40 words in all, and tails of which two and two agree
        common = line(rng, 40)
        for pair in range(6):
            tail, ids = line(rng, 12), (100 * group + 2 * pair, 100 * group + 2 * pair + 1)
            twins.append(ids)
            docs += [(i, f"{line(rng, 60)} {common} {tail} {line(rng, 60)}") for i in ids]
    found = links(spark, docs)
    assert {tuple(sorted((r.left_id, r.right_id))) for r in found} == set(twins)


def brute(docs):
    """Smallest doc_id reachable over all pairs of texts with a passage."""
    up = {i: i for i, _ in docs}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in docs:
        for j, b in docs:
            if i < j and top(i) != top(j) and substrings.matches(a.encode(), b.encode()):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return {i: top(i) for i in up}


def test_no_class_is_split(spark):
    """Passages at the threshold, chains of them whose ends have nothing in common by the rule, and words repeated."""
    rng = np.random.default_rng(18)
    docs = []
    for _ in range(60):  # of 50 to 64 words one or two are other ones
        base = line(rng, 56).split()
        for _ in range(4):
            edited = list(base)
            for place in rng.integers(0, 56, 2):
                edited[place] = f"e{rng.integers(0, 10**6)}"
            docs.append((len(docs), f"{line(rng, 30)} {' '.join(edited)} {line(rng, 30)}"))
    for _ in range(5):
        chain = line(rng, 400).split()
        docs += [(len(docs) + i, " ".join(chain[40 * i : 40 * i + 92])) for i in range(7)]
    docs += [(len(docs) + i, f"{'again ' * n}{line(rng, 60)}") for i, n in enumerate((20, 45, 49, 50, 60, 70))]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in substrings.classes(rows, substrings.passages(rows)).collect()}
    assert found == brute(docs)


def test_no_pair_at_the_threshold_is_left_out(spark):
    rng = np.random.default_rng(19)
    docs = []
    for _ in range(300):
        base = line(rng, 50).split()
        near = [*base[:25], "changed", *base[26:]]
        docs += [(len(docs) + i, f"{line(rng, 30)} {' '.join(v)} {line(rng, 30)}") for i, v in enumerate((base, near))]
    pairs = [(i, j) for (i, a), (j, b) in zip(docs[::2], docs[1::2], strict=True) if substrings.matches(a.encode(), b.encode())]
    assert len(pairs) == 300
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    of = {r.doc_id: r.component_id for r in substrings.classes(rows, substrings.passages(rows)).collect()}
    assert [p for p in pairs if of[p[0]] != of[p[1]]] == []


def stuttered(rng, words, low, high):
    return " ".join(" ".join([f"w{x}"] * rng.integers(low, high)) for x in words)


def test_words_said_many_times_are_not_verified_in_all_pairs(spark, monkeypatch):
    rng, seen, kept = np.random.default_rng(20), [], substrings.stored

    def stored(df, name):
        out = kept(df, name)
        seen.append((name, out.count()))
        return out

    monkeypatch.setattr(substrings, "stored", stored)
    words = [[x, 1000 + 4 * i + k] for i in range(80) for k, x in enumerate(rng.choice(12, 4, replace=False))]  # often, and in one text only
    docs = [(i, stuttered(rng, sum(words[4 * i : 4 * i + 4], []), 41, 46)) for i in range(80)]
    assert links(spark, docs) == []
    assert sum(n for name, n in seen if name == "pairs") <= len(docs)


@pytest.mark.parametrize("seldom", [100, 3])
def test_no_class_of_words_said_many_times_is_split(spark, monkeypatch, seldom):
    monkeypatch.setattr(substrings, "_SELDOM", seldom)
    rng = np.random.default_rng(21)
    docs = [(i, f"{line(rng, 9)} {stuttered(rng, rng.integers(0, 30, 4), 20, 56)}") for i in range(50)]
    docs += [(50 + i, stuttered(rng, rng.integers(0, 4, 30), 1, 5)) for i in range(20)]
    for i in range(8):
        base = [*rng.integers(100, 400, 14), 7, 7, 8]
        docs += [(100 + 3 * i + k, f"{line(rng, 20)} {stuttered(rng, [*base[: 5 * k], 90, *base[5 * k :]], 3, 7)}") for k in range(3)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in substrings.classes(rows, substrings.passages(rows)).collect()}
    assert found == brute(docs) and len(set(found.values())) < len(found)


def test_what_is_ruled_out_by_hashes_has_no_passage():
    rng, passed, held = np.random.default_rng(22), 0, 0
    for _ in range(1500):
        base = [f"w{x}" for x in rng.integers(0, 6, 90)] if rng.random() < 0.5 else stuttered(rng, rng.integers(0, 9, 6), 1, 40).split()
        near = list(base)
        for place in rng.integers(0, len(near), rng.integers(0, 9)):
            near[place] = f"w{rng.integers(0, 12)}"
        a, b = " ".join(base).encode(), " ".join([*near[rng.integers(0, 20) :], "tail"]).encode()
        alike = bool(substrings.matches(a, b))
        assert substrings._sieved([(a, b)]) == [True] or not alike
        held += alike
        passed += not alike
    assert held > 100 and passed > 100


def test_outliers_of_near_copies_are_no_rows_of_pairs(spark, monkeypatch):
    rng, seen, kept = np.random.default_rng(23), {}, substrings.stored

    def stored(df, name):
        out = kept(df, name)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(substrings, "stored", stored)
    base, docs = line(rng, 130).split(), []
    for i in range(150):
        near = list(base)
        for place in rng.choice(130, 2 if i < 120 else 8, replace=False) if i < 140 else range(5, 130, 20):
            near[place] = f"e{rng.integers(0, 10**6)}"
        docs.append((i, " ".join(near)))
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in substrings.classes(rows, substrings.passages(rows)).collect()}
    assert found == brute(docs) and 5 < len(set(found.values())) < 40
    assert seen["pairs"] <= 2 * len(docs)


def test_texts_held_against_blocks_are_those_of_all_pairs():
    rng = np.random.default_rng(24)
    base = [f"w{x}" for x in rng.integers(0, 60, 150)]
    texts = [b"few words", b""]
    for _ in range(60):
        near = list(base) if rng.random() < 0.7 else stuttered(rng, rng.integers(0, 9, 6), 1, 40).split()
        for place in rng.integers(0, len(near), rng.integers(0, 14)):
            near[place] = f"w{rng.integers(0, 90)}"
        texts.append(" ".join(near).encode())
    token = substrings._hashed(texts)
    block = substrings._Block(token[:40])
    for a, t in zip(texts[40:], token[40:], strict=True):
        found = {k for k, _ in block.alike(t)}
        assert found >= {k for k, b in enumerate(texts[:40]) if substrings.matches(b, a)}
        assert found <= {k for k in range(40) if substrings._alike(t, token[k])}
    for known, at, fewest in token[2:]:
        assert fewest == min(len(set(at[i : i + 46].tolist())) for i in range(len(at) - 45)) if len(at) >= 46 else fewest == 0


def test_files_of_shuffles_go_with_the_table_they_were_made_for(spark, monkeypatch):
    key, kept, left = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", substrings.stored, {}
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")
    held = lambda: {f for f in files().split() if "shuffle_" in f}

    def stored(df, name):
        before = held()
        out = kept(df, name)
        for _ in range(50):
            left[name] = held() - before
            if not left[name]:
                break
            time.sleep(0.1)
        return out

    monkeypatch.setattr(substrings, "stored", stored)
    rng = np.random.default_rng(25)
    shared, set_before = line(rng, 70), spark.conf.get(key)
    assert links(spark, [(i, f"{line(rng, 30)} {shared}") for i in range(9)])
    assert {"texts", "pairs"} <= set(left) and not any(left.values())
    assert spark.conf.get(key) == set_before
