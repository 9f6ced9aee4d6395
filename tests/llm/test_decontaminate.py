import hashlib
import re

import numpy as np
import pytest

from lamella.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string, n_hit string, item_id string", "item_id long, text string, doc_id int, k string"


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    found = []
    windows = set()
    for item, text in items:
        w = words(text)
        if item is not None and w:
            n = min(8, len(w))
            windows |= {(item, tuple(w[i : i + n])) for i in range(len(w) - n + 1)}
    for doc, text in docs:
        w, hit, seen = words(text), set(), set()
        for item, window in windows:
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    seen.add(item)
        digest = hashlib.sha256(",".join(sorted(map(str, seen))).encode()).hexdigest()
        found.append((doc, len(w), len(hit), len(seen), digest, len(seen) >= 2))
    return sorted(found, key=str)


def cases():
    rng = np.random.default_rng(2)
    pool = [f"w{i}" for i in range(40)] + ["É", "Straße", "日本"]
    line = lambda n: " ".join(rng.choice(pool, n))
    items = [(i, line(int(n))) for i, n in enumerate([20, 8, 9, 30, 3, 1, 0])]
    items += [(1, items[0][1]), (7, None), (None, line(12)), (9, "a b c d e f g h a b c d e f g h"), (10, "solo")]
    docs = [(i, line(60)) for i in range(12)]
    docs += [(20, f"x {items[0][1].upper()}! y {items[3][1]}"), (21, items[0][1].replace(" ", ", ")), (22, items[4][1]), (23, ""), (24, None), (25, "... !!"), (None, items[0][1])]
    docs += [(26, "a b c d e f g h a b c d e f g h a"), (27, "Solo solo"), (20, f"x {items[0][1].upper()}! y {items[3][1]}"), (28, line(200_000) + " " + items[1][1])]
    return docs, items


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(*d, "h", "c") for d in docs], DOCS),
        spark.createDataFrame([(*i, 3, "c") for i in items], ITEMS),
    )


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 0])
def test_matches_brute_force(spark, limit):
    docs, items = cases()
    if limit == 0:
        docs = [d for d in docs if d[0] != 28]
    found = decontaminate.score(*frames(spark, docs, items), limit=limit).collect()
    assert sorted(map(tuple, found), key=str) == brute(docs, items)


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 0])
def test_empty_tables(spark, limit):
    docs, items = cases()
    assert decontaminate.score(*frames(spark, [], items), limit=limit).count() == 0
    found = decontaminate.score(*frames(spark, docs[:3], []), limit=limit).collect()
    assert sorted(map(tuple, found), key=str) == brute(docs[:3], [])


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 0])
def test_removal_cuts_passages_and_drops_documents(spark, limit):
    passage = " ".join(f"Q{i}" for i in range(12))
    items = [(1, passage), (2, "p1 p2 p3 p4 p5 p6 p7 p8"), (3, "short one")]
    docs = [
        (1, f"Keep this, {passage}; and this."), (2, f"{passage} p1 p2 p3 p4 p5 p6 p7 p8"), (3, "nothing here"), (4, None), (5, ""),
        (6, "a short one stays"), (7, passage), (8, f"{passage} between {passage}"), (9, "É " + passage + " ü"), (1, f"Keep this, {passage}; and this."),
    ]
    rows = spark.createDataFrame([(d, t, len(t or ""), "x") for d, t in docs], "doc_id long, text string, n_chars long, items string")
    kept = decontaminate.remove(rows, frames(spark, [], items)[1], limit=limit)
    assert kept.columns == rows.columns
    found = {(r.doc_id, r.text, r.n_chars) for r in kept.collect()}
    texts = {1: "Keep this, ; and this.", 3: "nothing here", 4: None, 5: "", 6: "a short one stays", 7: "", 8: " between ", 9: "É  ü"}
    assert found == {(d, t, len(t or "")) for d, t in texts.items()}
    assert kept.count() == 9


def test_hash_hits_are_verified():
    index = decontaminate.WindowIndex([(1, [b"a", b"b", b"c"]), (2, [b"a", b"b", b"d"])])
    windows = index.exact[3]
    windows.most, windows.hashes[:], index.factors[:] = 2, 0, 0  # both windows, and all of the text's, have one hash
    *_, hit, found = index.scan([b"x a b d", b"a b x"])
    assert found == {0: {2}} and hit.tolist() == [False, True, True, True, False, False, False]
