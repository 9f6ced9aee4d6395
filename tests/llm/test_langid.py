import zlib

import numpy as np
import pytest

from lamella.llm import langid

DOCS = "doc_id long, text string, lang string, score string, held_out int"
WORDS = {
    "en": "the of and to in that was his with for had not but which this from they she were been have their would there what could other than then into".split(),
    "de": "der die und nicht das ist ein ich mit sich auf für auch als über wird aber wenn oder können müssen größer straße zwischen während gegen".split(),
    "fr": "le de et les des que une dans pour pas qui sur plus par être avec elle été où même à très après aussi français élève garçon".split(),
}


def corpus(n=360):
    rng = np.random.default_rng(4)
    langs = list(WORDS)
    return [(i, " ".join(rng.choice(WORDS[langs[i % 3]], 40)), langs[i % 3]) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", 1) for r in rows], DOCS)


@pytest.fixture(scope="module")
def net(spark):
    return langid.train(frame(spark, corpus()))


def test_held_out_accuracy_and_edges(spark, net):
    rows = corpus()
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "123 $$$ ...", None), (1003, "日本語", None), (1004, "é", None), (None, rows[0][1], "en"), (7, rows[7][1], rows[7][2]), (1005, " ".join(WORDS["de"]) * 6000, "de"), (1006, "́ 1", None)]
    found = langid.identify(frame(spark, rows + odd), net).collect()
    assert len(found) == len(rows) + len(odd)
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    assert all(r.held_out == held(r.doc_id) for r in found if r.doc_id is not None)
    truth = {d: lang for d, _, lang in rows}
    tested = [r.lang_pred == truth[r.doc_id] for r in found if r.doc_id in truth and r.held_out]
    assert len(tested) > 40 and np.mean(tested) > 0.95
    by = {r.doc_id: r for r in found}
    assert all((by[d].lang_pred, by[d].score) == ("und", 0.0) for d in (1000, 1001, 1002, 1006))
    assert by[1003].lang_pred in WORDS and by[1004].lang_pred in WORDS and by[1005].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in found)


def test_the_fold_equals_the_network(spark, net):
    rng = np.random.default_rng(1)
    plain = langid.ByteNet(["a", "b", "c"], seed=5)
    x = rng.integers(0, 256, (7, langid.WIDTH)).astype(np.uint8)
    e = plain.p["E"][x]
    pooled = []
    for w in langid.WIDTHS:
        rows = np.concatenate([e[:, k : langid.WIDTH - w + 1 + k] for k in range(w)], axis=2)
        pooled.append(np.maximum((rows @ plain.p[f"W{w}"] + plain.p[f"b{w}"]).max(axis=1), 0))
    logit = np.concatenate(pooled, axis=1) @ plain.p["U"] + plain.p["u"]
    q = np.exp(logit - logit.max(axis=1, keepdims=True))
    assert np.allclose(plain.folded().probabilities(x), q / q.sum(axis=1, keepdims=True), atol=1e-4)


def test_gradients():
    net = langid.ByteNet(["a", "b"], seed=2)
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 256, (4, langid.WIDTH)).astype(np.uint8), np.array([0, 1, 1, 0])
    g = net.step(x, y)

    def loss():
        q = net.folded()
        e = net.p["E"][x]
        pooled = []
        for w in langid.WIDTHS:
            rows = np.concatenate([e[:, k : langid.WIDTH - w + 1 + k] for k in range(w)], axis=2)
            pooled.append(np.maximum((rows @ net.p[f"W{w}"]).max(axis=1) + net.p[f"b{w}"], 0))
        logit = np.concatenate(pooled, axis=1) @ net.p["U"] + net.p["u"]
        logit -= logit.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(logit).sum(axis=1)) - logit[np.arange(4), y])) if q else 0.0

    for name in ("U", "W3", "E"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        before = net.p[name][at]
        net.p[name][at] = before + 1e-5
        up = loss()
        net.p[name][at] = before - 1e-5
        down = loss()
        net.p[name][at] = before
        assert (up - down) / 2e-5 == pytest.approx(g[name][at], rel=1e-3)


@pytest.mark.parametrize("rows", [[], [(1, None, "en"), (2, "text", None)]])
def test_nothing_to_learn_from(spark, rows):
    df = frame(spark, rows)
    assert langid.train(df) is None
    assert [(r.lang_pred, r.score) for r in langid.identify(df, None).collect()] == [("und", 0.0)] * len(rows)


def test_held_out_labels_do_not_matter(spark):
    rows = corpus(90)
    other = [(d, t, "xx" if zlib.crc32(str(d).encode()) % 5 == 0 else lang) for d, t, lang in rows]
    one, two = langid.train(frame(spark, rows)), langid.train(frame(spark, other))
    assert one.languages == two.languages and np.array_equal(one.u, two.u)
