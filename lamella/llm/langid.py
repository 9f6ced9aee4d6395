"""Language identification by a byte convolutional network: multi-width filters, max pooling, softmax.

The network is trained in numpy on the driver, from windows of at most TRAIN_DOCS labelled documents, and applied on the
executors to every window of every text. Windows have WIDTH bytes and follow each other to the end of the text; the last
is padded. A document takes the mean of its windows' probabilities, weighted by their letters. For speed the embedding
and the filters are folded into tables by byte pair, so a filter of width 4 is two lookups.

Defined results: ``und`` with score 0 for a null text, a text without a letter, or when there is nothing to learn from;
rows with null lang or text are not learned from; repeated documents each get a row; extra columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, chunks, held_out

WIDTH, FILTERS, EMBED, WIDTHS = 128, 8, 8, (2, 3, 4)
#: Most documents learned from, over all languages, and most windows taken of each.
TRAIN_DOCS, DOC_WINDOWS = 6_000, 4
STEPS, BATCH = 700, 128
_AT_ONCE = 1 << 20
#: A-Z to a-z, other ASCII characters than letters to spaces.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_IS_LETTER = np.array([97 <= c <= 122 or c >= 192 for c in range(256)])


def windows_of(text: bytes) -> np.ndarray:
    """The text, letters lower-cased and blanks merged, as rows of WIDTH bytes; none if there is no such byte."""
    line = b" ".join(text.translate(_LETTERS).split())
    short = -len(line) % WIDTH
    return np.frombuffer(line + b" " * short, dtype=np.uint8).reshape(-1, WIDTH)


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    flat = text.translate(_LETTERS)
    if any(97 <= c <= 122 for c in flat[:64]) or (not flat.isascii() or flat.strip()) and any(97 <= c <= 122 for c in flat):
        return True
    return not text.isascii() and any(c.isalpha() for c in text.decode(errors="replace"))


class ByteNet:
    def __init__(self, languages: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.p = {"E": rng.normal(0, 0.3, (256, EMBED)), "U": rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(languages))), "u": np.zeros(len(languages))}
        for w in WIDTHS:
            self.p |= {f"W{w}": rng.normal(0, 1 / np.sqrt(w * EMBED), (w * EMBED, FILTERS)), f"b{w}": np.zeros(FILTERS)}

    def step(self, x: np.ndarray, y: np.ndarray) -> dict:
        """Gradients of the mean cross-entropy over windows x (bytes) with classes y."""
        p, n = self.p, len(x)
        e = p["E"][x]
        pooled, kept = [], []
        for w in WIDTHS:
            rows = np.concatenate([e[:, k : WIDTH - w + 1 + k] for k in range(w)], axis=2)
            z = rows @ p[f"W{w}"]
            at = z.argmax(axis=1)
            top = np.take_along_axis(z, at[:, None], axis=1)[:, 0] + p[f"b{w}"]
            pooled.append(np.maximum(top, 0))
            kept.append((rows, at, top > 0))
        a = np.concatenate(pooled, axis=1)
        logit = a @ p["U"] + p["u"]
        q = np.exp(logit - logit.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
        q[np.arange(n), y] -= 1
        q /= n
        g = {"U": a.T @ q, "u": q.sum(axis=0), "E": np.zeros_like(p["E"])}
        da = q @ p["U"].T
        for i, (w, (rows, at, on)) in enumerate(zip(WIDTHS, kept, strict=True)):
            d = da[:, i * FILTERS : (i + 1) * FILTERS] * on
            picked = rows[np.arange(n)[:, None], at]  # n, FILTERS, w * EMBED
            g[f"W{w}"] = np.einsum("nfk,nf->kf", picked, d)
            g[f"b{w}"] = d.sum(axis=0)
            back = d[:, :, None] * p[f"W{w}"].T[None]
            for k in range(w):
                np.add.at(g["E"], x[np.arange(n)[:, None], at + k], back[:, :, k * EMBED : (k + 1) * EMBED])
        return g

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        by = [np.flatnonzero(y == c) for c in range(len(self.languages))]
        by = [b for b in by if len(b)]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        for t in range(1, steps + 1):
            pick = np.concatenate([rng.choice(b, -(-BATCH // len(by))) for b in by])
            g = self.step(x[pick], y[pick])
            rate = 0.01 * (1 - 0.9 * t / steps)
            for k in self.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def folded(self) -> Folded:
        return Folded(self)


class Folded:
    """The network as lookups by byte and byte pair; positions come first, so pooling runs along memory."""

    def __init__(self, net: ByteNet):
        self.languages = net.languages
        p = net.p
        one = {(w, k): (p["E"] @ p[f"W{w}"][k * EMBED : (k + 1) * EMBED]) for w in WIDTHS for k in range(w)}
        pair = lambda w, k: (one[w, k][:, None] + one[w, k + 1][None]).reshape(-1, FILTERS).astype(np.float32)
        self.two, self.three, self.four, self.four_end = pair(2, 0), pair(3, 0), pair(4, 0), pair(4, 2)
        self.third = one[3, 2].astype(np.float32)
        self.bias = np.concatenate([p[f"b{w}"] for w in WIDTHS]).astype(np.float32)
        self.u, self.c = p["U"].astype(np.float32), p["u"].astype(np.float32)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Rows of windows (bytes) to rows of probabilities."""
        out = np.zeros((len(x), len(self.languages)), dtype=np.float32)
        for i in range(0, len(x), 256):
            b = np.ascontiguousarray(x[i : i + 256].T).astype(np.intp)
            pairs = (b[:-1] << 8) | b[1:]
            z = self.three[pairs[:-1]]
            z += self.third[b[2:]]
            y = self.four[pairs[:-2]]
            y += self.four_end[pairs[2:]]
            a = np.concatenate([self.two[pairs].max(axis=0), z.max(axis=0), y.max(axis=0)], axis=1)
            logit = np.maximum(a + self.bias, 0) @ self.u + self.c
            q = np.exp(logit - logit.max(axis=1, keepdims=True))
            out[i : i + 256] = q / q.sum(axis=1, keepdims=True)
        return out

    def predict(self, texts: list[bytes | None]) -> list[tuple[str, float]]:
        found: list[tuple[str, float]] = []
        for a, b in chunks(texts, lambda t: len(t or b"") + 1, _AT_ONCE):
            part = [windows_of(t) if t else np.zeros((0, WIDTH), np.uint8) for t in texts[a:b]]
            x = np.concatenate(part)
            weight = _IS_LETTER[x].sum(axis=1).astype(np.float64) + 1e-3
            q = self.probabilities(x) * weight[:, None]
            ends = np.cumsum([len(p) for p in part])
            sums = np.concatenate([np.zeros((1, q.shape[1])), np.cumsum(q, axis=0)])
            whole = np.concatenate([[0.0], np.cumsum(weight)])
            for t, e, p in zip(texts[a:b], ends.tolist(), part, strict=True):
                if not len(p) or not has_letter(t):
                    found.append(("und", 0.0))
                    continue
                mean = (sums[e] - sums[e - len(p)]) / (whole[e] - whole[e - len(p)])
                best = int(mean.argmax())
                found.append((self.languages[best], float(min(1.0, max(0.0, mean[best])))))
        return found


def train(docs: DataFrame, most: int = TRAIN_DOCS) -> Folded | None:
    """A network from labelled documents that are not held out; None if there are none."""
    rows = docs.select(F.col("doc_id").cast("long"), as_bytes("text"), "lang").where("lang IS NOT NULL AND text IS NOT NULL").where(~held_out("doc_id"))
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    quota = max(50, most // len(sizes))
    share = F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, min(1.0, quota / n))])
    place = F.xxhash64(F.col("doc_id"), F.lit(7)).alias("place")
    picked = rows.where((F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(1 << 20)) / (1 << 20)) < share[F.col("lang")])

    def run(batches):
        for batch in batches:
            cut = []
            for t, i in zip(batch.column("text").to_pylist(), batch.column("place").to_pylist(), strict=True):
                x = windows_of(t)
                at = np.random.default_rng(i % (1 << 32)).permutation(len(x))[:DOC_WINDOWS]
                cut.append(x[at].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("place"), pa.array(cut, pa.binary())], names=["lang", "place", "x"])

    taken = (
        picked.select("lang", place, "text").mapInArrow(run, "lang string, place long, x binary")
        .where("octet_length(x) > 0").orderBy("place", "lang", "x").limit(2 * most).collect()
    )
    if not taken:
        return None
    languages = sorted({r.lang for r in taken})
    x = [np.frombuffer(bytes(r.x), dtype=np.uint8).reshape(-1, WIDTH) for r in taken]
    y = np.concatenate([np.full(len(w), languages.index(r.lang)) for r, w in zip(taken, x, strict=True)])
    net = ByteNet(languages)
    net.train(np.concatenate(x), y)
    return net.folded()


def identify(docs: DataFrame, net: Folded | None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = shared.value.predict(texts) if shared.value else [("und", 0.0)] * len(texts)
            langs, scores = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    chosen = docs.select(F.col("doc_id").cast("long"), held_out("doc_id").alias("held_out"), as_bytes("text"))
    return chosen.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
