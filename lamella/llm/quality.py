"""Quality classifier: a sparse rule ensemble compiled into Spark column expressions.

Trees are boosted over statistics of whole texts; each path from a root to a node is a rule, a conjunction of bounds.
A lasso-penalised logistic regression weighs the rules, and those with a weight become one Column.

The model is fitted on the driver from at most TRAIN_ROWS labelled rows, taken in order of a hash of doc_id; the scores
come from the compiled Column over the statistics of every text. Nothing but the text enters a score.

Defined results: null text counts as empty; labels that are null, or whose doc_id is null, are ignored; a doc_id with
several labels takes their mean, rounded; without usable labels every score is 0.5, with labels of one kind it is the
smoothed share of that kind; repeated documents each get a row; extra columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out

TRAIN_ROWS = 20_000
THRESHOLD = 0.3
TREES, DEPTH, BINS, RATE, LEAST_ROWS = 24, 3, 32, 0.3, 20

STATISTICS = (
    "words", "word_bytes", "upper", "digit", "symbol", "bang", "pipe", "stop_mark", "comma", "repeat", "distinct",
    "line_words", "line_distinct", "marked", "capital_words", "common_share",
)
_KIND = np.zeros(256, dtype=np.int64)  # 0 other, then as in _SHARES
for _i, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*@^~<>{}[]=+_\\/", b"!", b"|", b".?", b","), 1):
    _KIND[list(_set)] = _i


def statistics(text: bytes | None) -> list[float]:
    """Values of STATISTICS over the whole text; all are 0 for an empty one."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    kinds = np.bincount(_KIND, weights=counts, minlength=8)
    filled = float(sum(map(len, words)))
    distinct = set(words)
    lines = [x for x in text.split(b"\n") if x]
    return [
        float(np.log1p(n)), filled / n, *(kinds[1:] / filled).tolist(),
        sum(map(eq, words, words[1:])) / n, len(distinct) / n ** 0.75, np.log1p(n / max(1, len(lines))),
        len(set(lines)) / max(1, len(lines)), sum(not w[-1:].isalpha() and w[-1] < 128 for w in distinct) / len(distinct),
        sum(map(bytes.isupper, distinct)) / len(distinct), len(distinct) / n,
    ]


def with_statistics(docs: DataFrame, name: str) -> DataFrame:
    """docs and a struct of STATISTICS by that name."""
    kind = T.StructType([T.StructField(s, T.DoubleType()) for s in STATISTICS])
    schema = T.StructType([*docs.schema.fields, T.StructField(name, kind)])

    def run(batches):
        for batch in batches:
            rows = [statistics(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            values = np.array(rows, dtype=np.float64).reshape(-1, len(STATISTICS))
            struct = pa.StructArray.from_arrays([pa.array(values[:, i]) for i in range(len(STATISTICS))], list(STATISTICS))
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def fresh(docs: DataFrame, name: str) -> str:
    """name, lengthened until docs has no such column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


@dataclass
class Rules:
    """logit = bias + sum of weights of the rules that hold; a rule is a list of (statistic, above, bound)."""

    bias: float
    weighted: list[tuple[list[tuple[int, bool, float]], float]] = field(default_factory=list)

    def column(self, stats: str) -> Column:
        logit = F.lit(float(self.bias))
        for rule, weight in self.weighted:
            holds = F.lit(True)
            for s, above, bound in rule:
                value = F.col(stats)[STATISTICS[s]]
                holds = holds & ((value > bound) if above else (value <= bound))
            logit = logit + F.when(holds, float(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-logit))

    def score(self, x: np.ndarray) -> np.ndarray:
        logit = np.full(len(x), self.bias)
        for rule, weight in self.weighted:
            logit += weight * holds(rule, x)
        return 1 / (1 + np.exp(-logit))


def holds(rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for s, above, bound in rule:
        out &= (x[:, s] > bound) == above
    return out


def _boosted_rules(x: np.ndarray, y: np.ndarray) -> list:
    """The paths to all nodes of boosted regression trees, each once."""
    bounds = [np.unique(np.quantile(x[:, s], np.linspace(0, 1, BINS + 1)[1:-1])) for s in range(x.shape[1])]
    binned = np.stack([np.searchsorted(b, x[:, s], side="left") for s, b in enumerate(bounds)])  # bin k: x <= bounds[k]
    logit, rules = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}

    def grow(rows: np.ndarray, path: tuple, g: np.ndarray, h: np.ndarray) -> None:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, None)
        if len(path) < DEPTH and len(rows) >= 2 * LEAST_ROWS:
            for s, b in enumerate(bounds):
                if len(b):
                    k = binned[s, rows]
                    left = [np.cumsum(np.bincount(k, w, minlength=len(b) + 1))[:-1] for w in (g[rows], h[rows], None)]
                    n = left[2]
                    gain = left[0] ** 2 / (left[1] + 1) + (total_g - left[0]) ** 2 / (total_h - left[1] + 1) - total_g**2 / (total_h + 1)
                    gain = np.where((n >= LEAST_ROWS) & (len(rows) - n >= LEAST_ROWS), gain, -1)
                    if gain.max() > best[0]:
                        best = (gain.max(), (s, int(gain.argmax())))
        if best[1] is None:
            logit[rows] += RATE * total_g / (total_h + 1)
            return
        s, k = best[1]
        low = binned[s, rows] <= k
        for above, part in ((False, rows[low]), (True, rows[~low])):
            longer = (*path, (s, above, float(bounds[s][k])))
            rules.setdefault(frozenset(longer), longer)
            grow(part, longer, g, h)

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-logit))
        grow(np.arange(len(y)), (), y - p, p * (1 - p))
    return [list(r) for r in rules.values()]


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient for the mean logistic loss with an l1 penalty on all but the bias."""
    n, k = z.shape
    size = 0.25 * (np.linalg.norm(z.T @ z / n, 2) + 1)
    w, b, v, c, t = np.zeros(k), np.log(y.mean() / (1 - y.mean())), np.zeros(k), 0.0, 1.0
    c = b
    for _ in range(steps):
        slope = 1 / (1 + np.exp(-(z @ v + c))) - y
        new_w = v - (z.T @ slope / n) / size
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - penalty / size, 0)
        new_b = c - slope.mean() / size
        new_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new_w + (t - 1) / new_t * (new_w - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new_w, new_b, new_t
    return b, w


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> Rules:
    if not len(y):
        return Rules(0.0)
    if len(y) < 10 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Rules(float(np.log(share / (1 - share))))
    rules = _boosted_rules(x, y)
    if not rules:
        return Rules(float(np.log(y.mean() / (1 - y.mean()))))
    z = np.stack([holds(r, x) for r in rules], axis=1).astype(np.float64)
    mean = z.mean(axis=0)
    scale = np.maximum(np.sqrt(mean * (1 - mean)), 0.02)
    bias, w = _lasso((z - mean) / scale, y, penalty)
    w = w / scale
    return Rules(float(bias - w @ mean), [(r, float(a)) for r, a in zip(rules, w, strict=True) if a])


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Rules:
    """Rules from labelled documents that are not held out: at most `most` of them, in order of a hash of doc_id."""
    chosen = (
        labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("double").alias("y"))
        .where("doc_id IS NOT NULL AND y IS NOT NULL")
        .where(~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.round(F.avg("y")).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")  # `most` rows at most
    rows = (
        with_statistics(texts, "stats").groupBy("doc_id").agg(F.min("stats").alias("stats"), F.first("y").alias("y")).collect()
    )
    rows.sort(key=lambda r: r.doc_id)
    x = np.array([list(r.stats) for r in rows], dtype=np.float64).reshape(-1, len(STATISTICS))
    return fit(x, np.array([r.y for r in rows], dtype=np.float64))


def score(docs: DataFrame, rules: Rules, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scored = with_statistics(docs.select(F.col("doc_id").cast("long"), "text"), "stats").select("doc_id", "stats")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), rules.column("stats").alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )


def keep_good(docs: DataFrame, rules: Rules, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the rules don't reject, with the columns of docs."""
    stats = fresh(docs, "_statistics")
    return with_statistics(docs, stats).where(rules.column(stats) >= threshold).drop(stats)
