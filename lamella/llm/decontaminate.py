"""Benchmark decontamination: a broadcast set of hashed test n-grams, token windows scanned against it, hits verified.

Words are those of ``alnum_words``. A window is WINDOW consecutive words of a benchmark item; an item with fewer words
(but at least one) is one window. Every word of a document inside an occurrence of a window is *hit*.

Defined results: null or word-less text has no words and no hits; benchmark rows with null text or null item_id are
ignored; repeated benchmark rows count once; an empty benchmark hits nothing; repeated documents each get their own row;
extra columns of either table are never read.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _ALNUM as _flat
from .common import alnum_words, as_bytes, chunks

WINDOW = 8
#: Most bytes of benchmark text whose windows are broadcast; beyond it windows are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
_WORDS_AT_ONCE = 1_000_000
_SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def digest(items) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


class _Vocabulary(dict):
    def __missing__(self, word):
        return 0


class _Windows:
    """The distinct windows of one length, as rows of word numbers sorted by hash, with the items that hold them.

    Arrays of numbers: about 50 bytes for a window, however many there are.
    """

    def __init__(self, rows: np.ndarray, items: np.ndarray, factors: np.ndarray):
        keys, which = np.unique(rows, axis=0, return_inverse=True)
        hashes = (keys.astype(np.uint64) * factors[: keys.shape[1]]).sum(axis=1, dtype=np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.keys, self.hashes = keys[order], hashes[order]
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        held = np.unique(np.stack([rank[which.ravel()], items], axis=1), axis=0)
        self.starts = np.searchsorted(held[:, 0], np.arange(len(keys) + 1))
        self.items = held[:, 1].astype(np.int32)
        #: Most windows that have one hash.
        self.most = int(np.unique(self.hashes, return_counts=True)[1].max())

    def match(self, flat: np.ndarray, at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of places at with hashes h, those where a window stands, word by word, and the window's row."""
        first = np.searchsorted(self.hashes, h)
        n = self.keys.shape[1]
        places, rows = [], []
        for k in range(self.most):
            row = np.minimum(first + k, len(self.hashes) - 1)
            near = np.flatnonzero(self.hashes[row] == h)
            same = (self.keys[row[near]] == flat[at[near, None] + np.arange(n)]).all(axis=1)
            places.append(at[near[same]])
            rows.append(row[near[same]])
        return np.concatenate(places), np.concatenate(rows)


class WindowIndex:
    """Exact windows by their length, behind sorted 64-bit hashes of word numbers."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int = WINDOW):
        self.vocabulary = _Vocabulary()
        self.names = sorted({item for item, _ in items}, key=str)
        number = {item: i for i, item in enumerate(self.names)}
        rows: dict[int, list[np.ndarray]] = {}
        owners: dict[int, list[np.ndarray]] = {}
        for item, words in items:
            numbers = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], dtype=np.uint32)
            n = min(window, len(numbers))
            if n:
                cut = np.lib.stride_tricks.sliding_window_view(numbers, n)
                rows.setdefault(n, []).append(cut)
                owners.setdefault(n, []).append(np.full(len(cut), number[item]))
        rng = np.random.default_rng(17)
        self.factors = rng.integers(1, 2**63, size=window, dtype=np.uint64) | np.uint64(1)
        self.exact = {n: _Windows(np.concatenate(r), np.concatenate(owners[n]), self.factors) for n, r in rows.items()}

    def scan(self, texts: list[bytes | None], least: int = 1):
        """Per text: number of words, hit flag per word, set of items. Only windows of least words or more count."""
        split = [alnum_words(t) for t in texts]
        lengths = np.array([len(w) for w in split], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        total = int(starts[-1])
        flat = np.fromiter(
            map(self.vocabulary.__getitem__, chain.from_iterable(split)), dtype=np.uint64, count=total
        )
        known = np.concatenate([[0], np.cumsum(flat > 0)])
        edge = np.zeros(total + 1, dtype=np.int64)
        found: dict[int, set] = {}
        for n, windows in self.exact.items():
            if n < least or total < n:
                continue
            at = np.flatnonzero(known[n:] - known[:-n] == n)
            doc = np.searchsorted(starts, at, side="right") - 1
            inside = at + n <= starts[doc + 1]
            at = at[inside]
            h = np.zeros(len(at), dtype=np.uint64)
            for k in range(n):
                h += flat[at + k] * self.factors[k]
            at, row = windows.match(flat, at, h)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + n, -1)
            doc = np.searchsorted(starts, at, side="right") - 1
            for d, r in np.unique(np.stack([doc, row], axis=1), axis=0).tolist():
                own = windows.items[windows.starts[r] : windows.starts[r + 1]].tolist()
                found.setdefault(d, set()).update(self.names[i] for i in own)
        hit = np.cumsum(edge[:-1]) > 0
        return split, lengths, starts, hit, found


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select("item_id", as_bytes("text")).where("item_id IS NOT NULL AND text IS NOT NULL")


def broadcast_index(benchmark: DataFrame, limit: int = BROADCAST_BYTES) -> WindowIndex | None:
    """The index of the whole benchmark, or None if its text is larger than limit bytes."""
    items = _items(benchmark)
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > limit:
        return None
    return WindowIndex([(r.item_id, alnum_words(bytes(r.text))) for r in items.collect()])


def score(docs: DataFrame, benchmark: DataFrame, min_items: int = 2, limit: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_items >= min_items)."""
    index = broadcast_index(benchmark, limit)
    if index is None:
        return _score_by_join(docs, benchmark, min_items)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            rows = []
            for a, b in chunks(texts, lambda t: len(t or b"") // 6, _WORDS_AT_ONCE):
                _, lengths, starts, hit, found = shared.value.scan(texts[a:b])
                sums = np.concatenate([[0], np.cumsum(hit)])
                n_hit = sums[starts[1:]] - sums[starts[:-1]]
                for i in range(b - a):
                    items = found.get(i, ())
                    rows.append(
                        (ids[a + i], int(lengths[i]), int(n_hit[i]), len(items), digest(items), len(items) >= min_items)
                    )
            yield _batch(rows)

    return docs.select(F.col("doc_id").cast("long"), as_bytes("text")).mapInArrow(run, _SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    kinds = [pa.int64()] * 4 + [pa.string(), pa.bool_()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else
        [pa.array([], k) for k in kinds], names=names
    )


def _windows(sizes: list[int] | None):
    """Windows (k, i, n, w) of texts: of the sizes, or of an item's own size."""

    def run(batches):
        for batch in batches:
            keys, texts = batch.column("k").to_pylist(), batch.column("text").to_pylist()
            out = ([], [], [], [])
            for k, t in zip(keys, texts, strict=True):
                w = alnum_words(t)
                for n in sizes or ({min(WINDOW, len(w))} - {0}):
                    for i in range(len(w) - n + 1):
                        for c, v in zip(out, (k, i, n, b" ".join(w[i : i + n])), strict=True):
                            c.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int32(), pa.int32(), pa.binary()), strict=True)],
                names=["k", "i", "n", "w"],
            )

    return run


def _name() -> Column:
    """Rows that agree in doc_id and text have equal results, so they share a name."""
    text = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    return F.concat_ws(":", F.col("doc_id").cast("string"), text)


def _hits_by_join(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(k, i, n, items): occurrences of windows in the texts of docs, found by a shuffle on the windows' words."""
    schema = "k string, i int, n int, w binary"
    tests = (
        _items(benchmark)
        .select(F.col("item_id").cast("string").alias("k"), "text")
        .mapInArrow(_windows(None), schema)
        .groupBy("n", "w")
        .agg(F.collect_set("k").alias("items"))
    )
    sizes = sorted(r.n for r in tests.select("n").distinct().collect())  # WINDOW numbers at most
    texts = docs.select(_name().alias("k"), as_bytes("text")).groupBy("k").agg(F.first("text").alias("text"))
    return texts.mapInArrow(_windows(sizes or [WINDOW]), schema).join(tests, ["n", "w"])


def _score_by_join(docs: DataFrame, benchmark: DataFrame, min_items: int) -> DataFrame:
    """The way beyond the broadcast limit."""
    words = F.size(_word_array("text")).cast("long").alias("n_words")
    counted = docs.select(F.col("doc_id").cast("long"), _name().alias("k"), words)
    places = F.sequence(F.col("i"), F.col("i") + F.col("n") - 1)
    per = _hits_by_join(docs, benchmark).groupBy("k").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set(places)))).cast("long").alias("n_hit"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    items = F.coalesce("items", F.array().cast("array<string>"))
    return counted.join(per, "k", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array(items), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size(items) >= min_items).alias("contaminated"),
    )


def _remove_by_join(docs: DataFrame, benchmark: DataFrame, min_items: int) -> DataFrame:
    """The way beyond the broadcast limit."""
    names, schema = docs.columns, docs.schema
    full = F.when(F.col("n") >= WINDOW, F.col("i"))
    per = _hits_by_join(docs, benchmark).groupBy(F.col("k").alias("_k")).agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("items")))).alias("_items"), F.collect_set(full).alias("_starts")
    )
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"), _name().alias("_name"))
    found = held.join(per, F.col("_name") == F.col("_k"), "left").where(F.coalesce("_items", F.lit(0)) < min_items)
    columns = [F.col("_doc")[c].alias(c) for c in names]

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch.select(range(len(names)))])
            old = table.column("text").to_pylist()
            new = list(old)
            for r, starts in enumerate(batch.column(len(names)).to_pylist()):
                if starts:
                    hit = np.zeros(max(starts) + WINDOW, dtype=bool)
                    for i in starts:
                        hit[i : i + WINDOW] = True
                    new[r] = cut(old[r], hit)
            yield from _replaced(table, old, new, np.ones(len(old), dtype=bool)).to_batches()

    return found.select(*columns, F.col("_starts")).mapInArrow(run, schema)


def _word_array(column: str):
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.filter(F.split(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != "")


def remove(docs: DataFrame, benchmark: DataFrame, min_items: int = 2, limit: int = BROADCAST_BYTES) -> DataFrame:
    """docs without contaminated documents; in the rest, passages of full windows are cut out of the text.

    The columns of docs are kept, n_chars (if there is one) follows the text, and documents without hits are
    untouched. A cut passage takes everything from its first hit word to its last one.
    """
    index = broadcast_index(benchmark, limit)
    if index is None:
        return _remove_by_join(docs, benchmark, min_items)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    schema = docs.schema

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            texts = table.column("text").to_pylist()
            new, keep = list(texts), np.ones(len(texts), dtype=bool)
            encoded = [None if t is None else t.encode() for t in texts]
            for a, b in chunks(encoded, lambda t: len(t or b"") // 6, _WORDS_AT_ONCE):
                *_, found = shared.value.scan(encoded[a:b])
                for i, items in found.items():
                    if len(items) >= min_items:
                        keep[a + i] = False
                        continue
                    _, _, _, hit, _ = shared.value.scan([encoded[a + i]], least=WINDOW)
                    if hit.any():
                        new[a + i] = cut(texts[a + i], hit)
            yield from _replaced(table, texts, new, keep).to_batches()

    return docs.mapInArrow(run, schema)


def _replaced(table: pa.Table, old: list, new: list, keep: np.ndarray) -> pa.Table:
    at = table.schema.get_field_index("text")
    table = table.set_column(at, table.schema.field(at), pa.array(new, table.schema.field(at).type))
    at = table.schema.get_field_index("n_chars")
    if at >= 0:
        field = table.schema.field(at)
        sizes = [c if n == o else len(n) for c, o, n in zip(table.column(at).to_pylist(), old, new, strict=True)]
        table = table.set_column(at, field, pa.array(sizes, field.type))
    return table.filter(pa.array(keep))


def cut(text: str, hit: np.ndarray) -> str:
    """text without its runs of hit words and what stands between the words of a run."""
    data, out, last = text.encode(), [], 0
    flat = data.translate(_flat)
    place = 0
    run = None
    for i, flag in enumerate(hit.tolist()):
        while flat[place] == 32:
            place += 1
        stop = flat.find(b" ", place)
        stop = len(flat) if stop < 0 else stop
        if flag:
            run = (run[0] if run else place, stop)
        elif run:
            out.append(data[last : run[0]])
            last, run = run[1], None
        place = stop
    if run:
        out.append(data[last : run[0]])
        last = run[1]
    return b"".join([*out, data[last:]]).decode()

