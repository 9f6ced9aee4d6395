"""Near-duplicate passages: compact windows over min-hashes of word shingles, joined by intervals, verified exactly.

Tokens are the shingles of SHINGLE words. For a hash function, a compact window is a node of the Cartesian tree over the
hashed tokens: all subsequences whose minimum is that node's, of any length from SPAN tokens on (CompactWindows). The
windows of two hash functions are joined where they have a subsequence in common (joined); the pair of minima is the key
of a band, and the smallest such subsequence its place. Documents that share a key in any of BANDS bands are candidates.

Rows of a key never meet as pairs: in each task, and then over all, rows of a key whose third minimum agrees too link to
the first of them, and these firsts to the first row of the key. So a passage that stands in a third of all documents
leaves a task as one row, and links are linear in rows. The links of two documents are merged where they overlap, both
slices of text are fetched, and every stretch is verified: at least SPAN shingles on either side, and a Jaccard
similarity of their shingle sets of at least SIMILARITY. Equal texts are linked whole, once per task.

Windows are built only where a passage can be: where SIMILARITY of SPAN shingles are in several texts (repeated). What
hashing and stars miss is completed exactly (_completed): each window's rarest shingles are looked up in all other classes,
a text that finds as many as a passage needs is held against all texts of that class, part by part (_Block), and every pair
that hashes do not rule out is verified on its whole texts. So texts of different classes
have no passage in common by matches(), but links inside a class are not all pairs. 64-bit hashes stand for shingles.

Defined results: null and shorter texts have no passages; repeats inside one document are not links; rows that agree in
doc_id and text count once; equal hashes inside a text belong to the first node; a long text is read whole, a piece of
it fetched at a link only; null doc_ids can be part of a link, but have no component; extra columns are never read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from contextlib import contextmanager
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _ALNUM, alnum_words, as_bytes, chunks, map_arrow, stored
from .components import components

SHINGLE, SPAN, SIMILARITY, BANDS = 5, 46, 0.8, 3
MARGIN = 512
_LONG = 2**31 - 1 - MARGIN
_WORDS = SPAN + SHINGLE - 1
_BYTES_AT_ONCE, _ROWS_AT_ONCE = 1 << 21, 1 << 20
_FLAT = np.frombuffer(_ALNUM, dtype=np.uint8)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_ODD = np.random.default_rng(11).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


class _Powers:
    """Powers of the base of the rolling hash and of its inverse, modulo 2**64, grown as needed."""

    up = down = np.ones(1, dtype=np.uint64)

    @classmethod
    def of(cls, n: int):
        if len(cls.up) < n:
            n = max(n, _BYTES_AT_ONCE + 4096)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                a = np.full(n, base, dtype=np.uint64)
                a[0] = 1
                setattr(cls, name, np.multiply.accumulate(a))
        return cls.up, cls.down


def _sliding_min(h: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each span consecutive values, by doubling."""
    width, out = 1, h
    while 2 * width <= span:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[: len(h) - span + 1], out[span - width : span - width + len(h) - span + 1])


class CompactWindows:
    """Nodes of the Cartesian trees over the hashed tokens of texts, of a width of SPAN or more.

    A subsequence of SPAN tokens or more is a range [u, v] of starts of SPAN tokens, and its minimum is the least of their
    sliding minima. So the tree over the runs of equal sliding minima has just the nodes that are wide enough. Node k is
    the minimum of all ranges with left[k] <= u <= stop[k] and start[k] <= v <= right[k]: of equal minima the first counts.
    """

    def __init__(self, least: np.ndarray, inside: np.ndarray, fresh: np.ndarray, doc: np.ndarray):
        new = fresh.copy()
        new[1:] |= least[1:] != least[:-1]
        self.of = np.cumsum(new & inside) - 1  # the node of each start
        self.start = np.flatnonzero(inside & new)
        self.stop = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True))
        self.value = least[self.start]
        m = len(self.start)
        text = np.concatenate([[-1], doc[self.start], [-2]])
        value = np.concatenate([np.zeros(1, np.uint64), self.value, np.zeros(1, np.uint64)])
        # A pointer passes over nothing less than its own node, so it may go on from a node not less by that one's pointer.
        after, before = np.arange(m + 2) + 1, np.arange(m + 2) - 1
        for to, passes in ((after, np.greater_equal), (before, np.greater)):
            go = np.arange(1, m + 1)
            while len(go):
                go = go[(text[to[go]] == text[go]) & passes(value[to[go]], value[go])]
                to[go] = to[to[go]]
        #: The next node of the text that is less, or -1.
        self.after = np.where(text[after[1:-1]] == text[1:-1], after[1:-1] - 1, -1)
        self.left = self.start[before[1:-1]] if m else self.start  # of the node behind the one that is less or equal
        self.right = self.stop[after[1:-1] - 2] if m else self.stop


def joined(one: CompactWindows, two: CompactWindows) -> tuple[np.ndarray, ...]:
    """Interval join of the windows of two hash functions: each pair of nodes (i, j) that are the minima of one subsequence,
    with the starts (first, last) of its smallest one, or of all of SPAN tokens.

    Where the runs of a pair lie apart, the later one is a next less node of its tree, or one after that, as seen from the
    end of the earlier run, and not beyond the right edge of the earlier one.
    """
    edge = np.union1d(one.start, two.start)
    end = np.union1d(one.stop, two.stop)
    pairs = [(one.of[edge], two.of[edge], edge, end)]
    for a, b, turned in ((one, two, False), (two, one, True)):
        i, j = np.arange(len(a.start)), b.of[a.stop]
        while len(i):
            j = b.after[j]
            i, j = i[j >= 0], j[j >= 0]
            near = b.start[j] <= a.right[i]
            i, j = i[near], j[near]
            pairs.append((j, i, a.stop[i], b.start[j]) if turned else (i, j, a.stop[i], b.start[j]))
    return tuple(np.concatenate(v) for v in zip(*pairs, strict=True))


def _words(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of all words of the texts: hash, number of the text, first byte and the byte after it; and the texts' offsets and counts."""
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    offset = np.concatenate([[0], np.cumsum(sizes)])
    flat = _FLAT[np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)]
    up, down = _Powers.of(len(flat) + 1)
    edge = np.diff((flat != 32).astype(np.int8), prepend=0)
    first = np.flatnonzero(edge == 1)
    last = np.flatnonzero(edge == -1)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(flat.astype(np.uint64) * up[: len(flat)])])
    word = _mix((prefix[last] - prefix[first]) * down[first])
    doc = np.searchsorted(offset, first, side="right") - 1
    return word, doc, first, last, offset, np.bincount(doc, minlength=len(texts))


def _shingles(word: np.ndarray) -> np.ndarray:
    n = max(len(word) - SHINGLE + 1, 0)
    token = word[:n] * _ODD[0]
    for k in range(1, SHINGLE):
        token = token + word[k : n + k] * _ODD[k]
    return _mix(token)


def _places(low: list[int], df: list[np.ndarray], start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of shingles, from start[i] for text i, with what df says of the places from low[i] on: the first places of
    windows that can be of a passage, and how many texts hold a shingle, 0 where df is silent."""
    held = np.zeros(int(start[-1]), dtype=np.int64)
    can = np.zeros(int(start[-1]), dtype=bool)
    for at, lo, v in zip(start.tolist(), low, df, strict=False):
        held[at + lo : at + lo + len(v)] = v
        total = np.concatenate([[0], np.cumsum(v > 1)])
        can[at + lo : at + lo + len(v) - SPAN + 1] = total[SPAN:] - total[:-SPAN] >= _LEVELS[0]
    return can, held


def windows(texts: list[bytes], low: list[int] | None = None, df: list[np.ndarray] | None = None) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Rows (doc, key, sub, start, end: bytes in the text) of all bands, where low and df, if given, allow passages; per
    text a digest of its words, and their number."""
    word, doc, first, last, offset, counts = _words(texts)
    begin = np.concatenate([[0], np.cumsum(counts)])
    place = np.arange(len(word)) - begin[doc]
    digest = np.zeros(len(texts), dtype=np.uint64)
    np.add.at(digest, doc, _mix(word + place.astype(np.uint64) * _ODD[40]))
    out = {k: [np.zeros(0, t)] for k, t in (("doc", np.int64), ("key", np.uint64), ("sub", np.int64), ("start", np.int64), ("end", np.int64))}
    n = len(word) - _WORDS + 1
    if n > 0:
        token = _shingles(word)
        inside = doc[:n] == doc[_WORDS - 1 :]  # all words of the window are of one text
        if df is not None:
            inside &= _places(low, df, begin)[0][:n]
        fresh = np.ones(n, dtype=bool)
        fresh[1:] = (doc[1:n] != doc[: n - 1]) | ~inside[:-1]
        run = np.cumsum(fresh & inside)  # windows on either side of a place without any have nothing in common
        least = [_sliding_min(_mix(token * _ODD[8 + j]), SPAN) for j in range(2 * BANDS)]
        trees = [CompactWindows(v, inside, fresh, run) for v in least]
        for b in range(BANDS):
            one, two, other = trees[2 * b], trees[2 * b + 1], least[(2 * b + 2) % (2 * BANDS)]
            i, j, start, stop = joined(one, two)
            d = doc[start]
            out["doc"].append(d)
            out["key"].append(_mix(one.value[i] * _ODD[20 + b] + two.value[j] * _ODD[30 + b]))
            out["sub"].append((other[start] >> np.uint64(33)).astype(np.int64))
            out["start"].append(first[start] - offset[d])
            out["end"].append(last[stop + _WORDS - 1] - offset[d])
    return {k: np.concatenate(v) for k, v in out.items()}, digest, counts


#: Shingles sent off at once, and bytes of input to a bucket of them.
_TOKENS_AT_ONCE, _BYTES_A_BUCKET = 1 << 21, 1 << 21
_PARCEL = ["bucket", "parcel", "kind", "data"]


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of uint32 as planes of bytes, most of which are zero."""
    return b"".join(v.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for v in columns)


def _unpacked(data: bytes, columns: int) -> list[np.ndarray]:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(columns, 4, -1)
    return [np.ascontiguousarray(p.T).view("<u4").ravel().astype(np.int64) for p in planes]


def _parcels(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int32(), pa.int64(), pa.int32(), pa.binary()], strict=True)], names=_PARCEL)


def repeated(docs: DataFrame) -> DataFrame:
    """Texts (d) with places where a passage can be, and from place low to the last of these: how many texts hold the
    shingle there (df: packed). Others have none: a side of a passage has a window of SPAN shingles of which SIMILARITY
    are in another text.

    Shingles go to buckets as arrays, 40 bits of each, and are sorted there; what is in one text only does not return.
    """
    size = int(docs.select("text")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    buckets = 1 << min(max((size // _BYTES_A_BUCKET).bit_length(), 6), 12)

    def spread(batches):
        part, number, held, n = TaskContext.get().partitionId(), 0, [], 0

        def sent():
            names, sizes, token = (np.concatenate(v) for v in zip(*held, strict=True))
            parcel = (part << 32) + number
            yield _parcels([(parcel % buckets, parcel, 0, names.astype("<i8").tobytes() + sizes.astype("<i8").tobytes())])
            bucket = (token >> np.uint64(52)).astype(np.uint16) >> (12 - buckets.bit_length() + 1)
            order = np.argsort(bucket, kind="stable")
            text = np.repeat(np.arange(len(sizes)), sizes)[order]
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
            bits = token[order].view(np.uint8).reshape(-1, 8)[:, :5]
            rows = []
            for k in range(buckets):
                lo, hi = cut[k], cut[k + 1]
                if hi > lo:
                    rows.append((k, parcel, 1, bits[lo:hi].tobytes() + _packed(np.diff(order[lo:hi], prepend=0), np.diff(text[lo:hi], prepend=0))))
            yield _parcels(rows)

        for batch in batches:
            texts, names = batch.column("text").to_pylist(), batch.column("d").to_numpy()
            for a, b in chunks(texts, len, _BYTES_AT_ONCE):
                word, doc, *_, counts = _words(texts[a:b])
                token = _shingles(word)
                enough = counts >= _WORDS
                keep = enough[doc[: len(token)]] & (doc[: len(token)] == doc[len(word) - len(token) :])
                if keep.any():
                    held.append((names[a:b][enough], counts[enough] - SHINGLE + 1, token[keep]))
                    n += len(held[-1][-1])
                    if n >= _TOKENS_AT_ONCE:
                        yield from sent()
                        number, held, n = number + 1, [], 0
        if n:
            yield from sent()

    def counted(batches):
        def told(parcels, data):
            token, place, text = [], [], []
            for x in data:
                m = len(x) // 13
                bits = np.zeros((m, 8), dtype=np.uint8)
                bits[:, :5] = np.frombuffer(x[: 5 * m], dtype=np.uint8).reshape(-1, 5)
                token.append(bits.view("<u8").ravel())
                at, of = _unpacked(x[5 * m :], 2)
                place.append(np.cumsum(at))
                text.append(np.cumsum(of))
            owner = np.concatenate([t + (i << 32) for i, t in enumerate(text)])
            token = np.concatenate(token)
            order = np.argsort(token, kind="stable")
            ranked, owner = token[order], owner[order]
            new = np.append(True, ranked[1:] != ranked[:-1])
            other = new | np.append(True, owner[1:] != owner[:-1])
            group = np.cumsum(new) - 1
            df = np.zeros(len(token), dtype=np.int64)
            df[order] = np.bincount(group, weights=other)[group]
            start, rows = 0, []
            for parcel, at in zip(parcels, place, strict=True):
                mine = df[start : start + len(at)]
                start += len(at)
                more = np.flatnonzero(mine > 1)
                if len(more):
                    rows.append((0, parcel, 1, _packed(np.diff(at[more], prepend=0), mine[more])))
            return _parcels(rows)

        bucket, parcels, data = None, [], []
        for batch in batches:
            for k, parcel, kind, x in zip(*(batch.column(c).to_pylist() for c in _PARCEL), strict=True):
                if kind == 0:
                    yield _parcels([(k, parcel, kind, x)])
                    continue
                if k != bucket and data:
                    yield told(parcels, data)
                    parcels, data = [], []
                bucket = k
                parcels.append(parcel)
                data.append(x)
        if data:
            yield told(parcels, data)

    def gathered(batches):
        def placed(names, sizes, df):
            end = np.cumsum(sizes)
            start = np.concatenate([[0], end])
            total = np.concatenate([[0], np.cumsum(df > 1)])
            can = total[SPAN:] - total[:-SPAN] >= _LEVELS[0]
            text = np.repeat(np.arange(len(sizes)), sizes)
            can &= text[: len(can)] == text[SPAN - 1 :]
            at = np.flatnonzero(can)
            some, one = np.unique(text[at], return_index=True)
            lo, hi = at[one], at[np.append(one[1:], len(at)) - 1] + SPAN if len(at) else at
            found = [_packed(df[x:y]) for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
            columns = [pa.array(names[some]), pa.array((lo - start[some]).astype(np.int32)), pa.array(found, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["d", "low", "df"])

        parcel = None
        for batch in batches:
            for p, kind, x in zip(*(batch.column(c).to_pylist() for c in _PARCEL[1:]), strict=True):
                if kind == 0:
                    if parcel is not None:
                        yield placed(names, sizes, df)
                    parcel, (names, sizes) = p, np.frombuffer(x, dtype="<i8").reshape(2, -1)
                    df = np.zeros(int(sizes.sum()), dtype=np.int64)
                else:
                    at, n = _unpacked(x, 2)
                    df[np.cumsum(at)] = n
        if parcel is not None:
            yield placed(names, sizes, df)

    kinds = "bucket int, parcel long, kind int, data binary"
    sent = _named(docs).select("d", "text").mapInArrow(spread, kinds).repartition("bucket").sortWithinPartitions("bucket", "parcel")
    back = sent.mapInArrow(counted, kinds).repartition("parcel").sortWithinPartitions("parcel", "kind")
    return back.mapInArrow(gathered, "d long, low int, df binary")


_SCHEMA = "key long, sub long, d long, s int, e int, pd long, ps int, pe int"
_NAMES = [c.split()[0] for c in _SCHEMA.split(", ")]
_LINK = ["key", *_NAMES[2:]]


def _table(key, sub, d, s, e, pd=None, ps=None, pe=None) -> pa.RecordBatch:
    """Rows without pd are windows, others are links between (pd, ps, pe) and (d, s, e)."""
    none = lambda v, kind: pa.nulls(len(key), kind) if v is None else pa.array(v.astype(kind.to_pandas_dtype()))
    kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.int64()] + [pa.int32()] * 2
    return pa.RecordBatch.from_arrays([none(v, k) for v, k in zip((key, sub, d, s, e, pd, ps, pe), kinds, strict=True)], names=_NAMES)


def _combined(rows: list[dict[str, np.ndarray]]):
    """Of windows with the same key and sub, the first stays a window and the others link to it."""
    key, sub, d, s, e = (np.concatenate([r[c] for r in rows]) for c in ("key", "sub", "d", "start", "end"))
    order = np.lexsort((d, sub, key))
    key, sub, d, s, e = (v[order] for v in (key, sub, d, s, e))
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    yield _table(key[new].view(np.int64), sub[new], d[new], s[new], e[new])
    more = np.flatnonzero(~new)
    more = more[d[more] != d[head[more]]]
    if len(more):
        to = head[more]
        yield _table(key[more].view(np.int64), sub[more], d[more], s[more], e[more], d[to], s[to], e[to])


def candidates(texts: DataFrame) -> DataFrame:
    """Links (key, d, s, e) to (pd, ps, pe), the first row of the key or of key and third minimum, of texts (d, text, low,
    df) named by a hash of doc_id and text."""

    def spread(batches):
        rows, n, seen = [], 0, {}
        for batch in batches:
            texts, names = batch.column("text").to_pylist(), batch.column("d").to_numpy()
            low, df = batch.column("low").to_pylist(), [_unpacked(x, 1)[0] for x in batch.column("df").to_pylist()]
            for a, b in chunks(texts, len, _BYTES_AT_ONCE):
                found, digest, counts = windows(texts[a:b], low[a:b], df[a:b])
                copies, keep = [], np.ones(b - a, dtype=bool)
                for i, (h, c) in enumerate(zip(digest.tolist(), counts.tolist(), strict=True)):
                    if c >= _WORDS:
                        first = seen.setdefault((h, c), (int(names[a + i]), len(texts[a + i])))
                        if first[0] != names[a + i]:
                            copies.append((int(names[a + i]), len(texts[a + i]), *first))
                            keep[i] = False
                if copies:
                    d, e, pd, pe = np.array(copies, dtype=np.int64).T
                    yield _table(d, 0 * d, d, 0 * d, e, pd, 0 * d, pe)
                some = keep[found["doc"]]
                found = {k: v[some] for k, v in found.items()}
                found["d"] = names[a:b][found.pop("doc")]
                rows.append(found)
                n += len(found["d"])
                if n >= _ROWS_AT_ONCE:
                    yield from _combined(rows)
                    rows, n = [], 0
        if n:
            yield from _combined(rows)

    def linked(batches):
        pivot = first = None
        for batch in batches:
            for i, link in ((0, batch.filter(batch.column("pd").is_valid())), (1, batch.filter(batch.column("pd").is_null()))):
                if not link.num_rows:
                    continue
                if i == 0:
                    yield link.select(_LINK)
                    continue
                v = [link.column(c).to_numpy() for c in _NAMES[:5]]
                if pivot is not None:  # the key and sub-key at the end of the last batch may go on
                    v = [np.concatenate([[p, f], x]) for p, f, x in zip(pivot, first, v, strict=True)]
                key, sub = v[0], v[1]
                at = np.arange(len(key))
                other = np.append(True, key[1:] != key[:-1])
                part = other | np.append(True, sub[1:] != sub[:-1])
                top = np.maximum.accumulate(np.where(other, at, 0))
                head = np.maximum.accumulate(np.where(part, at, 0))
                to = np.where(part, top, head)
                real = (to != at) & (at >= (2 if pivot is not None else 0)) & (v[2] != v[2][to])
                pivot, first = [x[top[-1]] for x in v], [x[head[-1]] for x in v]
                m = np.flatnonzero(real)
                if len(m):
                    p = to[m]
                    kinds = [np.int64] + [np.int64, np.int32, np.int32] * 2
                    columns = [x[i].astype(k) for x, i, k in zip([key, *v[2:], *v[2:]], [m, m, m, m, p, p, p], kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_LINK)

    return (
        texts.select("d", "text", "low", "df").mapInArrow(spread, _SCHEMA)
        .repartition("key").sortWithinPartitions("key", "sub", "d")
        .mapInArrow(linked, "key long, d long, s int, e int, pd long, ps int, pe int")
    )


def _merged(links: DataFrame) -> DataFrame:
    """Links of two texts become one where they overlap or touch on both sides; passages that lie apart stay apart."""

    def run(batches):
        pair, groups = None, []
        for batch in batches:
            out = []
            for pd, d, ps, pe, s, e in zip(*(batch.column(c).to_pylist() for c in _PAIR), strict=True):
                if (pd, d) != pair:
                    out += [(*pair, *g) for g in groups]
                    pair, groups = (pd, d), []
                new, apart = [ps, pe, s, e], []
                for g in groups:
                    if g[3] + 1 < s:  # links come by s: nothing more reaches it
                        out.append((pd, d, *g))
                    elif g[0] <= new[1] + 1 and new[0] <= g[1] + 1:
                        new = [min(g[0], new[0]), max(g[1], new[1]), min(g[2], new[2]), max(g[3], new[3])]
                    else:
                        apart.append(g)
                groups = [*apart, new]
            yield _pairs(out)
        yield _pairs([(*pair, *g) for g in groups] if pair else [])

    turned = F.col("pd") > F.col("d")
    pick = lambda a, b: F.when(turned, F.col(a)).otherwise(F.col(b))
    sided = links.select(*[pick(c[-1], c).alias(c) for c in ("pd", "ps", "pe")], *[pick(f"p{c}", c).alias(c) for c in ("d", "s", "e")])
    by_place = sided.select(*_PAIR).repartition("pd", "d").sortWithinPartitions("pd", "d", "s", "ps")
    return by_place.mapInArrow(run, "pd long, d long, ps int, pe int, s int, e int")


_PAIR = ["pd", "d", "ps", "pe", "s", "e"]


def _pairs(rows: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 2 + [pa.int32()] * 4, strict=True)], names=_PAIR)


def _named(docs: DataFrame) -> DataFrame:
    named = docs.select(F.col("doc_id").cast("long"), "text").where("text IS NOT NULL")
    return named.select("doc_id", F.xxhash64("doc_id", "text").alias("d"), as_bytes("text"))


#: Hits in SPAN places: what either side of a stretch needs, what two sides of one size need, and all.
_LEVELS = (math.ceil(SPAN * SIMILARITY), math.ceil(2 * SPAN * SIMILARITY / (1 + SIMILARITY)), SPAN)


#: Different shingles of a stretch that its partner lacks, to one that it has: at most. A stretch can be covered by windows of
#: SPAN places with _LEVELS[0] hits, two over a place at most. So in one of them those lacked, each taken as half of 1 by its
#: number of places in the text, come to no more than that times those held. Where a window has less than _DIVERSE different
#: shingles, as where a word is said forty times, this says more than the places do.
_MISSES = 1 / SIMILARITY - 1
_DIVERSE = math.ceil((SPAN - _LEVELS[0]) * (0.5 + _MISSES) / _MISSES)


def _among(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Which numbers of b are in a: by a table, unless they are large for that."""
    most = int(max(a.max(initial=0), b.max(initial=0))) + 1
    if most > 65_536 + 16 * (len(a) + len(b)):
        return np.isin(b, a)
    table = np.zeros(most, dtype=bool)
    table[a] = True
    return table[b]


def _runs(true: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of true values begin and, exclusively, end; of at least one value."""
    edge = np.flatnonzero(true[1:] != true[:-1]) + 1
    edge = np.concatenate([[0] * bool(true[0]), edge, [len(true)] * bool(true[-1])]).astype(np.int64)
    return edge[::2], edge[1::2]


def _dense(hit: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Stretches made of windows of SPAN places with at least so many hits; misses at the ends go down to SPAN places."""
    if len(hit) < SPAN:
        return []
    total = np.cumsum(hit)
    if total[-1] < least:
        return []
    if total[-1] == len(hit):
        return [(0, len(hit))]
    inside = total[SPAN - 1 :].copy()
    inside[1:] -= total[:-SPAN]
    first, last = _runs(inside >= least)
    merged = []
    for lo, hi in zip(first.tolist(), (last + SPAN - 1).tolist(), strict=True):
        if merged and lo <= merged[-1][1]:
            merged[-1][1] = hi
        else:
            merged.append([lo, hi])
    out = []
    for lo, hi in merged:
        at = lo + np.flatnonzero(hit[lo:hi])
        end = max(int(at[-1]) + 1, lo + SPAN)
        out.append((min(int(at[0]), end - SPAN), end))
    return out


def _similarity(one: np.ndarray, two: np.ndarray) -> float:
    x, y = set(one.tolist()), set(two.tolist())
    common = len(x & y)
    return common / (len(x) + len(y) - common)


def _stretches(a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[float, int, int, int, int]]:
    """(similarity, from and to in a, from and to in b). Each dense stretch of either side that has a partner is in one;
    a pair that fails is narrowed to what is dense in the other, then to what is denser, and last to single windows."""
    found = []
    for lo, hi in _dense(_among(b, a), least):
        two = b[lo:hi]
        for first, last in _dense(_among(a, two), least):
            one = a[first:last]
            similarity = _similarity(one, two)
            if similarity >= SIMILARITY:
                found.append((similarity, first, last, lo, hi))
                continue
            if (last - first, hi - lo) != (len(a), len(b)):
                inner = _stretches(one, two, least)
            else:
                denser = _stretches(one, two, _LEVELS[_LEVELS.index(least) + 1]) if least < SPAN else []
                inner = denser or (_windows_alone(one, two) if least == _LEVELS[0] else [])
            found += [(s, first + x, first + y, lo + z, lo + w) for s, x, y, z, w in inner]
    if len(found) < 2:
        return found
    kept, ones, twos = [], set(), set()
    for f in sorted(set(found), key=lambda f: (-f[0] * min(f[2] - f[1], f[4] - f[3]), f)):
        if f[1:3] not in ones or f[3:] not in twos:  # a line repeated in both needs no link of all with all
            kept.append(f)
            ones.add(f[1:3])
            twos.add(f[3:])
    return kept


def _windows_alone(a: np.ndarray, b: np.ndarray) -> list[tuple[float, int, int, int, int]]:
    """Windows of SPAN shingles of b, one after the other, that are similar to the window of a which has most of theirs."""
    total = np.concatenate([[0], np.cumsum(_among(b, a))])
    order = np.argsort(a, kind="stable")
    ranked, found, next_y = a[order], [], 0
    for y in np.flatnonzero(total[SPAN:] - total[:-SPAN] >= SPAN * SIMILARITY).tolist():
        if y < next_y:
            continue
        two = np.unique(b[y : y + SPAN])
        places = np.sort(np.concatenate([order[lo:hi] for lo, hi in zip(np.searchsorted(ranked, two), np.searchsorted(ranked, two, "right"), strict=True)]))
        most = np.argmax(np.searchsorted(places, places + SPAN) - np.arange(len(places)))
        x = min(int(places[most]), len(a) - SPAN)
        similarity = _similarity(a[x : x + SPAN], two)
        if similarity >= SIMILARITY:
            found.append((similarity, x, x + SPAN, y, y + SPAN))
            next_y = y + SPAN
    return found


def _tuples(text: bytes):
    words = alnum_words(text)
    return zip(*(words[k:] for k in range(SHINGLE)), strict=False)


def _numbers() -> defaultdict:
    """Numbers of things in order of their first appearance."""
    return defaultdict(count().__next__)


def matches(a: bytes, b: bytes) -> list[tuple[float, int, int, int, int]]:
    """(similarity, first word and number of words in a, the same in b) of every stretch by the rule of SPAN and SIMILARITY.

    A stretch with that similarity has SIMILARITY of its shingles in the other, so some window of SPAN of them has.
    """
    if a == b:
        n = len(alnum_words(a))
        return [(1.0, 0, n, 0, n)] if n >= _WORDS else []
    known = _numbers()
    one = np.fromiter(map(known.__getitem__, _tuples(a)), np.int64)
    new = len(known)
    two = np.fromiter(map(known.__getitem__, _tuples(b)), np.int64)
    if np.count_nonzero(two < new) < _LEVELS[0]:
        return []
    more = SHINGLE - 1
    return [(s, x, y - x + more, z, w - z + more) for s, x, y, z, w in _stretches(one, two, _LEVELS[0])]


def _slice(text, s: str, e: str):
    """Bytes s to e of a text and MARGIN more on either side, where an edit can have cut the windows short. The text
    counts as ending with a blank."""
    return F.expr(f"substring(concat({text}, X'20'), greatest({s} - {MARGIN}, 0) + 1, {e} + {MARGIN} - greatest({s} - {MARGIN}, 0))")


def _whole_words(text: bytes, s: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A slice without the words cut by its edges, the first byte of each word in the text, and the byte after it."""
    at = max(s - MARGIN, 0)
    none = np.zeros(0, dtype=np.int64)
    first, last = _runs(_FLAT[np.frombuffer(text, dtype=np.uint8)] != 32) if text else (none, none)
    whole = ((first > 0) | (at == 0)) & (last < len(text))
    first, last = first[whole], last[whole]
    return (text[first[0] : last[-1]] if len(first) else b""), first + at, last + at


_FOUND = "pd long, d long, left_id long, right_id long, left_byte int, left_end int, right_byte int, right_end int, similarity double, left_word int, left_words int, right_word int, right_words int"


def _first_in(shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each place, the windows of SPAN places, from and to, where it is the first one of its shingle."""
    order, place = np.argsort(shingle, kind="stable"), np.arange(len(shingle))
    before = np.full(len(shingle), -1)
    before[order[1:]] = np.where(shingle[order[1:]] == shingle[order[:-1]], order[:-1], -1)
    return np.maximum(before, place - SPAN) + 1, place + 1


def _margin(hit: np.ndarray, shingle: np.ndarray) -> float | None:
    """None if no window of SPAN shingles, given by numbers from 0, has as many hits as a passage needs, by place and by
    _MISSES. Else how many shingles at most a stretch has in common with its partner beyond the share of its own that two
    sides of one size need: what one side lacks of that, the other has over."""
    total = np.concatenate([[0], np.cumsum(hit)])
    dense = total[SPAN:] - total[:-SPAN] >= _LEVELS[0]
    if not dense.any():
        return None
    times = np.bincount(shingle)
    if len(times) < len(shingle):
        n = len(dense)
        first, last = _first_in(shingle)
        first, last = np.minimum(first, n), np.minimum(last, n)
        some = first < last
        weight = np.where(hit, _MISSES, -0.5 / times[shingle])[some]
        change = np.bincount(first[some], weight, n + 1) - np.bincount(last[some], weight, n + 1)
        if not (dense & (np.cumsum(change)[:n] >= -1e-6)).any():
            return None
    share = 2 * SIMILARITY / (1 + SIMILARITY)
    gain = np.concatenate([[0], np.cumsum(np.where(hit, 1 - share, -share / times[shingle]))])
    return float((gain[SPAN:] - np.minimum.accumulate(gain[:-SPAN])).max())


def _hashed(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Of each text: its different shingles in order, which of them stand at its places, and the fewest of any SPAN places."""
    out = []
    for a, b in chunks(texts, len, _BYTES_AT_ONCE):
        word, *_, counts = _words(texts[a:b])
        shingle, end = _shingles(word), np.cumsum(counts)
        for e, n in zip(end.tolist(), counts.tolist(), strict=True):
            known, at = np.unique(shingle[e - n : max(e - SHINGLE + 1, e - n)], return_inverse=True)
            fewest = 0
            if len(at) >= SPAN:
                first, last = _first_in(at)
                change = np.bincount(first, minlength=len(at)) - np.bincount(last, minlength=len(at))[: len(at)]
                fewest = int(np.cumsum(change)[: len(at) - SPAN + 1].min())
            out.append((known, at, fewest))
    return out


def _alike(one: tuple, two: tuple) -> bool:
    """Whether each of two texts, by _hashed, has a window of SPAN shingles with as many of the other's as a passage needs."""
    (a, i, _), (b, j, _) = one, two
    if min(len(i), len(j)) < SPAN:
        return False
    if len(a) > len(b):
        a, i, b, j = b, j, a, i
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    common = b[at] == a
    held = np.zeros(len(b), dtype=bool)
    held[at[common]] = True
    left = _margin(common[i], i)
    right = None if left is None else _margin(held[j], j)
    return right is not None and left + right >= -1e-6


def _sieved(pairs: list[tuple[bytes, bytes]]) -> list[bool]:
    """Whether two texts can have a passage, by _alike. A text of several pairs is hashed once."""
    texts = list(dict.fromkeys(t for pair in pairs for t in pair))
    token = dict(zip(texts, _hashed(texts), strict=True))
    return [_alike(token[a], token[b]) for a, b in pairs]


class _Block:
    """Texts of a class, by _hashed, that others are held against: first all at once, then by how many shingles they have in
    common, and last one by one."""

    def __init__(self, texts: list[tuple]):
        self.texts = texts
        self.known, at = np.unique(np.concatenate([t[0] for t in texts]), return_inverse=True)
        self.holds = np.zeros((len(self.known), len(texts)), dtype=bool)
        self.holds[at, np.repeat(np.arange(len(texts)), [len(t[0]) for t in texts])] = True
        self.fewest = np.array([t[2] for t in texts])

    def alike(self, one: tuple) -> list[tuple[int, int]]:
        """(number of the text, different shingles in common) of texts that can have a passage in common with this one."""
        known, places, fewest = one
        if len(places) < SPAN:
            return []
        at = np.minimum(np.searchsorted(self.known, known), len(self.known) - 1)
        hit = self.known[at] == known
        if _margin(hit[places], places) is None:
            return []
        common = np.count_nonzero(self.holds[at[hit]], axis=0)
        # either side of a stretch has the different shingles of a window or more
        enough = common + 1e-6 >= SIMILARITY / (1 + SIMILARITY) * (self.fewest + fewest)
        return [(k, int(common[k])) for k in np.flatnonzero(enough).tolist() if _alike(one, self.texts[k])]


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Every passage of pairs of slices, by _FOUND."""
    left = pairs.join(texts.withColumnRenamed("d", "pd"), "pd").select("pd", "d", "s", "e", "ps", F.col("doc_id").alias("left_id"), _slice("text", "ps", "pe").alias("a"))
    both = left.join(texts, "d").select("pd", "d", "left_id", F.col("doc_id").alias("right_id"), "ps", "s", "a", _slice("text", "s", "e").alias("b"))

    def verify(batch):
        rows = []
        for pd, d, i, j, ps, s, a, b in zip(*(batch.column(c).to_pylist() for c in ("pd", "d", "left_id", "right_id", "ps", "s", "a", "b")), strict=True):
            (a, one, end), (b, two, stop) = _whole_words(a, ps), _whole_words(b, s)
            rows += [(pd, d, i, j, one[x], end[x + n - 1], two[y], stop[y + m - 1], similarity, 0, n, 0, m) for similarity, x, n, y, m in matches(a, b)]
        kinds = [pa.int64()] * 4 + [pa.int32()] * 4 + [pa.float64()] + [pa.int32()] * 4
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        names = [c.split()[0] for c in _FOUND.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return map_arrow(both, verify, _FOUND)


#: So many different shingles of a window are looked up in other texts, if they are in _SELDOM texts at most; more than the
#: misses it may have in any case. And pairs of a text that are tried first.
_PROBES, _SELDOM, _FEW = 25, 100, 8


def _chosen(can: np.ndarray, held: np.ndarray, token: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places to look up: in each window that can be of a passage, the rarest different shingles of those that are in
    several texts. Of a window with this place, how many of them the other text of a passage holds at least: as many as
    are looked up but for misses, which are SPAN - _LEVELS[0] places at most and no more than _MISSES allows. And what
    the place is looked up for: 1 a window whose rarest are in _SELDOM texts at most, 2 one where they are not, 3 both."""
    m = len(token)
    rank = np.lexsort((token, held, text))
    new = np.append(True, (token[rank[1:]] != token[rank[:-1]]) | (text[rank[1:]] != text[rank[:-1]]))[:m]
    order, before, weight = np.empty(m, dtype=np.int32), np.full(m, -1), np.empty(m)
    group = np.cumsum(new)
    order[rank] = group
    weight[rank] = 0.5 / np.bincount(group)[group]
    before[rank[1:]] = np.where(new[1:], -1, rank[:-1])  # equal shingles stay in order
    single, seldom = held < 2, (held > 1) & (held <= _SELDOM)
    order[single] = m + 1
    alone = np.concatenate([[0], np.cumsum(single)])
    need, why, at = np.full(m, SPAN), np.zeros(m, dtype=np.int32), np.flatnonzero(can)
    for a in range(0, len(at), 1 << 13):
        some = at[a : a + (1 << 13)]
        place = some[:, None] + np.arange(SPAN)
        first = before[place] < some[:, None]
        misses = SPAN - _LEVELS[0] - (alone[some + SPAN] - alone[some])
        low = np.flatnonzero(first.sum(axis=1) < _DIVERSE)
        if len(low):
            lone, weigh = single[place[low]], np.where(first[low], weight[place[low]], 0)
            both = (first[low] & ~lone).sum(axis=1)
            lacked = (weigh * lone).sum(axis=1)
            more = np.sort(np.where(first[low] & ~lone, weigh, SPAN), axis=1).cumsum(axis=1)
            fits = lacked[:, None] + more <= _MISSES * (both[:, None] - np.arange(1, SPAN + 1)) + 1e-6
            misses[low] = np.where(lacked <= _MISSES * both + 1e-6, np.minimum(misses[low], fits.sum(axis=1)), -1)
            able = misses >= 0
            some, place, first, misses = some[able], place[able], first[able], misses[able]
        ranks = np.where(first, order[place], m + 1)
        ranks.sort(axis=1)
        few = (first & seldom[place]).sum(axis=1)
        many = np.minimum(np.maximum(np.minimum(few, _PROBES), misses + 1), (ranks <= m).sum(axis=1))
        bound = ranks[np.arange(len(some)), many - 1]
        i, j = np.nonzero(order[place] <= bound[:, None])
        looked, least = place[i, j], many - misses
        np.minimum.at(need, looked, least[i])
        often = few <= misses
        why[looked[~often[i]]] |= 1
        why[looked[often[i]]] |= 2
    return why > 0, need, why


_ROWS = ["key", "d", "root", "n", "m"]


def _rows_of(texts: DataFrame) -> DataFrame:
    """(key, d, root, n, m) of texts (d, root, text, low, df) with a window that can be of a passage by _chosen: each shingle of
    several texts that lies in a window that can be by places; if it is to be looked up, n such shingles are to be found
    with it, else 0. m: why it is looked up, and 4 more if any of the text is for 2."""

    def run(batches):
        for batch in batches:
            texts, low = batch.column("text").to_pylist(), batch.column("low").to_pylist()
            names, roots = batch.column("d").to_numpy(), batch.column("root").to_numpy()
            df = [_unpacked(x, 1)[0] for x in batch.column("df").to_pylist()]
            for a, b in chunks(texts, len, _BYTES_AT_ONCE):
                word, doc, *_, counts = _words(texts[a:b])
                token = _shingles(word)
                can, held = (v[: len(token)] for v in _places(low[a:b], df[a:b], np.concatenate([[0], np.cumsum(counts)])))
                chosen, need, why = _chosen(can, held, token, doc[: len(token)])
                asks, often = (np.bincount(doc[: len(token)], v, b - a) > 0 for v in (chosen, why & 2))
                begun = np.concatenate([[0], np.cumsum(can)])
                at = np.arange(len(token))
                at = at[asks[doc[at]] & (held > 1) & (begun[at + 1] > begun[np.maximum(at - SPAN + 1, 0)])]
                at = at[np.lexsort((token[at], doc[at]))]
                key, of = token[at], doc[at]
                new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (of[1:] != of[:-1]))[: len(at)])
                n = m = np.zeros(0, dtype=np.int32)
                if len(at):
                    m = np.bitwise_or.reduceat(why[at], new)
                    n = np.where(m > 0, np.minimum.reduceat(need[at], new), 0).astype(np.int32)
                    m = (m | 4 * often[of[new]]).astype(np.int32)
                columns = [key[new].view(np.int64), names[a:b][of[new]], roots[a:b][of[new]], n, m]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_ROWS)

    return texts.select("d", "root", "text", "low", "df").mapInArrow(run, "key long, d long, root long, n int, m int")


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows of keys that are of several classes and to be looked up by one of them."""

    def kept(key, d, root, n, m):
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))[: len(key)]
        some = np.zeros(0, dtype=bool)
        if len(key):
            several = (np.minimum.reduceat(root, start) != np.maximum.reduceat(root, start)) & (np.maximum.reduceat(n, start) > 0)
            some = np.repeat(several, np.diff(np.append(start, len(key))))
        return pa.RecordBatch.from_arrays([pa.array(v[some]) for v in (key, d, root, n, m)], names=_ROWS)

    def run(batches):
        held, size = [], 0  # the last key of a batch may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            v = [batch.column(c).to_numpy() for c in _ROWS]
            if held and v[0][0] == v[0][-1] == held[-1][0][-1]:
                held.append(v)
                continue
            v = [np.concatenate(x) for x in zip(*held, v, strict=True)]
            last = int(np.searchsorted(v[0], v[0][-1]))
            yield kept(*(x[:last] for x in v))
            held = [[x[last:] for x in v]]
        if held:
            yield kept(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, d long, root long, n int, m int")


#: Texts of a class that others are held against in one task, and different shingles of them at once.
_MEMBERS, _KNOWN = 64, 1 << 16


def _asked(rows: DataFrame) -> DataFrame:
    """(d, other, parts): texts that are to be held against all of another class, which has so many parts of _MEMBERS. Of two
    texts with a passage, each has a window that finds enough in the other, and so in the other's class. So it is enough
    that those of the smaller class ask; but a window whose rarest shingles are in many texts is held against texts with
    such windows only, and other texts ask these from the larger class too."""
    often = F.col("m") >= 4
    sizes = rows.select("d", "root").distinct().groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    sized = rows.join(sizes, "root")
    probes = sized.where("n > 0").select("key", "d", "root", "size", "n", (F.col("m").bitwiseAND(1) > 0).alias("all"), often.alias("mine"))
    of_class = sized.groupBy("key", F.col("root").alias("other")).agg(F.max(often).alias("often"), F.max("size").alias("others"))
    asks = "root <> other AND (all OR often) AND (size < others OR size = others AND root < other OR often AND NOT mine)"
    counted = [F.count(F.lit(1)).alias("found"), F.min("n").alias("n"), F.max("others").alias("others")]
    found = probes.join(of_class, "key").where(asks).groupBy("d", "other").agg(*counted).where("found >= n")
    return found.select("d", "other", F.ceil(F.col("others") / _MEMBERS).cast("int").alias("parts"))


def _unjoined(asked: DataFrame, rows: DataFrame, texts: DataFrame) -> DataFrame:
    """All pairs (pd < d) of texts that ask a class and texts of it that can have a passage, by _Block, and how many different
    shingles they have in common. Texts of a class meet those that ask it by parts, in a stream, and never as rows of pairs."""
    text = texts.select("d", "text")
    ask = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("other", "part", F.lit(1).alias("kind"), "d")
    parts = asked.groupBy("other").agg(F.max("parts").alias("parts"))
    members = rows.select("d", F.col("root").alias("other")).distinct().join(parts, "other")
    told = members.select("other", F.expr("CAST(pmod(d, parts) AS int)").alias("part"), F.lit(0).alias("kind"), "d")
    both = told.union(ask).join(text, "d").select("other", "part", "kind", "d", "text")

    def run(batches):
        part, names, held, blocks = None, [], [], None
        for batch in batches:
            out = []
            for other, p, kind, d, h in zip(*(batch.column(c).to_pylist() for c in ("other", "part", "kind", "d")), _hashed(batch.column("text").to_pylist()), strict=True):
                if (other, p) != part:
                    part, names, held, blocks = (other, p), [], [], None
                if kind == 0:
                    names.append(d)
                    held.append(h)
                    continue
                if blocks is None:
                    blocks = [(a, _Block(held[a:b])) for a, b in chunks(held, lambda t: len(t[0]), _KNOWN)]
                out += [(min(d, names[a + k]), max(d, names[a + k]), n) for a, block in blocks for k, n in block.alike(h)]
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["pd", "d", "found"])

    alike = both.repartition("other", "part").sortWithinPartitions("other", "part", "kind").mapInArrow(run, "pd long, d long, found long")
    return alike.groupBy("pd", "d").agg(F.max("found").alias("found"))


def _completed(texts: DataFrame, found: DataFrame) -> DataFrame:
    """Passages of texts that have one and are not of one class by what was found: of the likeliest pairs of each text, then of
    all that are still of different classes."""
    whole = [F.lit(v).alias(c) for c, v in (("ps", 0), ("pe", _LONG), ("s", 0), ("e", _LONG))]
    linked = found.select(F.col("pd").alias("a"), F.col("d").alias("b"))
    of = texts.select("d", F.xxhash64("text").alias("h")).join(components(linked).withColumnRenamed("node", "d"), "d", "left")
    one = of.groupBy(F.coalesce("root", "d").alias("root"), "h").agg(F.min("d").alias("d"))  # equal texts of a class say the same
    rooted = texts.select("d", "text", "low", "df").join(one.select("d", "root"), "d")
    rows = stored(_mixed(_rows_of(rooted)), "mixed")
    best = Window.partitionBy("d").orderBy(F.desc("found"), "pd")
    asked = stored(_asked(rows), "asked")
    pairs = stored(_unjoined(asked, rows, texts).withColumn("i", F.row_number().over(best)), "pairs")

    def proved(some):
        return stored(_verified(some.select("pd", "d", *whole), texts), "proved")

    first = proved(pairs.where(F.col("i") <= _FEW))
    roots = components(linked.union(first.select("pd", "d")))
    left, right = (roots.select(F.col("node").alias(c), F.col("root").alias(r)) for c, r in (("pd", "x"), ("d", "y")))
    apart = pairs.where(F.col("i") > _FEW).join(left, "pd", "left").join(right, "d", "left").where(F.coalesce("x", "pd") != F.coalesce("y", "d"))
    return first.union(proved(apart))


@contextmanager
def _shuffles_removed(spark):
    """Files of shuffles go when the table that they were made for is written, not when the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def passages(docs: DataFrame) -> DataFrame:
    """Verified links: left_id, right_id, similarity, and of each side the passage's words (from 0 in the slice of text
    that begins at byte left_byte or right_byte) as left_byte, left_word, left_words, and so for the right."""
    with _shuffles_removed(docs.sparkSession):
        places = stored(repeated(docs).dropDuplicates(["d"]), "places")
        texts = stored(_named(docs).join(places, "d").dropDuplicates(["d"]), "texts")
        found = stored(_verified(stored(_merged(candidates(texts)), "passages"), texts), "verified")
        return found.union(_completed(texts, found)).drop("pd", "d", "left_end", "right_end").distinct()


def classes(docs: DataFrame, links: DataFrame) -> DataFrame:
    """One row per document: doc_id, component_id (smallest doc_id reachable by links, itself included), n_links (number of
    documents that links of it name), n_passages (number of its links). A null doc_id has no component."""
    ends = stored(links.select(F.col("left_id").alias("a"), F.col("right_id").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), "ends")
    both = ends.where("NOT a <=> b").union(ends.where("NOT a <=> b").select("b", "a", "n")).groupBy("a", "b").agg(F.sum("n").alias("n"))
    linked = both.groupBy("a").agg(F.count(F.lit(1)).alias("n_links"), F.sum("n").alias("n_passages"))
    roots = components(ends.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b"))
    known = linked.join(roots, F.col("a") == F.col("node"), "left").select("a", "root", "n_links", "n_passages")
    zero = F.lit(0).cast("long")
    return (
        docs.select(F.col("doc_id").cast("long"))
        .join(known, F.col("doc_id").eqNullSafe(F.col("a")), "left")
        .select("doc_id", F.coalesce("root", "doc_id").alias("component_id"), F.coalesce("n_links", zero).alias("n_links"), F.coalesce("n_passages", zero).alias("n_passages"))
    )


def remove_repeats(docs: DataFrame, links: DataFrame) -> DataFrame:
    """docs with one document of each component of links: the one of the smallest doc_id. Rows of one doc_id all stay or
    all go; null doc_ids stay."""
    gone = classes(docs, links).where("doc_id <> component_id").select(F.col("doc_id").alias("_repeated")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("_repeated"), "left_anti")
