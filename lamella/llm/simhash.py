"""SimHash near-duplicates: tiled exact comparison by exclusive-or and bit counts.

A fingerprint has 64 bits over the XXH64 (seed 42) of the word shingles of a whole text. Fingerprints that differ in at
most RADIUS bits link; documents with the same fingerprint are one node. Comparing every tile with every other one
would grow with the square of the input, so the tiles are laid inside *bands*: of m blocks of bits, two fingerprints
within RADIUS of each other agree in at least m - RADIUS whole blocks, hence they meet in a bucket of at least one
choice of blocks. The buckets are compared exactly, tile by tile in order of bit counts; tile pairs whose bit counts
differ by more than RADIUS are skipped. Nothing is approximate: every link is found at every size. A bucket above
BUCKET_ROWS is dealt out as pairs of tiles, so no task holds it whole.

Only a spanning forest of the links of each tile pair leaves it, which keeps components and is linear in the rows.

Defined results: null and word-less texts have fingerprint 0 and link like any other; a text of fewer words than a
shingle is one shingle; a null doc_id takes part, and a component of null ids alone has a null component_id; repeated
rows are each returned; extra columns are never read.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import as_bytes, map_arrow, space_words, stored
from .components import components

SHINGLE, SEED, RADIUS = 4, 42, 4
TILE, BUCKET_ROWS = 1024, 2048
_SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    words = space_words(text)
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(line, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    total = len(words) - shingle + 1
    ends = ends[shingle - 1 :].tolist()
    sums = np.zeros(64, dtype=np.int64)
    for at in range(0, total, _SHINGLES_AT_ONCE):
        part = slice(at, min(at + _SHINGLES_AT_ONCE, total))
        h = np.fromiter(
            (xxh64_intdigest(line[s:e], SEED) for s, e in zip(starts[part], ends[part], strict=False)),
            dtype="<u8", count=part.stop - part.start,
        )
        sums += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * sums > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and the fingerprint as a signed 64-bit number."""

    def run(batch):
        f = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(f.view(np.int64))], names=["doc_id", "f"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), as_bytes("text")), run, "doc_id long, f long")


class _Forest:
    def __init__(self, n: int):
        self.up, self.label = list(range(n)), np.arange(n)

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, pairs) -> None:
        for a, b in pairs:
            a, b = self.find(a), self.find(b)
            if a != b:
                self.up[max(a, b)] = min(a, b)
        self.label = np.array([self.find(i) for i in range(len(self.up))])


def tile_forest(values: np.ndarray, radius: int = RADIUS, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among values (uint64): each joins a value with its tree's first one."""
    bits = np.bitwise_count(values)
    order = np.argsort(bits, kind="stable")
    values, bits = values[order], bits[order].astype(np.int64)
    forest = _Forest(len(values))
    for i in range(0, len(values), tile):
        for j in range(i, len(values), tile):
            if bits[j] - bits[min(i + tile, len(values)) - 1] > radius:
                break  # later tiles only have more bits
            near = np.bitwise_count(values[i : i + tile, None] ^ values[None, j : j + tile]) <= radius
            if i == j:
                np.fill_diagonal(near, False)
            while True:
                near &= forest.label[i : i + tile, None] != forest.label[None, j : j + tile]
                rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
                if not len(rows):
                    break
                forest.join(zip((i + rows).tolist(), (j + near[rows].argmax(axis=1)).tolist(), strict=True))
                forest.join(zip((i + near[:, columns].argmax(axis=0)).tolist(), (j + columns).tolist(), strict=True))
    tied = np.flatnonzero(forest.label != np.arange(len(values)))
    return values[tied], values[forest.label[tied]]


def blocks_for(n: int, radius: int = RADIUS) -> int:
    """Number of blocks with the least work for n fingerprints. Any number finds every link; this only sets the cost."""

    def work(m: int) -> float:
        return comb(m, radius) * n * (300 + n / 2 ** (64 * (m - radius) / m))

    return min(range(radius + 1, radius + 5), key=work)


def _masks(m: int, radius: int) -> list[int]:
    cuts = [round(64 * i / m) for i in range(m + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) - (1 << 64 if sum(c) >> 63 else 0) for c in combinations(masks, m - radius)]


def links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """A spanning forest (a, b) of each bucket's links among distinct fingerprints f."""
    masks = _masks(blocks_for(nodes.count(), radius), radius)
    banded = nodes.select(
        "f", F.bit_count("f").cast("int").alias("p"),
        F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.col("f").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])).alias("x"),
    ).select("f", "p", "x.*")
    sizes = banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    banded = stored(banded.join(sizes, ["band", "key"]), "bands")
    hot = banded.where(F.col("n") > bucket_rows)
    tiles = hot.groupBy("band", "key", "p").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    own = tiles.withColumnRenamed("tiles", "mine")
    other = tiles.select("band", "key", F.col("p").alias("q"), "tiles")
    mine = F.struct(F.col("p"), F.expr("cast(pmod(xxhash64(f), mine) as int)").alias("s"))
    spread = (
        hot.join(own, ["band", "key", "p"])
        .join(other, ["band", "key"])
        .where(F.abs(F.col("p") - F.col("q")) <= radius)  # tile pairs further apart are skipped
        .select("band", "key", "f", mine.alias("mine"), "q", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("s"))
        .withColumn("theirs", F.struct(F.col("q").alias("p"), "s"))
        .select("band", "key", F.least("mine", "theirs").alias("lo"), F.greatest("mine", "theirs").alias("hi"), "f")
    )
    none = F.struct(F.lit(-1).alias("p"), F.lit(-1).alias("s"))
    units = (
        banded.where(F.col("n") <= bucket_rows)
        .select("band", "key", none.alias("lo"), none.alias("hi"), "f")
        .union(spread)
        .select(F.xxhash64("band", "key", "lo", "hi").alias("unit"), "f")
        .repartition("unit")
        .sortWithinPartitions("unit")
    )

    def run(batches):
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            unit, f = batch.column("unit").to_numpy(), batch.column("f").to_numpy()
            if not len(unit):
                continue
            if kept:
                unit = np.concatenate([kept[0][0], unit])
                f = np.concatenate([kept[0][1], f])
            last = int(np.searchsorted(unit, unit[-1]))
            yield _edges(unit[:last], f[:last])
            kept = [(unit[last:], f[last:])]
        if kept:
            yield _edges(*kept[0])

    def _edges(unit, f):
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        cuts = np.flatnonzero(np.diff(unit)) + 1
        for group in np.split(f, cuts):
            if len(group) > 1:
                x, y = tile_forest(group.view(np.uint64), radius, tile)
                a.append(x.view(np.int64))
                b.append(y.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return units.mapInArrow(run, "a long, b long")


def _rooted(nodes: DataFrame, radius: int) -> DataFrame:
    """nodes, with the fingerprint that names their component."""
    roots = stored(components(links(nodes.select("f"), radius)), "roots")
    return nodes.join(roots, F.col("f") == F.col("node"), "left").withColumn("root", F.coalesce("root", "f")).drop("node")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    prints = stored(fingerprints(docs), "fingerprints")
    nodes = stored(prints.groupBy("f").agg(F.min("doc_id").alias("least")), "nodes")
    tree = _rooted(nodes, radius)
    least = tree.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = tree.join(least, "root").select("f", "component_id")
    return prints.join(by_print, "f").select(
        "doc_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs with one document of each component: the smallest (doc_id, hash of the whole row; null ids last).

    Rows that agree in every column are one document, so of those too a single row stays. The columns of docs are kept.
    """
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    prints = stored(_named_prints(docs, whole), "fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    nodes = stored(prints.groupBy("f").agg(F.min(place).alias("least")), "nodes")
    kept = _rooted(nodes, radius).groupBy("root").agg(F.min("least").alias("k")).select("k.doc_id", "k.row")
    chosen = kept.select(F.col("doc_id").alias("_kept_id"), F.col("row").alias("_kept_row"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_kept_id")) & (whole == F.col("_kept_row"))
    repeated = prints.groupBy("doc_id", "row").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = docs.join(chosen, same, "left_semi")
    return found if repeated.isEmpty() else found.dropDuplicates()


def _named_prints(docs: DataFrame, whole) -> DataFrame:
    def run(batch):
        f = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64)
        columns = [batch.column("doc_id"), batch.column("row"), pa.array(f.view(np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "f"])

    chosen = docs.select(F.col("doc_id").cast("long"), whole.alias("row"), as_bytes("text"))
    return map_arrow(chosen, run, "doc_id long, row long, f long")
