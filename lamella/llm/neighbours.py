"""Approximate nearest neighbours: balanced posting lists, boundary vectors in several, a graph over their centroids.

Centroids come from balanced splits of a sample of at most SAMPLE distinct vectors; every vector is indexed. A vector
joins its nearest list and further ones almost as near (up to COPIES, none of which is nearer to a list already chosen
than to the vector). Centroids are found by best-first search of a neighbour graph, broadcast with at most MOST_LISTS
nodes. A query reads each list whose centroid is within RATIO times the distance of its LEAST-th nearest one, and goes on
to further lists while it has fewer than READ_ROWS rows for each result; there is no other bound on the lists it reads.
(A ratio to the nearest one alone reads too little where a query lies on a centroid.) Within the lists distances are
exact. Where vectors have no clusters, as independent noise in many dimensions, this reads most lists: recall comes first.

Equal vectors are indexed once, with their smallest ids, of which no query can need more than k + 1. Neighbouring lists
lie in bundles, from each of which a query gets one answer. Bundles of many rows (one hot list can be one) or of many
queries are dealt out in blocks, so no task holds more than BUNDLE_ROWS of them, about.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do those of
another length than the most frequent one (ties: the shorter); repeated rows count once; a query's own vec_id is never
among its results; without candidates there are no rows; extra columns are never read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

SAMPLE, LIST_ROWS, MOST_LISTS = 20_000, 256, 2_048
COPIES, NEAR, RATIO, LEAST, READ_ROWS = 4, 1.10, 1.15, 4, 20
#: Rows that a task holds, and queries that it answers, about.
BUNDLE_ROWS, QUERY_BLOCK = 2_048, 2_048
_DEGREE, _WIDTH, _ENTRIES = 16, 8, 8


def balanced_centroids(x: np.ndarray, leaf: int, seed: int = 0) -> np.ndarray:
    """Centroids of parts of about leaf rows: k-means with a price on size, split again until small enough."""
    rng, todo, out = np.random.default_rng(seed), [x], []
    while todo:
        part = todo.pop()
        k = min(8, -(-len(part) // leaf))
        if k <= 1:
            out.append(part.mean(axis=0))
            continue
        c = part[rng.choice(len(part), k, replace=False)]
        for _ in range(8):
            d = ((part[:, None] - c[None]) ** 2).sum(axis=2)
            price, sizes, own = d.mean() / len(part), np.zeros(k), np.zeros(len(part), dtype=np.int64)
            for block in np.array_split(rng.permutation(len(part)), min(len(part), 32)):
                own[block] = (d[block] + price * sizes).argmin(axis=1)
                sizes += np.bincount(own[block], minlength=k)
            c = np.stack([part[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(k)])
        parts = [part[own == j] for j in range(k) if (own == j).any()]
        if len(parts) == 1:  # nothing tells the rows apart
            out.append(part.mean(axis=0))
        else:
            todo += parts
    return np.array(out)


class Graph:
    """Centroids and, for each, its nearest ones and a few far ones."""

    def __init__(self, centroids: np.ndarray, seed: int = 0):
        self.c = centroids
        n, rng = len(centroids), np.random.default_rng(seed)
        self.square = (centroids**2).sum(axis=1)
        self.entries = rng.choice(n, min(n, _ENTRIES), replace=False)
        degree = min(n, _DEGREE)
        self.links = np.zeros((n, degree), dtype=np.int64)
        for i in range(0, n, 512):
            d = self.square - 2 * centroids[i : i + 512] @ centroids.T
            self.links[i : i + 512] = np.argsort(d, axis=1, kind="stable")[:, :degree]
        if n > degree:
            self.links[:, -3:] = rng.integers(0, n, (n, 3))  # long links keep the graph connected
            self.links[np.arange(n), -1] = (np.arange(n) + 1) % n

    def search(self, x: np.ndarray, least: int, ratio: float, base: int = 1) -> np.ndarray:
        """Distances (rows of x, centroids), infinite where not reached. All within ratio of the base-th best, and the
        least nearest, are looked for: best-first, until no open node is nearer than both bounds."""
        rows, n = len(x), len(self.c)
        least, base = min(least, n), min(base, n)
        found = np.full((rows, n), np.inf)
        closed = np.zeros((rows, n), dtype=bool)
        norm = (x**2).sum(axis=1)
        found[:, self.entries] = self._distance(x, norm, np.broadcast_to(self.entries, (rows, len(self.entries))))
        active = np.arange(rows)
        width = min(_WIDTH, n)
        while len(active):
            f = found[active]
            best = np.partition(f, (base - 1, least - 1), axis=1)
            bound = np.maximum(best[:, least - 1], best[:, base - 1] * ratio)
            f = np.where(closed[active] | (f > bound[:, None]), np.inf, f)
            nodes = np.argpartition(f, width - 1, axis=1)[:, :width]
            live = np.isfinite(np.take_along_axis(f, nodes, axis=1))
            going = live.any(axis=1)
            active, nodes, live = active[going], nodes[going], live[going]
            if not len(active):
                break
            nodes = np.where(live, nodes, nodes[np.arange(len(nodes)), live.argmax(axis=1)][:, None])
            closed[active[:, None], nodes] = True
            near = self.links[nodes].reshape(len(active), -1)
            found[active[:, None], near] = self._distance(x[active], norm[active], near)
        return found

    def _distance(self, x, norm, nodes):
        dot = np.einsum("rnd,rd->rn", self.c[nodes], x)
        return np.sqrt(np.maximum(self.square[nodes] - 2 * dot + norm[:, None], 0))

    def lists_for(self, x: np.ndarray) -> list[list[int]]:
        """Lists that vectors join: the nearest, and others within NEAR that no chosen one makes needless."""
        found = self.search(x, 2 * COPIES, NEAR)
        order = np.argsort(found, axis=1, kind="stable")[:, : 2 * COPIES]
        out = []
        for i, row in enumerate(order):
            chosen = [int(row[0])]
            for j in row[1:]:
                if len(chosen) == COPIES or found[i, j] > NEAR * found[i, row[0]]:
                    break
                if all(np.linalg.norm(self.c[j] - self.c[o]) > found[i, j] for o in chosen):
                    chosen.append(int(j))
            out.append(chosen)
        return out

    def lists_to_read(self, x: np.ndarray, ratio: float, sizes: np.ndarray, rows: int) -> list[list[int]]:
        """Lists within ratio of the LEAST-th nearest, and the next ones until they hold so many rows together."""
        found, out = self.search(x, 2 * LEAST, ratio, LEAST), []
        for f in found:
            order = np.argsort(f, kind="stable")
            near = int((f <= ratio * f[order[min(LEAST, len(f)) - 1]]).sum())
            enough = int(np.searchsorted(np.cumsum(sizes[order]), rows)) + 1
            n = max(near, enough)
            out.append(order[:n].tolist() if n <= np.isfinite(f).sum() else list(range(len(f))))
        return out


def _with_ties(bound: np.ndarray) -> np.ndarray:
    """A bound on squared distances less the query's own square, widened by what rounding can change."""
    return bound + 1e-9 * (1 + np.abs(bound))


def _clean(vectors: DataFrame) -> DataFrame:
    """vec_id, v (doubles), of the vectors that take part."""
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id IS NOT NULL")
    rows = rows.where(F.size("v") > 0).where(fine).withColumn("v", F.transform("v", lambda c: c + F.lit(0.0)))  # no -0.0
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.col("count").desc(), "n").limit(1).collect()
    return rows.where(F.size("v") == sizes[0].n) if sizes else rows


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, ratio: float = RATIO) -> DataFrame:
    """Nearest k of vectors for each of queries (both vec_id, embedding): query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    rows = stored(_clean(vectors), "vectors")
    copies = F.dense_rank().over(W.partitionBy("v").orderBy("vec_id"))
    once = (
        rows.withColumn("n", copies).where(F.col("n") <= k + 1)
        .groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")).select(F.col("ids")[0].alias("uid"), "v", "ids")
    )
    once = stored(once, "distinct")
    asked = _clean(queries).distinct()
    asked = stored(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.xxhash64("v").alias("place")), "asked")
    wanted = stored(asked.groupBy("q").agg(F.min("query_id").alias("quid")), "wanted")
    n = once.count()
    sample = once.orderBy(F.xxhash64("v"), "v").select("v").limit(SAMPLE).collect()
    dims = len(sample[0].v) if sample else 0
    wanted = wanted.where(F.size("q") == dims)
    lists = max(1, min(MOST_LISTS, n // LIST_ROWS))
    x = np.array([r.v for r in sample], dtype=np.float64).reshape(-1, max(1, dims))
    graph = Graph(balanced_centroids(x, max(1, len(x) // lists)) if len(x) else np.zeros((1, 1)))
    shared = spark.sparkContext.broadcast(graph)

    def place(batches):
        for pdf in batches:
            for i in range(0, len(pdf), 512):
                part = pdf.iloc[i : i + 512]
                yield part.assign(list=shared.value.lists_for(np.stack(part["v"].to_numpy())))

    each = F.explode("list").alias("list")
    postings = once.mapInPandas(place, "uid long, v array<double>, ids array<long>, list array<int>")
    postings = stored(postings.select("uid", "v", "ids", each), "postings")
    sizes = np.zeros(len(graph.c), dtype=np.int64)
    for r in postings.groupBy("list").count().collect():  # a row for each centroid at most, of which there is a bound
        sizes[r["list"]] = r["count"]
    bundle_of = np.maximum(np.cumsum(sizes) - 1, 0) // BUNDLE_ROWS
    rows_of = np.bincount(bundle_of, weights=sizes)
    blocks_of = np.maximum(1, -(-rows_of // BUNDLE_ROWS)).astype(int)
    known = [(i, int(bundle), int(blocks_of[bundle])) for i, bundle in enumerate(bundle_of)]
    bundles = F.broadcast(spark.createDataFrame(known, "list int, bundle int, blocks int"))

    def aim(batches):
        for pdf in batches:
            out = {"quid": [], "q": [], "bundle": [], "blocks": [], "lists": []}
            for i in range(0, len(pdf), 256):
                part = pdf.iloc[i : i + 256]
                found = shared.value.lists_to_read(np.stack(part["q"].to_numpy()), ratio, sizes, READ_ROWS * k)
                for quid, q, lists in zip(part["quid"], part["q"], found, strict=True):
                    lists = np.array(lists)
                    for bundle in np.unique(bundle_of[lists]):
                        own = lists[bundle_of[lists] == bundle].tolist()
                        for c, x in zip(out.values(), (quid, q, int(bundle), int(blocks_of[bundle]), own), strict=True):
                            c.append(x)
            yield pd.DataFrame(out)

    aimed = wanted.mapInPandas(aim, "quid long, q array<double>, bundle int, blocks int, lists array<int>")
    aimed = stored(aimed, "aimed")
    turns = stored(aimed.groupBy("bundle").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("turns")), "turns")
    turns = F.broadcast(turns)  # no more rows than there are bundles
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    some = lambda c, n: F.pmod(F.xxhash64(c, "bundle"), F.col(n)).cast("int")
    left = postings.join(bundles, "list").join(turns, "bundle").select("bundle", some("uid", "blocks").alias("b"), upto("turns").alias("t"), "list", "v", "ids")
    right = aimed.join(turns, "bundle").select("bundle", upto("blocks").alias("b"), some("quid", "turns").alias("t"), "quid", "q", "lists")

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        """The k + 1 nearest rows, and ties, of each query among the lists of a bundle that it reads."""
        out = {"quid": [], "score": [], "ids": []}
        if not len(a) or not len(b):
            return pd.DataFrame(out)
        a = a.sort_values("list", kind="stable")
        v, ids = np.stack(a["v"].to_numpy()), a["ids"].to_numpy()
        square = (v**2).sum(axis=1)
        names, starts = np.unique(a["list"].to_numpy(), return_index=True)
        ends = np.append(starts[1:], len(v))
        for i in range(0, len(b), 256):
            part = b.iloc[i : i + 256]
            q, quid = np.stack(part["q"].to_numpy()), part["quid"].to_numpy()
            reads = np.zeros((len(q), len(names)), dtype=bool)
            for j, lists in enumerate(part["lists"]):
                reads[j] = np.isin(names, lists)
            found = []
            for j, (x, y) in enumerate(zip(starts, ends, strict=True)):
                mine = np.flatnonzero(reads[:, j])
                if len(mine):
                    d = square[x:y] - 2 * q[mine] @ v[x:y].T
                    at, row = np.nonzero(d <= _with_ties(np.partition(d, min(k, y - x - 1), axis=1)[:, min(k, y - x - 1)])[:, None])
                    found.append((mine[at], row + x, d[at, row]))
            if not found:
                continue
            at, row, d = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((d, at))
            at, row, d = at[order], row[order], d[order]
            first, last = np.searchsorted(at, at, side="left"), np.searchsorted(at, at, side="right")
            keep = d <= _with_ties(d[np.minimum(first + k, last - 1)])
            at, row = at[keep], row[keep]
            out["quid"] += quid[at].tolist()
            out["score"] += np.sqrt(((v[row] - q[at]) ** 2).sum(axis=1)).tolist()
            out["ids"] += ids[row].tolist()
        return pd.DataFrame(out)

    keys = ["bundle", "b", "t"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(nearest, "quid long, score double, ids array<long>")
    best = W.partitionBy("quid").orderBy("score", "vec_id")
    ranked = (
        stored(near, "near").select("quid", "score", F.explode("ids").alias("vec_id"))
        .groupBy("quid", "vec_id").agg(F.min("score").alias("score"))
        .withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
        .groupBy("quid").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("best"))
    )
    named = asked.join(wanted, "q").select("query_id", "quid")
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    result = named.join(ranked, "quid").select("query_id", F.posexplode(others).alias("rank", "x"))
    return result.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
