"""Approximate nearest neighbours: a forest of random-projection trees, searched through one priority queue.

The trees are fitted on the driver on a bounded sample (``FIT_ROWS`` vectors of at most ``FIT_BYTES``, the least hashes of vec_id).
All nodes of one depth of a tree share a random direction; each inner node splits at the median of its sample's projections. Every
vector is assigned a leaf of each tree. A query descends all trees through a shared queue ordered by the least margin passed so far
(the path's worst violated margin), and takes leaves until their expected distinct rows reach a share of all rows.

The share and the number of trees follow the data (``fitted``): neighbours of sample vectors within the sample tell for each number of
trees at which share the queue meets ``RECALL`` of them, and the number that then scores the fewest rows is taken. Clustered vectors
need a small share; among nearly isotropic ones no index separates near from far by much, and the share is large.

Queries and vectors meet by (tree, leaf); a leaf's rows are cut into slices and its queries into blocks of bounded size, so no group is
unbounded, and a leaf's rows are copied only for the blocks of queries that really visit it; leaves without a query are not moved. In
each group cosines in double precision are one matrix product; a lot of several groups gives the best k of each query; the last step joins them by query.

Defined results: vectors null, zero, of another length than the most common one (of two: the shorter), or with null or non-finite components
take no part, neither as queries nor as candidates. Null vec_ids take no part. Repeated rows are candidates each on their own; a query's
candidates exclude rows of its own vec_id; of query rows that share a vec_id a candidate counts by its best score, and they have one list.
Ties go to the smaller vec_id. Without usable vectors or queries: no rows. Other columns are not touched, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, drop, prepare, written

FIT_ROWS, FIT_BYTES = 16_384, 32 << 20
TREES = (2, 4, 8)
LEAF_ROWS = 64
MOST_LEAVES = 4096
RECALL = 0.96
PROBES = 400
SLICE_ROWS = 4096
BLOCK_QUERIES = 4096
LOT_ROWS = 16_384


class Forest:
    """Trees as flat arrays: inner node i of a tree has cut[i] on its depth's direction; children 2i+1 (below) and 2i+2."""

    def __init__(self, sample: np.ndarray, trees: int, leaves: int, seed: int = 11):
        self.depth = max(0, int(np.log2(max(1, leaves))))
        self.inner = (1 << self.depth) - 1
        self.direction = np.random.default_rng(seed).normal(size=(trees, self.depth, sample.shape[1]))
        self.direction /= np.maximum(np.linalg.norm(self.direction, axis=2, keepdims=True), 1e-12)
        self.cut = np.zeros((trees, self.inner))
        self.share = np.zeros((trees, 1 << self.depth))
        at = self._projected(sample)
        for t in range(trees):
            node = np.zeros(len(sample), np.int64)
            for d in range(self.depth):
                base, x = (1 << d) - 1, at[:, t, d]
                order = np.lexsort((x, node))
                many = np.bincount(node - base, minlength=1 << d)
                middle = np.cumsum(many) - many + np.maximum(many - 1, 0) // 2
                self.cut[t, base : base + (1 << d)] = np.where(many > 0, x[order[np.minimum(middle, len(order) - 1)]], 0.0)
                node = 2 * node + 1 + (x > self.cut[t, node])
            self.share[t] = np.bincount(node - self.inner, minlength=1 << self.depth) / len(sample)

    def _projected(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees, depth)"""
        trees = len(self.direction)
        return (x @ self.direction.reshape(trees * self.depth, x.shape[1]).T).reshape(len(x), trees, self.depth)

    def first(self, trees: int) -> Forest:
        """The forest of the first trees only."""
        out = object.__new__(Forest)
        out.depth, out.inner = self.depth, self.inner
        out.direction, out.cut, out.share = self.direction[:trees], self.cut[:trees], self.share[:trees]
        return out

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        at, trees = self._projected(x), np.arange(len(self.cut))
        node = np.zeros((len(x), len(trees)), np.int64)
        for d in range(self.depth):
            node = 2 * node + 1 + (at[:, :, d] > self.cut[trees, node])
        return (node - self.inner).astype(np.int32)

    def margins(self, x: np.ndarray) -> np.ndarray:
        """How far a vector lies beyond each node's cut."""
        depth = np.repeat(np.arange(self.depth), 1 << np.arange(self.depth))
        return self._projected(x[None, :])[0][:, depth] - self.cut

    def search(self, x: np.ndarray, share: float) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of the queue, until the leaves' expected distinct rows reach the share of all."""
        margins = self.margins(x)
        queue = [(0.0, t, 0) for t in range(len(self.cut))]
        taken, of_tree = [], [0.0] * len(self.cut)
        while queue:
            worst, t, node = heapq.heappop(queue)
            line = margins[t]
            while node < self.inner:
                m = line[node]
                near, far = (2 * node + 2, 2 * node + 1) if m > 0 else (2 * node + 1, 2 * node + 2)
                heapq.heappush(queue, (max(worst, abs(m)), t, far))
                node = near
            taken.append((t, node - self.inner))
            of_tree[t] += self.share[t, node - self.inner]
            missed = 1.0
            for part in of_tree:  # as if trees were independent
                missed *= 1 - min(part, 1.0)
            if 1 - missed >= share:
                break
        return taken

    def priorities(self, x: np.ndarray) -> np.ndarray:
        """The queue's key of every leaf: (trees, leaves)."""
        margins = self.margins(x)
        key = np.zeros((len(margins), 1))
        for d in range(self.depth):
            m = margins[:, (1 << d) - 1 : (2 << d) - 1]
            both = np.stack([np.where(m > 0, np.maximum(key, m), key), np.where(m > 0, key, np.maximum(key, -m))], 2)
            key = both.reshape(len(margins), -1)
        return key


def fitted(sample: np.ndarray, rows: int, k: int, recall: float = RECALL, probes: int = PROBES) -> tuple[Forest, float]:
    """A forest over unit vectors for a table of ``rows``, and the share of rows that its queue needs for the recall."""
    leaves = min(MOST_LEAVES, max(1, min(rows, len(sample) * 4) // LEAF_ROWS))
    forest = Forest(sample, max(TREES), leaves)
    if len(sample) <= k + 1:
        return forest.first(min(TREES)), 1.0
    asked = np.arange(0, len(sample), max(1, len(sample) // probes))[:probes]
    scores = sample[asked] @ sample.T
    scores[np.arange(len(asked)), asked] = -np.inf
    near, leaf = np.argpartition(-scores, k, axis=1)[:, :k], forest.leaves_of(sample)
    need = {t: [] for t in TREES}
    for q, own in zip(asked, near, strict=True):
        key = forest.priorities(sample[q])
        order = np.argsort(key, axis=1)
        ranked, part = np.take_along_axis(key, order, 1), np.cumsum(np.take_along_axis(forest.share, order, 1), 1)
        met = key[np.arange(len(key))[:, None], leaf[own].T]  # (trees, k): the key at which each tree gives each neighbour
        for t in TREES:
            for least in met[:t].min(0):
                taken = (np.searchsorted(ranked[i], least, side="right") for i in range(t))
                need[t].append(1 - np.prod([1 - min(1.0, part[i, n - 1]) if n else 1.0 for i, n in enumerate(taken)]))
    shares = {t: min(1.0, float(np.quantile(need[t], recall))) for t in TREES}
    cost = {t: t * (1 - (1 - shares[t]) ** (1 / t)) for t in TREES}  # rows scored, repeats between trees counted, as a share of all rows
    best = min(TREES, key=lambda t: (cost[t], t))
    return forest.first(best), shares[best]


def clean(vectors: DataFrame, vec_id: str, vector: str, is_query: Column) -> DataFrame:
    """(vec_id long, v array<double>, asks) of the usable vectors."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    usable = v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda c: c != 0)
    return vectors.where(F.col(vec_id).isNotNull() & F.coalesce(usable, F.lit(False))).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _sampled(usable: DataFrame, rows: int, dim: int) -> np.ndarray:
    """Unit vectors of the vec_ids with the least hashes, one for each."""
    chosen = usable.select("vec_id").distinct().orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows)
    one = usable.select("vec_id", "v").join(F.broadcast(chosen), "vec_id").groupBy("vec_id").agg(F.min("v").alias("v"))
    got = one.toArrow()
    order = np.argsort(got.column("vec_id").to_numpy(), kind="stable")
    order = order[np.argsort(np.random.default_rng(5).random(len(order)), kind="stable")]
    x = _matrix(got.column("v").combine_chunks(), dim)[order]
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", recall: float = RECALL, share: float | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of is_query the k nearest others found, by cosine in double precision.

    Without a share it is chosen for the recall."""
    prepare(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    usable = clean(vectors, vec_id, vector, is_query)
    lengths = usable.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("rows"), F.count(F.when(F.col("asks"), 1)).alias("asks")).orderBy(F.col("rows").desc(), "dim").first()
    if lengths is None or not lengths.asks:
        return spark.createDataFrame([], schema)
    dim = lengths.dim
    usable = usable.where(F.size("v") == dim).withColumn("vh", F.xxhash64("v"))
    forest, needed = fitted(_sampled(usable, min(FIT_ROWS, FIT_BYTES // (8 * dim)), dim), lengths.rows, k, recall)
    share = needed if share is None else share
    shared = spark.sparkContext.broadcast(forest)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for batch in batches:
            x = _matrix(batch.column(2), dim)
            leaf = f.leaves_of(x / np.linalg.norm(x, axis=1, keepdims=True)) + (np.arange(len(f.cut), dtype=np.int32) << 20)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(leaf), pa.list_(pa.int32()))], ["vec_id", "vh", "v", "cells"])

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for batch in batches:
            x = _matrix(batch.column(2), dim)
            ways = [f.search(y / np.linalg.norm(y), share) for y in x]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([[t << 20 | leaf for t, leaf in w] for w in ways], pa.list_(pa.int32()))], ["vec_id", "vh", "v", "cells"])

    columns = "vec_id long, vh long, v array<double>, cells array<int>"
    points = usable.select("vec_id", "vh", "v").mapInArrow(placed, columns)
    asking = usable.where("asks").groupBy("vec_id", "vh").agg(F.first("v").alias("v"))
    routes, routes_at = written(spark, asking.mapInArrow(routed, columns), "routes")
    # of each leaf that a query visits: its rows and queries, and the slices and blocks that they are cut into
    rows_of = points.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("rows"))
    asks_of = routes.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("asked"))
    cut = lambda column, size: F.ceil(F.col(column) / size).cast("int")
    cells, cells_at = written(spark, rows_of.join(asks_of, "cell").select("cell", "rows", "asked", cut("rows", SLICE_ROWS).alias("slices"), cut("asked", BLOCK_QUERIES).alias("blocks")), "cells")
    moved = cells.agg(F.sum(F.col("rows") * F.col("blocks") + F.col("asked") * F.col("slices"))).first()[0] or 0
    lots = max(1, -(-moved // LOT_ROWS))  # several groups meet in one task and give one list for each query
    cells = F.broadcast(cells.select("cell", "slices", "blocks"))  # at most max(TREES) * MOST_LEAVES rows
    spot = F.xxhash64("cell", "slice", "block")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda n: F.pmod(F.xxhash64("vec_id", "vh", "cell"), F.col(n)).cast("int")
    meeting = [F.pmod(spot, F.lit(lots)).alias("lot"), spot.alias("spot"), "asks", "vec_id", "vh", "v"]
    left = points.select("vec_id", "vh", "v", F.explode("cells").alias("cell")).join(cells, "cell").withColumn("slice", part("slices")).withColumn("block", spread("blocks")).withColumn("asks", F.lit(False)).select(*meeting)
    right = routes.select("vec_id", "vh", "v", F.explode("cells").alias("cell")).join(cells, "cell").withColumn("block", part("blocks")).withColumn("slice", spread("slices")).withColumn("asks", F.lit(True)).select(*meeting)

    def meet(table: pa.Table) -> pa.Table:
        asking, spots = table.column("asks").to_numpy(), table.column("spot").to_numpy()
        x, ids, hashes = _matrix(table.column("v").combine_chunks(), dim), table.column("vec_id").to_numpy(), table.column("vh").to_numpy()
        norm = np.linalg.norm(x, axis=1)
        order = np.lexsort((asking, spots))
        edges = np.concatenate([[0], np.flatnonzero(np.diff(spots[order])) + 1, [len(order)]])
        left, right = [], []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            own = order[lo:hi]
            c, q = own[~asking[own]], own[asking[own]]
            # repeated rows are one candidate here, so a group may give fewer than k
            distinct = len(c) > k and len(q) > 0 and np.unique(np.stack([ids[c], hashes[c]]), axis=1).shape[1] == len(c)
            for some in np.array_split(q, -(-len(q) // 512)) if len(c) and len(q) else ():
                scores = (x[some] @ x[c].T) / (norm[some][:, None] * norm[c][None, :])
                scores[ids[some][:, None] == ids[c][None, :]] = -np.inf
                # what ties stays in the running
                least = np.partition(scores, len(c) - k, axis=1)[:, len(c) - k] - 1e-9 if distinct else np.full(len(some), -2.0)
                r, j = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
                left.append(some[r])
                right.append(c[j])
        a, b = (np.concatenate(y) if y else np.zeros(0, np.int64) for y in (left, right))
        exact = (x[a] * x[b]).sum(1) / (norm[a] * norm[b])
        qa, vb, hb = ids[a], ids[b], hashes[b]
        order = np.lexsort((-exact, hb, vb, qa))
        qa, vb, hb, exact = qa[order], vb[order], hb[order], exact[order]
        fresh = np.ones(len(qa), bool)  # a candidate counts by its best score
        fresh[1:] = (qa[1:] != qa[:-1]) | (vb[1:] != vb[:-1]) | (hb[1:] != hb[:-1])
        qa, vb, hb, exact = qa[fresh], vb[fresh], hb[fresh], exact[fresh]
        order = np.lexsort((hb, vb, -exact, qa))
        qa, vb, hb, exact = qa[order], vb[order], hb[order], exact[order]
        starts = np.flatnonzero(np.concatenate([[True], qa[1:] != qa[:-1]])) if len(qa) else np.zeros(0, int)
        best = np.arange(len(qa)) - np.repeat(starts, np.diff(np.append(starts, len(qa)))) < k
        return pa.table({"query_id": pa.array(qa[best], pa.int64()), "vec_id": pa.array(vb[best], pa.int64()), "vh": pa.array(hb[best], pa.int64()), "score": pa.array(exact[best], pa.float64())})

    found = left.unionByName(right).groupBy("lot").applyInArrow(meet, "query_id long, vec_id long, vh long, score double")
    # a candidate that several trees give counts once; rows that are repeated count as often as they are there
    again = usable.groupBy("vec_id", "vh").agg(F.count("*").alias("copies")).where("copies > 1")
    once = found.groupBy("query_id", "vec_id", "vh").agg(F.max("score").alias("score")).join(bounded(again), ["vec_id", "vh"], "left")
    one = F.struct((-F.col("score")).alias("far"), "vec_id", "vh", F.least(F.coalesce("copies", F.lit(1)), F.lit(k)).cast("int").alias("copies"))
    ranked = once.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(one)), 1, k).alias("top"))  # at most k of each lot
    each = F.slice(F.flatten(F.transform("top", lambda x: F.array_repeat(x, x["copies"]))), 1, k)
    out = ranked.select("query_id", F.posexplode(each).alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))
    result, _ = written(spark, out, "nearest")
    drop(spark, routes_at, cells_at)
    return result
