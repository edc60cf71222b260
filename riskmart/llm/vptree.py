"""Operator 6, approximate nearest neighbours: a vantage-point tree per shard.

Vectors are dealt into shards of about ``shard_rows`` by the hash of their
id; a task builds the tree of its shard in numpy and the queries of the shard
stream past it in blocks, all active queries of a node at once.  A subtree is
left out where the triangle inequality bounds its distances from below by
more than ``factor`` times the distance of the k-th nearest found so far;
factor 1 is exact, a smaller one visits less.  Each shard returns k rows a
query and a window keeps the k nearest of all shards.

Distances are sums of squared differences of the original components in
double precision, never expanded products.

Defined cases: vectors that are null, empty, all zero or hold null, NaN or
infinite components take no part, neither do null ids; rows that repeat an id
count once, with their smallest vector; vectors of another length are no
candidates of a query; equal distances go to the smaller id; with fewer than
k candidates all are returned; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskmart.llm.spark import bounded_batches, table

K = 10
FACTOR = 0.5
SHARD_ROWS = 8192
LEAF = 64
ROUND = 1 << 21      # component differences held at a time
SLACK = 1e-6         # what a matrix product may err by, times the longest vector


def usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of q to all rows of x."""
    out = np.empty((len(q), len(x)))
    step = max(1, ROUND // max(1, x.size))
    for i in range(0, len(q), step):
        d = q[i:i + step, None, :] - x[None, :, :]
        out[i:i + step] = np.sqrt((d * d).sum(axis=2))
    return out


class Tree:
    """Nodes (vantage row, radius, inside, outside); leaves hold rows."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x, self.nodes = ids, x, []
        self.square = (x * x).sum(axis=1)
        self.widest = 1 + float(np.sqrt(self.square.max()))
        rng = np.random.Generator(np.random.PCG64(len(ids)))
        todo = [(np.arange(len(ids)), None, 0)]
        while todo:
            rows, parent, side = todo.pop()
            if parent is not None:
                self.nodes[parent][side] = len(self.nodes)
            if len(rows) <= LEAF:
                self.nodes.append([rows])
                continue
            pick = int(rng.integers(len(rows)))
            vantage, rest = rows[pick], np.delete(rows, pick)
            d = distances(x[vantage:vantage + 1], x[rest])[0]
            radius = np.partition(d, len(d) // 2)[len(d) // 2]
            inside = d < radius
            if not inside.any():            # at least half of all at the radius or nearer: split by it
                inside = d <= radius
            if inside.all():                # all as far: no radius parts them
                self.nodes.append([rows])
                continue
            self.nodes.append([vantage, float(d[inside].max()), float(d[~inside].min()), None, None])
            at = len(self.nodes) - 1
            todo += [(rest[inside], at, 3), (rest[~inside], at, 4)]

    def search(self, qid: np.ndarray, q: np.ndarray, k: int, factor: float):
        """(ids, distances), k columns, padded with infinite distances.  All
        queries that a node may serve visit it together, the child that more
        of them are near to first."""
        found, near = np.full((len(q), k), np.iinfo(np.int64).max), np.full((len(q), k), np.inf)
        square = (q * q).sum(axis=1)
        todo = [(0, np.arange(len(q)), np.zeros(len(q)))]
        while todo:
            at, own, low = todo.pop()
            ok = low <= factor * near[own, -1]
            own, low = own[ok], low[ok]
            if not len(own):
                continue
            node = self.nodes[at]
            rows = node[0] if len(node) == 1 else np.array([node[0]])
            for i in range(0, len(rows), 1024):
                d = self._offer(own, rows[i:i + 1024], qid, q, square, k, found, near)
            if len(node) == 1:
                continue
            d = d[:, 0]
            _, far_in, near_out, inside, outside = node
            into, out = (inside, own, np.maximum(low, d - far_in)), (outside, own, np.maximum(low, near_out - d))
            todo += [out, into] if np.median(d - far_in - near_out + d) <= 0 else [into, out]
        return found, near

    def _offer(self, own, rows, qid, q, square, k, found, near):
        """Distances to some rows, from a matrix product; those that may be
        among the k nearest are computed again component by component."""
        x = self.x[rows]
        about = np.sqrt(np.maximum(square[own][:, None] + self.square[rows] - 2 * (q[own] @ x.T), 0))
        r, c = np.nonzero((about <= near[own, -1:] + SLACK * self.widest) & (self.ids[rows] != qid[own][:, None]))
        if len(r):
            some, r = np.unique(r, return_inverse=True)
            d = np.full((len(some), len(rows)), np.inf)
            for i in range(0, len(r), ROUND // 64):
                e = q[own[some[r[i:i + ROUND // 64]]]] - x[c[i:i + ROUND // 64]]
                d[r[i:i + ROUND // 64], c[i:i + ROUND // 64]] = np.sqrt((e * e).sum(axis=1))
            mine = own[some]
            d = np.concatenate((near[mine], d), axis=1)
            ids = np.concatenate((found[mine], np.broadcast_to(self.ids[rows], (len(some), len(rows)))), axis=1)
            order = np.lexsort((ids, d), axis=1)[:, :k]
            near[mine], found[mine] = np.take_along_axis(d, order, 1), np.take_along_axis(ids, order, 1)
        return about


def searcher(k: int, factor: float):
    """Rows sorted by (dim, shard, kind): the members of a shard, then the
    queries that ask it."""
    def run(batches):
        at, ids, vecs, tree = None, [], [], None
        for b in batches:
            dims, shards, kinds, own = (b.column(c).to_numpy() for c in ("dim", "shard", "kind", "vec_id"))
            vec = b.column("v")
            key = np.stack([dims, shards, kinds])
            cut = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0), [True])))
            for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
                x = vec.slice(i, j - i).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(j - i, -1)
                if (dims[i], shards[i]) != at:
                    at, ids, vecs, tree = (dims[i], shards[i]), [], [], None
                if kinds[i] == 0:
                    ids.append(own[i:j]), vecs.append(x)
                elif ids:
                    if tree is None:
                        tree = Tree(np.concatenate(ids), np.concatenate(vecs))
                    found, near = tree.search(own[i:j], x, k, factor)
                    r, c = np.nonzero(np.isfinite(near))
                    yield pa.record_batch({"query_id": pa.array(own[i:j][r], pa.int64()), "vec_id": pa.array(found[r, c], pa.int64()),
                                           "score": pa.array(near[r, c], pa.float64())})
    return run


def nearest(vectors: DataFrame, is_query: Column, id_col="vec_id", vec_col="embedding", k: int = K,
            factor: float = FACTOR, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows of each row
    for which ``is_query`` (an expression on vec_id) holds."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))
            .where(F.col("vec_id").isNotNull() & usable(F.col("v")))
            .groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")))
    shards = max(1, -(-rows.count() // shard_rows))
    members = rows.select("dim", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"),
                          "vec_id", "v")
    asked = rows.where(is_query).select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
                                        F.lit(1).alias("kind"), "vec_id", "v")
    got = (members.union(asked).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "kind")
           .mapInArrow(searcher(k, factor), "query_id long, vec_id long, score double"))
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (got.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op6_vp_tree(spark, sf_dir) -> DataFrame:
    """Operator 6 over all embeddings (contract columns)."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
