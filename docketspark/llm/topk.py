"""Exact top-k by inner product: a ball tree per shard, branch and bound.

Shards of vectors meet blocks of queries. In a task, a shard's ball tree is walked for a
whole block: nodes go in the order of the upper bound <q, c> + |q| r, and a node is left
out for a query when its bound is below the k-th score that the query has so far. A first
round over one shard gives every query a k-th score, which all other tasks start from;
within a task the score rises as shards and leaves are done.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketspark.llm.common import durable, parts_for

LEAF = 64
#: Below any score, and its negative is a number too.
NONE = -(1 << 62)


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, x as double; null if the vector, or a component, is null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


class BallTree:
    """A balanced tree of balls over the rows of `points`; level by level, leaves last.

    Each level splits every node's rows into halves along the axis that joins two far
    points. `spans[level]` are the nodes' row ranges in `order`.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        spans = [(0, len(points))]
        self.levels: list[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]] = []
        while True:
            owned = [points[self.order[a:b]] for a, b in spans]
            centres = np.array([p.mean(axis=0) for p in owned])
            radii = np.array([np.sqrt(((p - c) ** 2).sum(axis=1).max()) for p, c in zip(owned, centres, strict=True)])
            self.levels.append((centres, radii, spans))
            if max(b - a for a, b in spans) <= leaf:
                break
            halves = []
            for (a, b), p, c in zip(spans, owned, centres, strict=True):
                far = p[((p - c) ** 2).sum(axis=1).argmax()]
                other = p[((p - far) ** 2).sum(axis=1).argmax()]
                middle = a + (b - a + 1) // 2
                self.order[a:b] = self.order[a:b][np.argsort(p @ (far - other), kind="stable")]
                halves += [(a, middle), (middle, b)]  # all nodes of a level differ by one row at most, and hold over `leaf` / 2
            spans = halves
        self.points = points[self.order]


class Best:
    """The k best (score, id) of each query so far; ties go to the smaller id."""

    def __init__(self, queries: int, k: int, floor: np.ndarray, wide: bool = False):
        self.k = k
        self.none = -(1 << 4200) if wide else NONE  # below any product of components of 64 bits, and more
        self.scores = np.full((queries, k), self.none, object if wide else np.int64)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)
        self.floor = np.where(floor == NONE, self.none, floor.astype(object)) if wide else floor  # a score that k rows are known to reach

    def kth(self) -> np.ndarray:
        return np.maximum(self.scores[:, -1], self.floor)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Candidates `ids` with `scores` (rows x ids) for the queries `rows`."""
        all_scores = np.concatenate([self.scores[rows], scores], axis=1)
        all_ids = np.concatenate([self.ids[rows], np.broadcast_to(ids, scores.shape)], axis=1)
        order = np.lexsort((all_ids, -all_scores), axis=1)[:, : self.k]
        self.scores[rows] = np.take_along_axis(all_scores, order, 1)
        self.ids[rows] = np.take_along_axis(all_ids, order, 1)


def reach(queries: np.ndarray, points: np.ndarray) -> float:
    """More than the largest score of any query and row, by their lengths."""
    return float(np.sqrt((queries**2).sum(axis=1)).max(initial=0) * np.sqrt((points**2).sum(axis=1).max(initial=0)))


def search(tree: BallTree, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, best: Best, points: np.ndarray, whole: np.ndarray) -> None:
    """Brings every row of the tree that can be among a query's best into `best`.

    `points` and `whole` are the tree's rows and the queries in 64-bit integers. Where a score can pass 2 ** 53, products
    are integers too; where one can pass 2 ** 62 (`best` is wide then), integers of any size.
    """
    norms = np.sqrt((queries**2).sum(axis=1))
    largest = reach(queries, tree.points)
    whole, exact = (None, None) if largest < 2.0**53 else (whole, points[tree.order])
    if best.scores.dtype == object:
        whole, exact = (whole if whole is not None else queries.astype(np.int64)).astype(object), points[tree.order].astype(object)
    slack = 1e-9 * (norms * np.sqrt((tree.points**2).sum(axis=1).max()) + 1)  # more than the bounds' rounding errors
    ids = ids[tree.order]
    alive: np.ndarray | None = None
    for depth, (centres, radii, spans) in enumerate(tree.levels):
        upper = queries @ centres.T + norms[:, None] * radii[None, :] + slack[:, None]
        if alive is not None:  # a node is open if its parent is
            parents = tree.levels[depth - 1][2]
            starts = np.array([a for a, _ in parents])
            parent = np.searchsorted(starts, [a for a, _ in spans], side="right") - 1
            upper = np.where(alive[:, parent], upper, -np.inf)
        alive = upper >= best.kth()[:, None]
    order = np.argsort(-upper, axis=1, kind="stable")
    for turn in range(order.shape[1]):
        node = order[:, turn]
        bound = upper[np.arange(len(queries)), node]
        left = np.flatnonzero((bound >= best.kth()) & (bound > -np.inf))
        if not len(left):
            break
        for leaf in np.unique(node[left]):
            rows = left[node[left] == leaf]
            a, b = spans[leaf]
            scores = (queries[rows] @ tree.points[a:b].T).astype(np.int64) if whole is None else whole[rows] @ exact[a:b].T
            own = query_ids[rows][:, None] == ids[None, a:b]
            scores[own] = best.none
            best.add(rows, scores, ids[a:b])


def top_k(
    vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, shard_rows: int = 8192, query_rows: int = 2048, shards_each: int = 8
) -> DataFrame:
    """Per query its k best other rows: query_id, rank, vec_id, score.

    Queries are the rows whose vec_id is divisible by `every`; candidates are all rows but
    those with the query's own vec_id. Vectors that are null, hold null or non-finite
    components or have no vec_id take no part; vectors of other lengths than the query's
    score nothing with it. A repeated candidate row counts as often as it occurs; of a
    repeated query id the least vector asks. Scores are exact whatever the components; a returned score beyond 64 bits is an error. Queries are a stated set: blocks of
    `query_rows` of them meet lots of `shards_each` shards, so no task holds more.
    """
    v = vectors.select(F.col("vec_id").cast("long"), quantised(F.col("embedding"), scale).alias("v")).where("vec_id is not null and v is not null")
    v = durable(v.withColumn("width", F.size("v")).withColumn("rid", F.monotonically_increasing_id()))
    n = v.count()
    shards = parts_for(n, shard_rows)
    lots = parts_for(shards, shards_each)
    asked = v.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("width", "v")).alias("q")).select(F.col("vec_id").alias("query_id"), "q.*")
    blocks = parts_for(max(1, n // every), query_rows)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    placed = v.withColumn("shard", F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int")).withColumn("lot", F.col("shard") % lots)

    def one(key: tuple, rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if not len(rows) or not len(asks):
            return pd.DataFrame(columns=["query_id", "vec_id", "score"]).astype("int64")
        for width, part in asks.groupby("width"):
            own = rows[rows["width"] == width]
            if not len(own) or width == 0:
                continue
            whole, names = np.array(part["v"].tolist(), np.int64), part["query_id"].to_numpy()
            queries = whole.astype(float)
            wide = reach(queries, np.array(own["v"].tolist(), float)) >= 2.0**62
            best = Best(len(part), k, part["floor"].to_numpy(), wide)
            for _, shard in own.groupby("shard", sort=True):
                points = np.array(shard["v"].tolist(), np.int64)
                search(BallTree(points.astype(float)), shard["vec_id"].to_numpy(), queries, names, best, points, whole)
            for name, scores, ids in zip(names, best.scores, best.ids, strict=True):
                out += [(name, i, s) for s, i in zip(scores, ids, strict=True) if i != np.iinfo(np.int64).max and s != best.none]
        if any(not -(1 << 63) <= s < 1 << 63 for _, _, s in out):
            raise ValueError("a score of the result needs more than 64 bits")
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    def meet(rows: DataFrame, asks: DataFrame) -> DataFrame:
        """Every block of queries meets every lot of shards: rows go once to each block, queries once to each lot."""
        left = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        right = asks.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
        return left.groupBy("lot", "block").cogroup(right.groupBy("lot", "block")).applyInPandas(one, "query_id long, vec_id long, score long")

    first = placed.where("shard = 0").withColumn("lot", F.lit(0))
    only = asked.withColumn("floor", F.lit(NONE).cast("long"))
    left = first.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = durable(left.groupBy("block").cogroup(only.groupBy("block")).applyInPandas(one, "query_id long, vec_id long, score long"))
    floors = found.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k)
    known = asked.join(floors.select("query_id", "least"), "query_id", "left").select(*asked.columns, F.coalesce("least", F.lit(NONE)).cast("long").alias("floor"))
    rest = meet(placed.where("shard > 0"), known)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    both = found.unionByName(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return both.select("query_id", "rank", "vec_id", "score")
