"""Hard negatives by BOND: a branch-and-bound scan of vertically stored vectors.

Rows lie in shards whose dimensions are columns. An anchor reads a shard's columns in the order of its own
components' magnitudes, a few at a time. After each step a row's score lies between its sum so far plus the least, and plus
the most, that the columns not yet read can add (each column's least and greatest value are known). Rows
whose interval can't reach the wanted scores leave the candidate bitmap; what is left in the end has exact
scores. Wanted are, first, the best rows of the anchor's label; then, per positive, the best rows of other
labels in the window of scores below it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketspark.llm.common import durable, parts_for, partitions

#: Columns read between two looks at the bitmap.
STEP = 8
LONG = 1 << 63


def quantised(vectors: pa.ChunkedArray, width: int, scale: int) -> np.ndarray:
    """Rows x width: floor(scale * x); shorter vectors have zeros at their end. Integers beyond 2 ** 53 are Python's, else floats hold them exactly."""
    flat = vectors.combine_chunks()
    values, offsets = flat.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(flat.value_lengths().to_numpy(zero_copy_only=False))))
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(offsets[:-1], sizes)] = np.floor(values * float(scale))
    return out


class Shard:
    """Rows by column: `columns[d]` holds every row's component d, `least` and `most` each column's bounds."""

    def __init__(self, rows: np.ndarray):
        self.columns = np.ascontiguousarray(rows.T)
        self.least, self.most = self.columns.min(axis=1), self.columns.max(axis=1)
        self.reach = np.maximum(np.abs(self.least), np.abs(self.most))
        self.whole: np.ndarray | None = None

    def exact_for(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """anchor, columns, least, most in a type in which no sum over this shard's rows is rounded."""
        if float(np.abs(anchor) @ self.reach) < 2.0**53:
            return anchor, self.columns, self.least, self.most
        if self.whole is None:
            self.whole = np.vectorize(int, otypes=[object])(self.columns)
        return np.array([int(x) for x in anchor], object), self.whole, self.whole.min(axis=1), self.whole.max(axis=1)


def scan(shard: Shard, anchor: np.ndarray, candidates: np.ndarray, windows: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, exact scores) of the candidates that can be among the k best of a window (low, high), ends included.

    The bitmap of candidates is kept as their sorted row numbers. A window's floor rises to the k-th best lower bound of
    the rows that surely lie in it; rows that reach no window's floor, or lie above every window, drop out.
    """
    a, columns, least, most = shard.exact_for(anchor)
    order = np.argsort(-np.abs(anchor), kind="stable")
    low, high = np.minimum(a * least, a * most)[order], np.maximum(a * least, a * most)[order]
    rest_low, rest_high = np.concatenate((low[::-1].cumsum()[::-1], [0])), np.concatenate((high[::-1].cumsum()[::-1], [0]))
    alive, sums = candidates, np.zeros(len(candidates), a.dtype)
    for at in range(0, len(order), STEP):
        read = order[at : at + STEP]
        everything = len(alive) == columns.shape[1]
        for d in read:
            sums = sums + a[d] * (columns[d] if everything else columns[d][alive])
        below, above = sums + rest_low[min(at + STEP, len(order))], sums + rest_high[min(at + STEP, len(order))]
        keep = np.zeros(len(alive), bool)
        for floor, ceiling in windows:
            inside = below[(below >= floor) & (above <= ceiling)]
            if len(inside) >= k:
                floor = np.partition(inside, len(inside) - k)[len(inside) - k] if inside.dtype != object else sorted(inside)[-k]
            keep |= ((above >= floor) & (below <= ceiling)).astype(bool)
        alive, sums = alive[keep], sums[keep]
        if not len(alive):
            break
    return alive, sums


def first_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the k best scores, ties to the smaller id."""
    return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], int) if scores.dtype == object else np.lexsort((ids, -scores))[:k]


def _longs(scores: list) -> pa.Array:
    if any(not -LONG <= s < LONG for s in scores):
        raise ValueError("a score of the result needs more than 64 bits")
    return pa.array(scores, pa.int64())


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.table({n: _longs([int(x) for x in c]) for n, c in zip(names, columns, strict=True)})


def hard_negatives(
    vectors: DataFrame, every: int = 100, positives: int = 5, k: int = 5, low: int = 80, high: int = 100, scale: int = 256, shard_rows: int = 8192, block_rows: int = 2048
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by `every`. An anchor's positives are its `positives` best other rows of
    its label; for each, the `k` best rows of other labels with low * positive <= 100 * score <= high * positive. Scores are exact inner
    products of floor(scale * x); ties go to the smaller vec_id. Where vec_id is divisible by 7 the label is first raised by one modulo 10.
    Rows whose vec_id, label, vector or a component is null, or a component not finite (scaled, too), take no part. Vectors of
    other lengths are as if filled with zeros. Repeated rows count each, as anchors too. A returned score beyond 64
    bits is an error. Other columns play no part; an empty table gives no rows. Anchors are a stated set: blocks of `block_rows` meet
    shards of `shard_rows` rows, so a task holds one of each.
    """
    spark = vectors.sparkSession
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float("inf")))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    v = vectors.where("vec_id is not null and label is not null and embedding is not null").where(fine)
    v = v.select(F.col("vec_id").cast("long").alias("id"), moved.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    v = durable(v.withColumn("rid", F.monotonically_increasing_id()))
    n, width = v.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    shards = max(parts_for(n, shard_rows), min(partitions(spark), parts_for(n, shard_rows // 8)))
    anchors = v.where(F.col("id") % every == 0)
    blocks = parts_for(anchors.count(), block_rows)
    placed = v.withColumn("shard", F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = anchors.withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int"))

    def met(rows: pa.Table, asks: pa.Table):  # noqa: ANN202
        shard = Shard(quantised(rows["v"], width, scale))
        ids, labels, rids = (rows[c].to_numpy() for c in ("id", "label", "rid"))
        for a, vector in zip(asks.select(["id", "label", "rid", *(["wanted"] if "wanted" in asks.column_names else [])]).to_pylist(), quantised(asks["v"], width, scale), strict=True):
            yield a, vector, shard, ids, labels, rids

    def near(rows: pa.Table, asks: pa.Table) -> pa.Table:
        out = []
        if len(rows) and len(asks):
            for a, vector, shard, ids, labels, rids in met(rows, asks):
                found, scores = scan(shard, vector, np.flatnonzero((labels == a["label"]) & (rids != a["rid"])), [(-np.inf, np.inf)], positives)
                out += [(a["rid"], a["id"], ids[found[i]], rids[found[i]], scores[i]) for i in first_of(ids[found], scores, positives)]
        return _table(out, ["anchor", "anchor_id", "positive_id", "positive", "positive_score"])

    def hard(rows: pa.Table, asks: pa.Table) -> pa.Table:
        out = []
        if len(rows) and len(asks):
            for a, vector, shard, ids, labels, _ in met(rows, asks):
                windows = [(-(-low * s // 100), high * s // 100) for s in a["wanted"]]
                found, scores = scan(shard, vector, np.flatnonzero(labels != a["label"]), windows, k)
                for s, (floor, ceiling) in zip(a["wanted"], windows, strict=True):
                    inside = np.flatnonzero((scores >= floor) & (scores <= ceiling))
                    out += [(a["rid"], s, ids[found[inside[i]]], scores[inside[i]]) for i in first_of(ids[found[inside]], scores[inside], k)]
        return _table(out, ["anchor", "positive_score", "negative_id", "negative_score"])

    def over_shards(asks: DataFrame, task, schema: str) -> DataFrame:  # noqa: ANN001
        right = asks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of their own, apart from the rows'
        return placed.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(task, schema)

    found = over_shards(asked, near, "anchor long, anchor_id long, positive_id long, positive long, positive_score long")
    best = W.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id", "positive")
    pairs = durable(found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives))
    wanted = pairs.groupBy("anchor").agg(F.sort_array(F.collect_set("positive_score")).alias("wanted"))  # at most `positives` scores
    asks = asked.join(wanted, F.col("rid") == F.col("anchor")).drop("anchor")
    negatives = over_shards(asks, hard, "anchor long, positive_score long, negative_id long, negative_score long")
    ranked = W.partitionBy("anchor", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    negatives = negatives.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    out = pairs.join(negatives, ["anchor", "positive_score"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
