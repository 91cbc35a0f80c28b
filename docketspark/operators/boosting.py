"""Boosted trees from histograms: rows become packed blocks of bin numbers once, and every level of a tree is one pass that sums them.

A block holds the bins (a byte per input and row), labels and margins of some ten thousand rows. A task sums the residuals of its blocks per
input, tree node and bin; only these sums, whose size does not depend on the rows, and the splits that they give pass the driver.
Residuals are whole multiples of a small number, so the sums are exact and don't depend on how rows are dealt.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketspark.operators.trees import MISSING_LEFT, MISSING_NAN, Forest
from docketspark.sources.store import discarded, stored

#: Rows of a block, about; rows of a range of scores, about; picks that tell where a range ends.
BLOCK_ROWS, RANGE_ROWS, RANGE_PICKS = 1 << 15, 1_000_000, 200
#: Rounds after which margins are written again.
REFRESH = 5
#: A residual is a multiple of 1 / UNIT (sums are exact up to 2^29 rows); a node with this cut has no split, all rows go left.
UNIT, NO_CUT = float(1 << 22), 255
BLOCK = "id long, n long, bins binary, y binary, margin binary"


@dataclass
class Tree:
    """A whole binary tree in heap order: input and cut of each inner node, value of each leaf, gain of each input."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gains: np.ndarray

    def place(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """Which node of a level each row reaches; bins: inputs x rows."""
        at = np.zeros(bins.shape[1], np.uint8 if levels <= 8 else np.uint32)
        for level in range(levels):
            right = np.zeros(len(at), bool)
            for j in range(1 << level):
                i = (1 << level) - 1 + j
                if self.cut[i] != NO_CUT:
                    right |= (at == j) & (bins[self.feature[i]] > int(self.cut[i]))  # a Python number, so that bytes are compared as bytes
            at = at * 2 + right
        return at

    @property
    def depth(self) -> int:
        return len(self.value).bit_length() - 1


def _spread(x: np.ndarray, weight: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most `most` values at even ranks of weighted ones, ascending, and the weight of each."""
    order = np.argsort(x, kind="stable")
    upto, k = weight[order].cumsum(), min(most, len(x))
    at = np.searchsorted(upto, (np.arange(k) + 0.5) * upto[-1] / k)
    return x[order][np.minimum(at, len(x) - 1)], np.full(k, upto[-1] / k)


def cuts_of(rows: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Where each input is cut into at most `bins` bins (low, high]: between all values if they are few, else at quantiles of all rows, whose
    ranks are right within a 300th of the rows. One pass; a task sends some values per input."""
    width = len(features)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few, picks, total = [np.zeros(0)] * width, [[] for _ in range(width)], 0
        for b in batches:
            total += b.num_rows
            for j in range(width if b.num_rows else 0):
                x = np.sort(b.column(j).to_numpy(zero_copy_only=False))
                if few[j] is not None:
                    few[j] = np.union1d(few[j], x[np.append(True, x[1:] != x[:-1])])
                    few[j] = few[j] if len(few[j]) <= bins else None
                k = min(400, len(x))
                picks[j].append((x[((np.arange(k) + 0.5) * len(x) / k).astype(int)], np.full(k, len(x) / k)))
                if len(picks[j]) >= 500:
                    picks[j] = [_spread(*map(np.concatenate, zip(*picks[j], strict=True)), 10_000)]
        for j in range(width if total else 0):
            x, weight = _spread(*map(np.concatenate, zip(*picks[j], strict=True)), 2000)
            known = None if few[j] is None else few[j].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([j]), pa.array([known], pa.binary()), pa.array([x.tobytes()]), pa.array([weight.tobytes()])], ["j", "few", "x", "weight"])

    found = rows.mapInArrow(task, "j long, few binary, x binary, weight binary").collect()  # some values a task and input
    out = []
    for j in range(width):
        of = [r for r in found if r["j"] == j]
        values = np.unique(np.concatenate([np.zeros(0), *(np.frombuffer(r["few"]) for r in of if r["few"] is not None)]))
        if all(r["few"] is not None for r in of) and len(values) <= bins:
            out.append(((values[1:] + values[:-1]) / 2).tolist())
        else:
            x, weight = (np.concatenate([np.frombuffer(r[c]) for r in of]) for c in ("x", "weight"))
            order = np.argsort(x, kind="stable")
            upto = weight[order].cumsum()
            at = np.searchsorted(upto, np.arange(1, bins) * upto[-1] / bins)
            out.append(np.unique(x[order][np.minimum(at, len(x) - 1)]).tolist())
    return out


def _kept(blocks: DataFrame) -> DataFrame:
    """Stored blocks, which executors keep as far as their memory allows, for every level reads them."""
    return stored(blocks).persist()


def _dropped(blocks: DataFrame) -> None:
    blocks.unpersist()
    discarded(blocks)


def blocks_of(rows: DataFrame, cuts: list[list[float]]) -> DataFrame:
    """The rows (inputs, then y) as stored blocks, with margins of 0."""
    edges = [np.array(c) for c in cuts]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, kept, number = TaskContext.get().partitionId() << 32, [], 0

        def block() -> pa.RecordBatch:
            bins, y = np.concatenate([b for b, _ in kept], axis=1), np.concatenate([y for _, y in kept])
            content = [first + number], [len(y)], [bins.tobytes()], [y.tobytes()], [np.zeros(len(y)).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in content], ["id", "n", "bins", "y", "margin"])

        for b in batches:
            *inputs, y = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            kept.append((np.stack([np.searchsorted(e, x).astype(np.uint8) for e, x in zip(edges, inputs, strict=True)]), y.astype(np.uint8)))
            if sum(len(y) for _, y in kept) >= BLOCK_ROWS:
                yield block()
                kept, number = [], number + 1
        if kept:
            yield block()

    return _kept(rows.mapInArrow(packed, BLOCK))


def _opened(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(id, bins, y, margin) of every block."""
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            yield r[0], np.frombuffer(r[2], np.uint8).reshape(width, r[1]), np.frombuffer(r[3], np.uint8), np.frombuffer(r[4], float)


def _total(blocks: DataFrame, sums: Callable[[Iterator[pa.RecordBatch]], np.ndarray], kind: type = float) -> np.ndarray | None:
    """The total of an array that each task makes of its blocks; None without tasks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([sums(batches).tobytes()], pa.binary())], ["sums"])

    parts = [np.frombuffer(r[0], kind) for r in blocks.mapInArrow(task, "sums binary").collect()]  # a row a task
    return sum(parts[1:], parts[0].copy()) if parts else None


def _grown(blocks: DataFrame, before: list[Tree], number: int, width: int, depth: int, least: int, cuts: list[list[float]], bins: int, seed: int, sampled: float, share: float) -> Tree:
    """The next tree: each level's splits come from one pass over the blocks, whose margins are those without the trees `before`."""
    tree = Tree(np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, NO_CUT, np.int64), np.zeros(1 << depth), np.zeros(width))
    allowed = np.array([[k < len(c) for k in range(bins - 1)] for c in cuts])
    open_, inputs = {0}, max(1, math.ceil(share * width))
    for level in range(depth):
        nodes = 1 << level

        def sums(batches: Iterator[pa.RecordBatch], nodes: int = nodes, level: int = level) -> np.ndarray:
            out = np.zeros((width, 2, nodes * bins))
            for id_, x, y, margin in _opened(batches, width):
                sign = y * 2.0 - 1
                if number:
                    for t in before:
                        margin = margin + t.value[t.place(x, t.depth)]
                    with np.errstate(over="ignore"):
                        sign = 4 * sign / (1 + np.exp(2 * sign * margin))
                drawn = np.random.default_rng([seed, number, id_]).random(len(y), np.float32) < sampled
                base = np.where(drawn, tree.place(x, level), nodes).astype(np.intp) * bins  # rows that aren't drawn are a node of their own
                residual = np.rint(sign * UNIT)
                for f in range(width):
                    at = base + x[f]
                    out[f, 0] += np.bincount(at, minlength=(nodes + 1) * bins)[: nodes * bins]
                    out[f, 1] += np.bincount(at, residual, (nodes + 1) * bins)[: nodes * bins]
            return out

        total = _total(blocks, sums)
        if total is None:
            break
        n, s = total.reshape(width, 2, nodes, bins).transpose(1, 2, 0, 3)  # node, input, bin
        s = s / UNIT
        if level == 0:
            tree.value[0] = s[0, 0].sum() / max(n[0, 0].sum(), 1)
        left, span = set(), 1 << (depth - level)
        for j in sorted(open_):
            nl, sl = n[j].cumsum(axis=1)[:, :-1], s[j].cumsum(axis=1)[:, :-1]
            all_n, all_s = n[j, 0].sum(), s[j, 0].sum()
            nr, sr = all_n - nl, all_s - sl
            seen = np.isin(np.arange(width), np.random.default_rng([seed, number, level, j]).permutation(width)[:inputs])
            fits = allowed & seen[:, None] & (nl >= max(least, 1)) & (nr >= max(least, 1))
            gain = np.where(fits, sl**2 / np.maximum(nl, 1) + sr**2 / np.maximum(nr, 1) - all_s**2 / max(all_n, 1), 0.0)
            f, k = np.unravel_index(np.argmax(gain), gain.shape)
            if gain[f, k] <= 1e-9 * max(all_n, 1):
                continue
            i = nodes - 1 + j
            tree.feature[i], tree.cut[i] = f, k
            tree.gains[f] += gain[f, k]
            # a node's value is that of its first leaf, to which rows go where nothing below is split
            tree.value[j * span], tree.value[j * span + span // 2] = sl[f, k] / nl[f, k], sr[f, k] / nr[f, k]
            left |= {2 * j, 2 * j + 1}
        open_ = left
        if not open_:
            break
    return tree


def _probabilities(x: np.ndarray, margin: np.ndarray, trees: list[Tree]) -> Iterator[np.ndarray]:
    for t in trees:
        margin = margin + t.value[t.place(x, t.depth)]
        yield 1 / (1 + np.exp(-2 * margin))


def _counted(p: np.ndarray, n: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and positives per distinct score, ascending."""
    score, at = np.unique(p, return_inverse=True)
    return score, np.bincount(at, n, len(score)), np.bincount(at, pos, len(score))


def average_precisions(blocks: DataFrame, trees: list[Tree], width: int, range_rows: int = RANGE_ROWS) -> list[float]:
    """The average precision after each of the trees, as metrics.average_precision gives it: scores are dealt by round and range of scores,
    counted, and meet the sums of all higher ranges. Picked scores only tell where ranges end. No positives: 0."""
    rows = blocks.agg(F.sum("n")).first()[0] or 0
    rounds, ranges = len(trees), math.ceil(rows / range_rows)
    if not ranges:
        return [0.0] * rounds
    edges = [np.zeros(0)] * rounds
    if ranges > 1:
        each = max(1, range_rows // RANGE_PICKS)

        def picks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, x, _y, margin in _opened(batches, width):
                found = np.stack(list(_probabilities(x[:, ::each], margin[::each], trees)))
                yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], ["p"])

        found = np.concatenate([np.frombuffer(r[0], float).reshape(rounds, -1) for r in blocks.mapInArrow(picks, "p binary").collect()], axis=1)
        edges = [np.unique(np.quantile(p, np.arange(1, ranges) / ranges)) for p in found]

    def sums(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((rounds, 2, ranges))
        for _, x, y, margin in _opened(batches, width):
            for i, p in enumerate(_probabilities(x, margin, trees)):
                at = np.searchsorted(edges[i], p, "right")
                out[i] += np.bincount(at, minlength=ranges), np.bincount(at, y, ranges)
        return out

    total = _total(blocks, sums).reshape(rounds, 2, ranges)
    above = total[:, :, ::-1].cumsum(axis=2)[:, :, ::-1] - total

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x, y, margin in _opened(batches, width):
            out = []
            for i, p in enumerate(_probabilities(x, margin, trees)):
                score, n, pos = _counted(p, np.ones(len(p)), y)
                ends = [0, *np.searchsorted(score, edges[i]), len(score)]
                out += [(i, k, score[a:b].tobytes(), n[a:b].astype(np.uint32).tobytes(), pos[a:b].astype(np.uint32).tobytes()) for k, (a, b) in enumerate(zip(ends, ends[1:])) if a < b]  # noqa: B905
            kinds = pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["round", "part", "score", "n", "pos"])

    def gained(group: pa.Table) -> pa.Table:
        i, part = group["round"][0].as_py(), group["part"][0].as_py()
        joined = [np.frombuffer(b"".join(group[c].to_pylist()), k) for c, k in (("score", float), ("n", np.uint32), ("pos", np.uint32))]
        _, n, pos = (a[::-1] for a in _counted(*joined))
        gain = pos * (above[i, 1, part] + pos.cumsum()) / (above[i, 0, part] + n.cumsum())
        return pa.table({"round": pa.array([i], pa.int32()), "gain": [float(gain.sum())]})

    shares = blocks.mapInArrow(dealt, "round int, part int, score binary, n binary, pos binary").groupBy("round", "part").applyInArrow(gained, "round int, gain double")
    gain = {r["round"]: r["gain"] for r in shares.groupBy("round").agg(F.sum("gain").alias("gain")).collect()}  # a row a round
    positives = total[:, 1].sum(axis=1)
    return [gain[i] / positives[i] if positives[i] else 0.0 for i in range(rounds)]


def _advanced(blocks: DataFrame, trees: list[Tree], width: int) -> DataFrame:
    """The blocks with the trees in their margins; the old ones are deleted."""

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            margins = []
            for _, x, _y, margin in _opened([b], width):
                for t in trees:
                    margin = margin + t.value[t.place(x, t.depth)]
                margins.append(margin.tobytes())
            yield b.set_column(4, "margin", pa.array(margins, pa.binary()))

    out = _kept(blocks.mapInArrow(moved, BLOCK))
    _dropped(blocks)
    return out


def forest_of_bins(trees: list[Tree], cuts: list[list[float]], names: list[str], unknown: float) -> Forest:
    """The trees as a forest over the inputs themselves, whose margin counts twice. An unknown input goes where `unknown` goes."""
    out: dict[str, list] = {n: [] for n in ("roots", "feature", "threshold", "kind", "left", "right", "leaf")}

    def add(t: Tree, i: int) -> int:
        inner = len(t.cut)
        if i >= inner or t.cut[i] == NO_CUT:
            while i < inner:
                i = 2 * i + 1
            out["leaf"].append(float(t.value[i - inner]))
            return ~(len(out["leaf"]) - 1)
        at, threshold = len(out["feature"]), cuts[t.feature[i]][t.cut[i]]
        out["feature"].append(int(t.feature[i]))
        out["threshold"].append(threshold)
        out["kind"].append(MISSING_NAN << 2 | (MISSING_LEFT if unknown <= threshold else 0))
        out["left"].append(0)
        out["right"].append(0)
        out["left"][at], out["right"][at] = add(t, 2 * i + 1), add(t, 2 * i + 2)
        return at

    for t in trees:
        out["roots"].append(add(t, 0))
    arrays = {k: np.array(x, float if k in ("threshold", "leaf") else np.int64) for k, x in out.items()}
    none = np.zeros(len(out["feature"]), np.int64)
    return Forest(list(names), 2.0, **arrays, first=none, last=none.copy())


def boosted(
    train: DataFrame, validation: DataFrame, features: list[str], rounds: int, ended: Callable[[list[float]], bool], depth: int, step: float, least: int, share: float, bins: int,
    seed: int, sampled: float = 0.8, unknown: float = -1.0,
) -> tuple[Forest, list[float], list[np.ndarray]]:
    """(forest, the validation average precision after each round, gains of each round's tree). Gradient boosting of the logistic loss for labels -1 and 1:
    the first tree fits the labels, each other one the residuals, `step` of which counts; every round draws `sampled` of the training rows,
    and all of them count over the rounds. Rounds end where `ended`, which gets the curve so far every few rounds, says so."""
    if not 2 <= bins <= NO_CUT:
        raise ValueError(f"bins are 2 to {NO_CUT}")
    given, width, most = F.lit(unknown), len(features), "spark.sql.execution.arrow.maxBytesPerBatch"
    train.sparkSession.conf.set(most, "4m")  # a few blocks; larger batches take twice as long to pass
    inputs = [F.coalesce(F.nanvl(F.col(f).cast("double"), given), given).alias(f) for f in features]
    rows, checked = (d.where(F.col("y").isNotNull()).select(*inputs, F.col("y").cast("double").alias("y")) for d in (train, validation))
    cuts = cuts_of(rows, features, bins)
    blocks, tests = blocks_of(rows, cuts), blocks_of(checked, cuts)
    trees, since, curve = [], [], []
    while len(trees) < rounds and not (curve and ended(curve)):
        tree = _grown(blocks, since, len(trees), width, depth, least, cuts, bins, seed, sampled, share)
        tree.value *= step if trees else 1.0
        trees.append(tree)
        since.append(tree)
        if len(since) == REFRESH or len(trees) == rounds:
            curve += average_precisions(tests, since, width)
            blocks, tests, since = _advanced(blocks, since, width), _advanced(tests, since, width), []
    _dropped(blocks)
    _dropped(tests)
    return forest_of_bins(trees, cuts, features, unknown), curve, [t.gains for t in trees]
